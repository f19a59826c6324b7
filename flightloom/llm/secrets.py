"""Secret scan with corpus-wide ownership of every candidate value (operator 2). Column expressions and joins only.

Three strict patterns give the base spans, which always stay. Long mixed strings are candidates without a
pattern of their own. Every candidate's value is hashed; a value that many owners hold is a copied
example, one that a single owner or two hold and that looks random is live. Live mixed strings join the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..workload.registry import Registry

REGISTRY = Registry()

# The patterns of the base spans, in the order of their kinds, and of mixed strings.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"  # equal to runs of [0-9a-f] of 32 or more
MIXED = "[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "mixed")
#: Values with one of these in them are placeholders.
PLACEHOLDER = "(?i:example|sample|dummy|placeholder|changeme|your|test|xxxx|0000|1234567)"
#: A value that so many owners hold is a copied example; one with at most so many is theirs.
WIDE, OWN = 5, 2
BLOCK = 256


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit) of the leftmost non-overlapping matches; code points, end exclusive.

    A text is split at its matches, and lengths of gaps and hits are summed up: within blocks of hits, then over blocks,
    so that a text with very many hits is not copied once per hit.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    parts = F.filter(parts, lambda p: p["hit"].isNotNull())
    sized = F.transform(parts, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("size"), p["hit"].alias("hit")))
    kind = "array<struct<start:int,end:int,hit:string>>"

    def place(block: Column, begin: Column) -> Column:
        def step(done: Column, p: Column) -> Column:
            start = done["at"] + p["gap"]
            one = F.struct(start.alias("start"), (start + p["size"]).alias("end"), p["hit"].alias("hit"))
            return F.struct((start + p["size"]).alias("at"), F.concat(done["out"], F.array(one)).alias("out"))

        empty = F.struct(begin.alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(block, empty, step, lambda done: done["out"])

    def blocks(all_parts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_parts), F.lit(BLOCK))
        return F.transform(starts, lambda s: F.slice(all_parts, s, F.lit(BLOCK)))

    def offsets(cut: Column) -> Column:
        def step(done: Column, block: Column) -> Column:
            total = F.aggregate(block, F.lit(0), lambda n, p: n + p["gap"] + p["size"])
            one = F.struct(done["at"].alias("begin"), block.alias("block"))
            return F.struct((done["at"] + total).alias("at"), F.concat(done["out"], F.array(one)).alias("out"))

        inner = "array<struct<begin:int,block:array<struct<gap:int,size:int,hit:string>>>>"
        return F.aggregate(cut, F.struct(F.lit(0).alias("at"), F.array().cast(inner).alias("out")), step, lambda done: done["out"])

    few = F.when(F.size(sized) <= BLOCK, place(sized, F.lit(0)))
    return few.otherwise(F.flatten(F.transform(offsets(blocks(sized)), lambda b: place(b["block"], b["begin"]))))


def _spans(found: Column, kind: int, keep, value) -> Column:
    """Spans as (start, order of kind, end, value)."""
    kept = F.filter(found, lambda m: keep(m["hit"]))
    return F.transform(
        kept, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), value(m["hit"]).alias("value"))
    )


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def candidates(docs: DataFrame, text: str, key: str, repository: Column, owner: Column) -> DataFrame:
    """One row per document: its base spans and its mixed strings, each with the SHA-256 of its value."""
    rows = docs.select(
        F.col(key).alias("doc"),
        F.coalesce(repository, F.lit("")).alias("repository"),
        F.coalesce(owner, F.lit("")).alias("owner"),
        F.coalesce(F.col(text), F.lit("")).alias("content"),
    )
    body = F.col("content")
    whole = lambda hit: hit
    mixed = lambda hit: hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")
    value = lambda hit: F.regexp_extract(hit, ASSIGN, 2)
    rows = rows.select(
        "doc",
        "repository",
        "owner",
        _spans(matches(body, ASSIGN), 0, lambda hit: F.length(value(hit)) >= 8, value).alias("assign"),
        _spans(matches(body, ACCESS), 1, lambda hit: F.length(hit) >= 16, whole).alias("access"),
        _spans(matches(body, HEX), 2, lambda hit: F.length(hit) >= 32, whole).alias("hex"),
        _spans(matches(body, MIXED), 3, mixed, whole).alias("mixed"),
    )
    placed = lambda spans: F.transform(
        F.array_sort(spans),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["kind"].alias("kind"),
            s["end"].alias("end"),
            F.sha2(s["value"], 256).alias("hash"),
            (~s["value"].rlike(PLACEHOLDER) & s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")).alias("random"),
        ),
    )
    return rows.select(
        "doc",
        "repository",
        "owner",
        placed(F.concat("assign", "access", "hex")).alias("base"),
        placed(F.col("mixed")).alias("mixed"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate hash: ``n_found``, ``n_repositories``, ``n_owners``; summed up in steps, so a value held everywhere stays small."""
    by_place = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_place.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_found"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan(
    docs: DataFrame,
    repository: Column,
    owner: Column,
    text: str = "text",
    key: str = "doc_id",
    wide: int = WIDE,
    own: int = OWN,
) -> DataFrame:
    """One row per document: key, ``base`` and ``added`` spans, and numbers of ``live`` and ``copied`` values among them.

    Spans are structs (start, kind, end, hash, random). A repository belongs to an owner; a value is counted once per
    (owner, repository). It is a copied example from ``wide`` owners on, and live if at most ``own`` owners hold it, it has letters
    and digits and no placeholder word. NULL and empty texts have no spans; NULL owners and repositories count as one more,
    unnamed; repeated rows come out once each; no rows give no rows. Other columns are not read.
    """
    rows = cut_lineage(candidates(docs, text, key, repository, owner).withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", "owner", "repository", F.explode(F.concat("base", "mixed")).alias("s"))
    each = each.select("row", "owner", "repository", "s.*")
    known = ownership(each).select(
        F.col("hash").alias("known"), (F.col("n_owners") >= wide).alias("is_wide"), (F.col("n_owners") <= own).alias("is_own")
    )
    judged = each.join(known, F.col("hash") == F.col("known"))
    live = F.col("is_own") & F.col("random")
    span = F.struct("start", "kind", "end", "hash", "random")
    found = judged.groupBy("row").agg(
        F.count_if(live).alias("n_live"),
        F.count_if("is_wide").alias("n_copied"),
        F.collect_list(F.when(live & (F.col("kind") == 3), span)).alias("added"),
    )
    out = rows.join(found, "row", "left")
    none = F.lit(0).cast("long")
    return out.select(
        F.col("doc").alias(key),
        "base",
        F.coalesce("added", F.filter("base", lambda s: F.lit(False))).alias("added"),
        F.coalesce("n_live", none).alias("n_live"),
        F.coalesce("n_copied", none).alias("n_copied"),
    )


_PLACED = """
    {k}_p AS (SELECT row, unnest(regexp_split_to_array(content, '{p}')) AS gap, unnest(regexp_extract_all(content, '{p}')) AS hit,
                     generate_subscripts(regexp_split_to_array(content, '{p}'), 1) AS i FROM d),
    {k} AS (SELECT row, {n} AS kind, hit, {v} AS value,
                   sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY row ORDER BY i) AS stop, length(hit) AS size FROM {k}_p)
"""


def _oracle() -> str:
    patterns = (ASSIGN, ACCESS, HEX, MIXED)
    parts = []
    for n, (kind, pattern) in enumerate(zip(KINDS, patterns, strict=True)):
        p = pattern.replace("'", "''").replace("\\x20", " ")
        value = f"regexp_extract(hit, '{p}', 2)" if kind == "assign" else "hit"
        parts.append(_PLACED.format(k=kind + "_m", n=n, p=p, v=value))
    union = " UNION ALL ".join(f"SELECT * FROM {k}_m WHERE hit IS NOT NULL" for k in KINDS)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS content, coalesce(source, '') AS owner,
                      concat_ws('/', source, lang) AS repository FROM documents),
    {",".join(parts)},
    s AS (SELECT row, kind, stop - size AS start, stop, value FROM ({union})
          WHERE CASE kind WHEN 0 THEN length(value) >= 8 WHEN 1 THEN size >= 16 WHEN 2 THEN size >= 32
                ELSE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') END),
    f AS (SELECT value, count(DISTINCT owner) AS owners FROM s JOIN d USING (row) GROUP BY value),
    j AS (SELECT s.*, owners >= {WIDE} AS wide, owners <= {OWN} AND NOT regexp_matches(value, '{PLACEHOLDER}')
                 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AS live,
                 ['assign', 'access', 'hex', 'mixed'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS said FROM s JOIN f USING (value)),
    g AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                 count(*) FILTER (live) AS n_live, count(*) FILTER (wide) AS n_copied,
                 string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
                 string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans FROM j GROUP BY row)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
           coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
    FROM d LEFT JOIN g USING (row)
    """


@REGISTRY.add("op2_secrets", _oracle())
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        "n_live",
        "n_copied",
    )

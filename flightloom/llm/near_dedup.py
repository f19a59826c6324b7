"""Near duplicates: SuperMinHash signatures, bands, checked links, union of linked documents (operator 9)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..workload.registry import Registry
from . import words as W
from .components import components

REGISTRY = Registry()

#: Numbers in a signature, and numbers in a band. 32 bands of 4 miss a pair of similarity 0.85 with
#: probability (1 - 0.85^4)^32 = 6e-11, and one of similarity 0.8 with 5e-8.
SLOTS, IN_BAND = 128, 4
#: Rounds in which each group proposes one link before all pairs that are left in a band are tested.
STAR_ROUNDS = 2


def super_min_hash(items: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The SuperMinHash signature of a set of 64-bit hashes.

    Each item draws a random number and the next slot of its own random permutation at
    every level; a slot keeps the least level + number. Items go level by level together, and
    the work stops as soon as no slot can still fall: after one level for large sets.
    """
    signature = np.full(slots, np.inf)
    order = drawn = None
    rows = np.arange(len(items))
    for level, seed in enumerate(W.seeds(slots, 5000)):
        bits = W.mix(items ^ seed)
        pick = level + ((bits >> W.U(32)) * W.U(slots - level) >> W.U(32)).astype(np.int64)
        if level == 0:
            slot, drawn = pick, pick
        else:
            if order is None:  # the swaps of the first level
                order = np.tile(np.arange(slots, dtype=np.uint16), (len(items), 1))
                order[rows, drawn] = 0
                order[:, 0] = drawn
            slot = order[rows, pick].copy()
            order[rows, pick] = order[:, level]
            order[:, level] = slot
        np.minimum.at(signature, slot, level + (W.mix(bits) >> W.U(11)).astype(np.float64) * 2.0**-53)
        if signature.max() < level + 1:
            break
    return signature


def band_keys(signature: np.ndarray, in_band: int = IN_BAND) -> np.ndarray:
    """One number per band; different bands never share one but by chance."""
    bits = signature.view(W.U).reshape(-1, in_band)
    out = W.seeds(len(bits), 9000)
    for i in range(in_band):
        out = W.mix(out ^ bits[:, i])
    return out.view(np.int64)


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, bands = [], [], []
            for _, found in W.text_shingles(batch.column("content"), size):
                n.append(len(found))
                ids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                bands.append(band_keys(super_min_hash(found)) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    pa.array(n, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc", "n", "set_id", "bands"],
            )

    return run


def _checked(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.portions(W.portions([whole], "text_a"), "text_b"):
                good = []
                for texts in zip(*(batch.column(c).cast(pa.large_binary()).to_pylist() for c in ("text_a", "text_b")), strict=True):
                    left, right, both = W.shared_shingles(tuple(t or b"" for t in texts), size)
                    good.append(100 * both >= percent * (left + right - both))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _listed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [found.view(np.int64) for _, found in W.text_shingles(batch.column("content"), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("label"), pa.array(lists, pa.list_(pa.int64()))], names=["doc", "label", "shingles"]
            )

    return run


def _with(pairs: DataFrame, side: str, table: DataFrame, value: str) -> DataFrame:
    return pairs.join(table.select(F.col("doc").alias(side), F.col(value).alias(f"{value}_{side}")), side)


def rarest(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc, n, label, shingle, at): the shingles of each of ``docs`` that are rarest among them, with their rank from 0.

    Alike sets share at least ``percent`` of either, so the rarest shingle that they share has at most the rest before it in
    each: two sets that have none of these in common can't be alike. Shingles of one document only are left out.
    """
    lists = docs.select("doc", "label").join(members, "doc").mapInArrow(_listed(size), "doc long, label long, shingles array<bigint>")
    each = cut_lineage(lists).select("doc", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    placed = each.join(often, "shingle").withColumn("at", F.expr("row_number() OVER (PARTITION BY doc ORDER BY often, shingle) - 1"))
    few = placed.where("often > 1").join(docs, "doc").where(f"100 * at <= (100 - {percent}) * n")
    return cut_lineage(few.select("doc", "n", "label", "shingle", "at"))


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: key, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 * shared >= ``percent`` * all of their distinct shingles of
    ``size`` words (A-Z lower-cased, words end at ASCII white space; a text with fewer words is one
    shingle). ``component_id`` is the smallest key that links reach; that document is kept.

    1. Every text gets its SuperMinHash signature, cut into bands. 2. Equal sets become one class. 3. Classes
    that share a band are candidates. In the first rounds, each group of linked classes proposes its candidate with
    most bands in common, out of one hub per band, so that a band shared by very many copies takes one link each.
    Then all pairs of different groups that share a band somewhere are tested by their rarest shingles: alike
    sets must share one that is rare in both, which leaves few pairs and loses none, so no link is lost to the hubs.
    4. Links are confirmed on full sets of words, from the texts, not on hashes. 5. Linked classes are united.

    NULL or blank texts have no shingles and are linked with nothing. Rows without a key come out with
    NULL ``component_id`` and are kept. Rows that repeat a key must repeat its text; they come out once each.
    No rows give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("content"))
    keyed = rows.where("doc IS NOT NULL")
    sketches = cut_lineage(
        rows.mapInArrow(_sketches(size), "doc long, n long, set_id binary, bands array<bigint>")
    )
    full = sketches.where("doc IS NOT NULL AND n > 0")
    classes = cut_lineage(full.groupBy("set_id").agg(F.min("doc").alias("class"), F.min("n").alias("n")))

    # One row per class and band, for bands that classes share.
    heads = full.join(classes.select(F.col("class").alias("doc")), "doc", "left_semi").dropDuplicates(["doc"])
    rungs = heads.select("doc", "n", F.explode("bands").alias("band"))
    shared = rungs.groupBy("band").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("size"))
    shared = shared.where("first <> last")
    rungs = cut_lineage(rungs.join(shared.select("band", "size"), "band"))
    weights = cut_lineage(rungs.groupBy("doc").agg(F.sum("size").alias("weight")))  # the middle of a family of copies has most
    members = cut_lineage(keyed.join(weights.select("doc"), "doc").dropDuplicates(["doc"]))
    near = f"100 * least(n, n_b) >= {percent} * greatest(n, n_b)"

    def confirmed(pairs: DataFrame) -> DataFrame:
        named = members.withColumnRenamed("content", "text")
        return cut_lineage(
            _with(_with(pairs, "a", named, "text"), "b", named, "text").mapInArrow(_checked(size, percent), "a long, b long")
        )

    def labelled(links: DataFrame | None) -> DataFrame:
        if links is None:
            return rungs.join(weights, "doc").withColumn("label", F.col("doc"))
        roots = components(links)
        return rungs.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select(
            "doc", "n", "band", F.coalesce("root", "doc").alias("label")
        )

    links = tested = None
    for turn in range(STAR_ROUNDS):
        now = labelled(links)
        first = F.xxhash64("doc", F.lit(turn)) if turn else -F.col("weight")
        order = F.struct(first.alias("o"), "doc", "n", "label")
        hub = now.groupBy("band").agg(F.min(order).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high"))
        hub = hub.where("low <> high").select("band", F.col("hub.doc").alias("b"), F.col("hub.n").alias("n_b"), F.col("hub.label").alias("label_b"))
        wanted = now.join(hub, "band").where(f"label <> label_b AND {near}")
        wanted = wanted.groupBy(F.col("doc").alias("a"), "b", "label").agg(F.count("*").alias("bands"))
        best = F.max(F.struct("bands", (-F.col("b")).alias("low_b"), (-F.col("a")).alias("low_a"), "a", "b")).alias("best")
        pairs = cut_lineage(wanted.groupBy("label").agg(best).select("best.a", "best.b"))
        found = confirmed(pairs)
        links = found if links is None else links.union(found)
        tested = pairs if tested is None else tested.union(pairs)

    # What is still apart in a band: pairs of different groups that share a shingle which is rare enough in both.
    now = cut_lineage(labelled(links))
    mixed = now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    mixed = cut_lineage(now.join(mixed, "band").select("doc", "n", "label").distinct())
    left = rarest(mixed, members, size, percent)
    right = left.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("doc", "n", "label", "at")))
    enough = " AND ".join(f"{100 + percent} * (n{s} - at{s}) >= {percent} * (n + n_b)" for s in ("", "_b"))
    apart = left.join(right, "shingle").where(f"doc < doc_b AND label <> label_b AND {near} AND {enough}")
    apart = apart.select(F.col("doc").alias("a"), F.col("doc_b").alias("b")).distinct()
    seen = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = links.union(confirmed(cut_lineage(apart.join(seen, ["a", "b"], "left_anti"))))

    roots = components(links).withColumnRenamed("node", "class")
    groups = classes.select("set_id", "class").join(roots, "class", "left").select("set_id", F.coalesce("root", "class").alias("root"))
    out = sketches.select("doc", "n", "set_id").join(groups, "set_id", "left")
    return out.select(
        F.col("doc").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("root", "doc")).alias("component_id"),
        (F.col("doc").isNull() | (F.col("doc") == F.coalesce("root", "doc"))).alias("kept"),
    )


def drop_near(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, with all its columns; rows without a key stay."""
    gone = near_groups(docs, text, key, size, percent).where("NOT kept").select(key).distinct()
    return docs.join(gone, key, "left_anti").select(docs.columns)


@REGISTRY.add(
    "op9_near_dedup",
    """
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    k AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) AS i FROM w),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS shingle FROM k),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON r.o = e.a),
    c AS (SELECT d AS doc_id, min(o) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
    """,
)
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))

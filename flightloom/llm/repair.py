"""Conversation structure repair by Hirschberg's divide and conquer (operator 11).

Roles of a sound conversation read ``(s?(ua)+)?``. A row can be kept (free), given another role (3) or deleted (4); an empty turn can be put in
anywhere (3). Between two rows the roles so far are in one of four states: nothing, system, user, assistant. A row, a block of rows
and a whole conversation are each a table of the least cost from state to state, with the order of the edits' letters as tie
break, so that a conversation of any length can lie in many ranges of rows, each with a table made in its own task.
The way down is Hirschberg's: a forward cost vector from the first state and a backward one from the last meet in the middle, the
optimal crossing with the least letters is chosen, and both halves go on: first between the ranges of a conversation, then between
blocks of a range, then between rows. Only two vectors are held at a time.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..workload.registry import Registry
from . import words as W

REGISTRY = Registry()

STATES = "nothing", "system", "user", "assistant"
#: The state after a user or assistant turn that an edit makes, which state and grammar leave no choice about.
MADE = (2, 2, 3, 2)
#: Inserts that a conversation still needs when all rows are done, by state.
MISSING = (0, 2, 1, 0)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 60
#: Rows of a block within a range.
BLOCK = 4096
# monotonically_increasing_id keeps the partition number above this many bits.
_ROW_BITS = 33

#: Least cost from state p to state q at 4 * p + q, then the rank of the letters among the four q of the same p.
Table = tuple[tuple[int, ...], tuple[int, ...]]


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row with this initial is kept, if the grammar lets it be."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return 2 if state != 2 else None
    return 3 if initial == "a" and state == 2 else None


@functools.lru_cache(maxsize=64)
def row_edits(initial: str, truncated: bool, gone: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """For each way from state to state, the least cost and letters of one row and the inserts before it.

    Three inserts in a row are never cheapest: two of them undo each other. A row that must go needs none before it,
    since D comes before I and the inserts can as well follow.
    """
    if gone:
        return {(p, p): (DELETE, "D") for p in range(4)}
    best: dict[tuple[int, int], tuple[int, str]] = {}
    extra = TRUNCATED * truncated
    for p in range(4):
        state = p
        for inserts in range(3):
            ways = [(state, DELETE, "D"), (MADE[state], REROLE + extra, "R")]
            if (after := kept_state(state, initial)) is not None:
                ways.append((after, extra, "K"))
            for q, cost, letter in ways:
                made = cost + INSERT * inserts, "I" * inserts + letter
                best[p, q] = min(best.get((p, q), made), made)
            state = MADE[state]
    return best


@functools.lru_cache(maxsize=64)
def row_table(initial: str, truncated: bool, gone: bool) -> Table:
    edits = row_edits(initial, truncated, gone)
    costs, ranks = [NEVER] * 16, [0] * 16
    for p in range(4):
        reached = sorted((edits[p, q][1], q) for q in range(4) if (p, q) in edits)
        for rank, (_, q) in enumerate(reached):
            costs[4 * p + q], ranks[4 * p + q] = edits[p, q][0], rank
    return tuple(costs), tuple(ranks)


def with_copies(table: Table, copies: int) -> Table:
    """The same row with so many copies after it, which all have to go."""
    return (tuple(c + DELETE * copies if c < NEVER else c for c in table[0]), table[1]) if copies else table


def _forward(costs: list[int], ranks: list[int], table: Table) -> tuple[list[int], list[int]]:
    """Cost and rank of letters by state, one table further."""
    found = []
    step, order = table
    for q in range(4):
        best = min((costs[p] + step[4 * p + q], ranks[p], order[4 * p + q], q) for p in range(4))
        found.append(best)
    after = [min(b[0], NEVER) for b in found]
    rank = [0] * 4
    for place, b in enumerate(sorted(found, key=lambda b: (b[0] >= NEVER, b[1], b[2]))):
        rank[b[3]] = place
    return after, rank


def combined(tables: list[Table]) -> Table:
    """The table of tables one after another: a forward vector from each of the four states."""
    if len(tables) == 1:
        return tables[0]
    costs, ranks = [], []
    for p in range(4):
        cost, rank = [NEVER] * 4, [0] * 4
        cost[p] = 0
        for table in tables:
            cost, rank = _forward(cost, rank, table)
        costs += cost
        ranks += rank
    return tuple(costs), tuple(ranks)


def crossing(tables: list[Table], low: int, middle: int, high: int, first: int, last: int) -> int:
    """The state in the middle of the cheapest way from ``first`` before table ``low`` to ``last`` after table ``high - 1``.

    Letters up to the middle end with a row's own, so none of two ways' is the beginning of the other, and the rank of the forward vector decides ties.
    """
    cost, rank = [NEVER] * 4, [0] * 4
    cost[first] = 0
    for i in range(low, middle):
        cost, rank = _forward(cost, rank, tables[i])
    left = [NEVER] * 4
    left[last] = 0
    for i in range(high - 1, middle - 1, -1):
        step = tables[i][0]
        left = [min(step[4 * p + q] + left[q] for q in range(4)) for p in range(4)]
    return min((cost[q] + left[q], rank[q], q) for q in range(4))[2]


def crossings(tables: list[Table], first: int, last: int) -> list[int]:
    """The states between the tables of the cheapest way, the least letters among equals; one entry more than tables."""
    states = [first] + [0] * (len(tables) - 1) + [last]
    todo = [(0, len(tables))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        states[middle] = crossing(tables, low, middle, high, states[low], states[high])
        todo += [(low, middle), (middle, high)]
    return states


def ending(table: Table) -> tuple[int, int]:
    """Cost of a whole conversation, and the state after its last row; what is missing then is put in."""
    costs, ranks = table
    cost, _, last = min((costs[q] + INSERT * MISSING[q], ranks[q], q) for q in range(4))
    return cost, last


def after_edits(edits: str, state: int, role: str) -> int:
    """The state after the letters of one row."""
    for letter in edits:
        if letter == "K":
            state = kept_state(state, role[:1])
        elif letter != "D":
            state = MADE[state]
    return state


def repaired_roles(edits: str, state: int, role: str) -> Iterator[tuple[str, bool]]:
    """Role of every turn that the letters of one row leave or make, and whether it is the row's own."""
    for letter in edits:
        if letter == "D":
            continue
        if letter == "K":
            state = kept_state(state, role[:1])
        else:
            state = MADE[state]
        yield (role if letter == "K" else STATES[state]), letter != "I"


# Spark side. A table travels as 32 numbers of 8 bytes; a conversation's key as text ("" for NULL, "=..." otherwise).

_PARTS = "talk string, span long, place long, costs binary, illegal long, head string, tail string"
_STEPS = "talk string, span long, place long, first int, last int, cost long, illegal long"
_EDITS = "place long, first int, edits string"
_HASHES = "talk string, audit string, repaired_sha256 string"
_TURNS = "talk string, place long, part int, role string, text string"


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batches(rows: Iterator[tuple], schema: str, most: int = 4096) -> Iterator[pa.RecordBatch]:
    fields = pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, schema.split(", "))])
    while held := list(itertools.islice(rows, most)):
        columns = [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), fields, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, schema=fields)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in W.portions([batch], "content") if "content" in batch.schema.names else [batch]:
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[Iterator[tuple]]:
    """Rows of sorted batches that agree in their first columns; a group may go over several batches."""
    return (rows for _, rows in itertools.groupby(_rows(batches), key=lambda row: row[:keys]))


def _table_of(row: tuple) -> Table:
    return with_copies(row_table(*row[3:6]), row[6] - 1)


def _blocks(tables: list[Table]) -> list[Table]:
    return [combined(tables[i : i + BLOCK]) for i in range(0, len(tables), BLOCK)]


def _illegal(before: str | None, after: str) -> int:
    return before is not None and before + after not in ("su", "ua", "au")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One table for each conversation and range; only a block of rows is held."""

    def made():
        for group in _groups(batches, 2):
            table, illegal, head, tail, place = None, 0, None, None, 0
            while rows := list(itertools.islice(group, BLOCK)):
                block = combined([_table_of(r) for r in rows])
                table = block if table is None else combined([table, block])
                talk, span = rows[0][:2]
                for row in rows:
                    illegal += _illegal(tail, row[3]) + row[6] - 1
                    head, tail, place = row[3] if head is None else head, row[3], row[2]
            yield talk, span, place, struct.pack("<32q", *table[0], *table[1]), illegal, head, tail

    return _batches(made(), _PARTS)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last state of each range of a conversation; its cost and illegal neighbours stand at its first range."""

    def made():
        for group in _groups(batches, 1):
            rows = list(group)  # at most one for each range of the sorted table
            numbers = [struct.unpack("<32q", r[3]) for r in rows]
            tables = [(n[:16], n[16:]) for n in numbers]
            cost, last = ending(combined(tables))
            states = crossings(tables, 0, last)
            illegal = sum(r[4] for r in rows) + sum(_illegal(a[6], b[5]) for a, b in itertools.pairwise(rows))
            for i, r in enumerate(rows):
                yield (*r[:3], states[i], states[i + 1], 0 if i else cost, 0 if i else illegal)

    return _batches(made(), _STEPS)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters of every row: crossings between blocks of a range, then inside each block."""

    def made():
        for group in _groups(batches, 2):
            rows = list(group)
            tables = [_table_of(r) for r in rows]
            between = crossings(_blocks(tables), *rows[0][7:9])
            for b, low in enumerate(range(0, len(rows), BLOCK)):
                states = crossings(tables[low : low + BLOCK], between[b], between[b + 1])
                for r, first, last in zip(rows[low : low + BLOCK], states[:-1], states[1:], strict=True):
                    yield r[2], first, row_edits(*r[3:6])[first, last][1] + "D" * (r[6] - 1)

    return _batches(made(), _EDITS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters and digest of each conversation; texts go through the digest one by one and are not held."""

    def made():
        for group in _groups(batches, 1):
            audit, digest, state, between, talk = [], hashlib.sha256(), 0, "", ""
            for talk, _, _, edits, role, content, first in group:
                audit.append(edits)
                for made_role, own in repaired_roles(edits, first, role):
                    digest.update(f"{between}{made_role}:{content if own else ''}".encode())
                    between = "\n"
                if edits:
                    state = after_edits(edits, first, role)
            for _ in range(MISSING[state]):
                state = MADE[state]
                audit.append("I")
                digest.update(f"{between}{STATES[state]}:".encode())
                between = "\n"
            yield talk, "".join(audit), digest.hexdigest()

    return _batches(made(), _HASHES)


def _talk(conv: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def sequence(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of all conversations in order, with their faults, as a written table.

    Order is by turn (NULL first), then role, then text. A NULL role or text is one space; a NULL key is a conversation of its own. Equal
    rows of a conversation are one row with ``copies``. ``blank``: nothing but white space. ``again``: role and text
    stand at an earlier turn (copies beyond the first count as such too). ``truncated``: the last character that is no
    white space is none of ``.!?``. An earlier fault excludes the later ones. ``gone``: blank or again, such a row has to be deleted.
    """
    space = F.lit(" ")
    base = rows.select(
        _talk(conv).alias("talk"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("content"),
    )
    base = base.groupBy("talk", "turn", "role", "content").agg(F.count("*").alias("copies"))
    base = base.withColumn("digest", F.sha2("content", 256))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    earliest = base.groupBy("talk", "role", "digest").agg(F.min(when).alias("earliest"))
    placed = base.withColumn("when", when).join(earliest, ["talk", "role", "digest"])
    blank = ~F.col("content").rlike(r"[^\x20\x09-\x0D]")
    again = ~blank & (F.col("when") > F.col("earliest"))
    placed = placed.select(
        "talk", "turn", "role", "content", "copies", blank.alias("blank"), again.alias("again"),
        (~blank & ~again & ~F.col("content").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )
    order = [F.col("talk"), F.asc_nulls_first("turn"), F.col("role")]
    ranged = placed.repartitionByRange(*order, F.substring("content", 1, 64)).sortWithinPartitions(*order, "content")
    ranged = ranged.withColumn("place", F.monotonically_increasing_id())
    return cut_lineage(ranged.withColumn("span", F.shiftright("place", _ROW_BITS)).withColumn("gone", F.expr("blank OR again")))


def _light(seq: DataFrame) -> DataFrame:
    return seq.select("talk", "span", "place", F.substring("role", 1, 1).alias("initial"), "truncated", "gone", "copies")


def plan(seq: DataFrame) -> DataFrame:
    """For each conversation and range of ``seq``: first and last state of the cheapest repair, as a written table."""
    rows = _light(seq).repartition("talk", "span").sortWithinPartitions("talk", "span", "place")
    parts = rows.mapInArrow(_parts, _PARTS)
    return cut_lineage(parts.repartition("talk").sortWithinPartitions("talk", "span").mapInArrow(_steps, _STEPS))


def edits(seq: DataFrame, steps: DataFrame) -> DataFrame:
    """The rows of ``seq`` with the state before each (``first``) and its letters (``edits``), inserts before it included."""
    light = _light(seq).join(steps.select("talk", "span", "first", "last"), ["talk", "span"])
    light = light.repartition("talk", "span").sortWithinPartitions("talk", "span", "place")
    return seq.join(light.mapInArrow(_edited, _EDITS), "place")


def repaired(edited: DataFrame) -> DataFrame:
    """The turns of repaired conversations: ``talk``, ``place`` and ``part`` (their order), ``role``, ``text``; spread as ``edited`` is.

    Inserts that a conversation needs at its very end are not among them; :func:`report` has them in the audit.
    """

    def run(batches):
        def made():
            for talk, place, change, role, content, first in _rows(batches):
                for part, (made_role, own) in enumerate(repaired_roles(change, first, role)):
                    yield talk, place, part, made_role, content if own else ""

        return _batches(made(), _TURNS)

    return edited.select("talk", "place", "edits", "role", "content", "first").mapInArrow(run, _TURNS)


def report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: key, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    ``gaps``: turn numbers missing between the smallest and the largest, 0 without known turns. ``illegal``: neighbours whose roles' first letters are
    not su, ua or au. ``audit``: the cheapest edits' letters in order, least in ASCII among equals; it grows with the conversation, as a cell.
    The digest of a conversation is made in one task, which reads its rows one by one and holds none. An empty table gives no rows.
    """
    seq = sequence(rows, conv, turn, role, text)
    steps = plan(seq)
    turns = seq.groupBy("talk", "turn").agg(
        F.sum(F.col("copies") * F.col("blank").cast("long")).alias("blank"),
        F.sum(F.expr("CASE WHEN blank THEN 0 WHEN again THEN copies ELSE copies - 1 END")).alias("duplicate"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"),
    )
    counts = turns.groupBy("talk").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
    )
    costs = steps.groupBy("talk").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    edited = edits(seq, steps).select("talk", "span", "place", "edits", "role", "content", "first")
    hashes = edited.repartition("talk").sortWithinPartitions("talk", "place").mapInArrow(_hashed, _HASHES)
    keys = rows.select(conv).distinct().withColumn("talk", _talk(conv))
    out = keys.join(counts, "talk").join(costs, "talk").join(hashes, "talk")
    names = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return out.select(conv, *names)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's faults on ``conversations``: rows dropped, emptied, cut, doubled or with another role, by a checksum of their place."""
    space = F.lit(" ")
    where = F.concat(*(x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), space), F.lit(":"))))
    fault = F.crc32(F.expr("substring(place, 1, length(place) - 1)").cast("binary")) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), where.alias("place"))
    rows = rows.withColumn("fault", fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


_SQL = r"""
    WITH RECURSIVE crc_table AS (
      SELECT list(v ORDER BY i) AS crcs FROM (
        SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) r(i))
    ), keyed AS (
      SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') AS talk, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place
      FROM conversations
    ), faulted AS (
      SELECT talk, turn, role, text, xor(4294967295, list_reduce(
               list_concat([4294967295], list_transform(string_split(place, ''), lambda x: ascii(x)::BIGINT)),
               lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) % 20 AS fault
      FROM keyed, crc_table
    ), damaged AS (
      SELECT talk, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
             CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM faulted WHERE fault <> 0
    ), numbered AS (
      SELECT *, row_number() OVER (PARTITION BY talk ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial,
             NOT regexp_matches(text, '[^ 	-
]') AS blank
      FROM damaged
    ), judged AS (
      SELECT *, NOT blank AND row_number() OVER (PARTITION BY talk, role, text ORDER BY i) > 1 AS again,
             coalesce(lag(initial) OVER (PARTITION BY talk ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
      FROM numbered
    ), rows_ AS (
      SELECT *, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][ 	-
]*$') AS truncated FROM judged
    ), inserts(p, k, s, letters, made) AS (
      VALUES (0, 0, 0, '', ''), (0, 1, 2, 'I', 'U'), (0, 2, 3, 'II', 'UA'), (1, 0, 1, '', ''), (1, 1, 2, 'I', 'U'), (1, 2, 3, 'II', 'UA'),
             (2, 0, 2, '', ''), (2, 1, 3, 'I', 'A'), (2, 2, 2, 'II', 'AU'), (3, 0, 3, '', ''), (3, 1, 2, 'I', 'U'), (3, 2, 3, 'II', 'UA')
    ), edits(s, initial, q, letter) AS (
      VALUES (0, 's', 1, 'K'), (0, 'u', 2, 'K'), (1, 'u', 2, 'K'), (3, 'u', 2, 'K'), (2, 'a', 3, 'K'),
             (0, NULL, 2, 'R'), (1, NULL, 2, 'R'), (2, NULL, 3, 'R'), (3, NULL, 2, 'R'),
             (0, NULL, 0, 'D'), (1, NULL, 1, 'D'), (2, NULL, 2, 'D'), (3, NULL, 3, 'D')
    ), walk AS (
      SELECT DISTINCT talk, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, '' AS repaired FROM rows_
      UNION ALL
      SELECT talk, i, q, new_cost, new_audit, new_repaired FROM (
        SELECT w.talk, r.i, e.q,
               w.cost + 3 * n.k + CASE e.letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN r.truncated AND e.letter <> 'D' THEN 3 ELSE 0 END AS new_cost,
               w.audit || n.letters || e.letter AS new_audit,
               w.repaired || replace(replace(n.made, 'U', chr(10) || 'user:'), 'A', chr(10) || 'assistant:') ||
                 CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text
                      ELSE chr(10) || CASE e.q WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || r.text END AS new_repaired
        FROM walk w JOIN rows_ r ON r.talk = w.talk AND r.i = w.i + 1 JOIN inserts n ON n.p = w.q
        JOIN edits e ON e.s = n.s AND (e.initial IS NULL OR e.initial = r.initial) AND (e.letter = 'D' OR NOT (r.blank OR r.again)))
      QUALIFY row_number() OVER (PARTITION BY talk, q ORDER BY new_cost, new_audit) = 1
    ), ended AS (
      SELECT w.talk, w.cost + 3 * CASE w.q WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS cost,
             w.audit || CASE w.q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
             w.repaired || CASE w.q WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END AS repaired
      FROM walk w JOIN (SELECT talk, max(i) AS n FROM rows_ GROUP BY talk) l ON l.talk = w.talk AND l.n = w.i
    ), ends AS (
      SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY talk ORDER BY cost, audit) = 1
    ), counts AS (
      SELECT talk, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
             count(*) FILTER (again) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
      FROM rows_ GROUP BY talk
    )
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
           sha256(coalesce(substr(repaired, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, talk FROM keyed) c LEFT JOIN counts USING (talk) LEFT JOIN ends USING (talk)
    """


@REGISTRY.add("op11_repair", _SQL)
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = report(damaged(rows)).withColumnRenamed("conv_id", "found")
    keys = rows.select("conv_id").distinct()
    numbers = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    texts = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return keys.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left").select("conv_id", *numbers, *texts)

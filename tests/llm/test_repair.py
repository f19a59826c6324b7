"""Conversation repair against a search over all edits, and the query against its SQL on odd rows."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from check import compare
from flightloom.llm import repair as R

TALKS = "conv_id long, turn long, role string, text string, talk string, digest string, place string, span string, copies string"
LEGAL = re.compile("(s?(ua)+)?")


def judged(rows):
    """Rows in order as (role, text, fault)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out = set(), []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        if not words:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if words[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def slow_repair(rows):
    """Least cost, then least letters, of every choice of edits, with up to two turns put in at each place."""
    rows = judged(rows)
    best = None
    made = [[(0, "", "", [])]] + [[(3 * n, "I" * n, roles, [f"{STATES[c]}:" for c in roles])] for n in (1, 2) for roles in ("ua", "au", "u", "a") if len(roles) == n]
    inserts = [x for group in made for x in group]
    choices = []
    for role, text, fault in rows:
        extra = 3 * (fault == "truncated")
        ways = [(4, "D", "", [])]
        if fault in ("", "truncated"):
            ways += [(extra, "K", role[:1], [f"{role}:{text}"]), *((3 + extra, "R", c, [f"{STATES[c]}:{text}"]) for c in "ua")]
        choices += [inserts, ways]
    for edits in itertools.product(*choices, inserts):
        initials = "".join(e[2] for e in edits)
        if LEGAL.fullmatch(initials):
            found = sum(e[0] for e in edits), "".join(e[1] for e in edits), "\n".join(t for e in edits for t in e[3])
            best = min(best or found, found)
    return best


STATES = {"u": "user", "a": "assistant"}


def talk(rng, n):
    texts = ["", " \t", "Yes.", "No", "What is it? ", "Well", "Fine!", "a\nb"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", " "]
    return [(rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_report_equals_slow_search(spark):
    rng = random.Random(5)
    talks = {i: talk(rng, rng.randrange(1, 5)) for i in range(150)}
    rows = [(i, *r, "x", "x", "x", "x", "x") for i, t in talks.items() for r in t]
    for r in R.report(spark.createDataFrame(rows, TALKS).repartition(5)).collect():
        cost, audit, text = slow_repair(talks[r.conv_id])
        faults = [f for _, _, f in judged(talks[r.conv_id])]
        initials = [role[:1] for role, _, _ in judged(talks[r.conv_id])]
        turns = [t for t, _, _ in talks[r.conv_id] if t is not None]
        assert (r.cost, r.audit) == (cost, audit), talks[r.conv_id]
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_blocks_and_halves_give_the_plain_way(monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rng = random.Random(block)
    kinds = [(i, t, g) for i in "suax " for t in (False, True) for g in (False, True) if not (t and g)]
    for _ in range(60):
        rows = [rng.choice(kinds) for _ in range(rng.randrange(1, 40))]
        tables = [R.row_table(*k) for k in rows]
        cost, last = R.ending(R.combined(tables))
        between = R.crossings(R._blocks(tables), 0, last)
        letters = ""
        for b, low in enumerate(range(0, len(rows), block)):
            states = R.crossings(tables[low : low + block], between[b], between[b + 1])
            letters += "".join(R.row_edits(*k)[p, q][1] for k, p, q in zip(rows[low : low + block], states[:-1], states[1:], strict=True))
        plain = {0: (0, "")}
        for kind in rows:
            step = {}
            for p, (c, done) in plain.items():
                for (a, q), (more, edit) in R.row_edits(*kind).items():
                    if a == p:
                        step[q] = min(step.get(q, (c + more, done + edit)), (c + more, done + edit))
            plain = step
        assert (cost, letters) == min((c + 3 * R.MISSING[q], done) for q, (c, done) in plain.items())


def odd_rows(rng):
    rows = []
    for i in range(60):
        n = rng.choice([0, 1, 3, 8, 40])
        for k in range(n):
            turn = None if rng.random() < 0.05 else k + (rng.random() < 0.1)
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[k % 2]
            rows.append((None if i == 7 else i, turn, None if rng.random() < 0.03 else role, rng.choice([None, "", "Ünïc. ", "Yes.", f"word {rng.randrange(99)}!"])))
    rows += [(500, 3, "user", "The same.")] * 60 + [(501, k, "user", "The same.") for k in range(60)]
    return [(*r, "x", "x", "x", "x", "x") for r in rows]


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    for name, rows in (("odd", odd_rows(random.Random(2))), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, TALKS).repartition(3).write.parquet(f"{folder}/conversations.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
        said = compare(spark, con, "op11", R.op11_repair, R._SQL, folder)
        assert said.startswith("ok" if rows else "ok 0 rows"), said


def test_repaired_turns_are_sound(spark):
    rng = random.Random(9)
    rows = [(i, *r, "x", "x", "x", "x", "x") for i in range(40) for r in talk(rng, 6)]
    seq = R.sequence(spark.createDataFrame(rows, TALKS))
    edited = R.edits(seq, R.plan(seq))
    talks = {}
    for r in sorted(R.repaired(edited).collect(), key=lambda r: (r.talk, r.place, r.part)):
        talks[r.talk] = talks.get(r.talk, "") + r.role[0]
    assert talks and all(LEGAL.fullmatch(t + "a" * (t[-1] == "u") + "ua" * (t[-1] == "s")) for t in talks.values())

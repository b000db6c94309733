"""Conversation structure repair against a plain automaton and against its SQL."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import conversations as conv
from corpusloom.llm import queries

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain(symbols):
    """The cheapest cost and the least audit, by states alone."""
    moves = {"0": ("u",), "s": ("u",), "u": ("a",), "a": ("u",)}
    best = {"0": (0, "")}

    def inserted(now):
        for _ in range(2):
            for q, (c, w) in list(now.items()):
                for r in moves[q]:
                    now[r] = min(now.get(r, (1 << 40, "")), (c + 2, w + "I"))
        return now

    for x in symbols:
        after = {}

        def put(q, c, w):
            after[q] = min(after.get(q, (1 << 40, "")), (c, w))

        for q, (c, w) in inserted(best).items():
            put(q, c + 3, w + "D")
            if x == "x":
                continue
            cut = x.isupper()
            if x.lower() in moves[q] or q == "0" and x.lower() == "s":
                put(x.lower(), c + cut, w + "K")
            put(moves[q][0], c + cut + 2, w + "R")
        best = after
    return min(v for q, v in inserted(best).items() if q in "0a")


def test_alignment_equals_automaton():
    rng = random.Random(5)
    for n in [0, 1, 2, 3, 5, 9, 14, 40]:
        for _ in range(150 if n < 20 else 10):
            s = "".join(rng.choice("ssuuaaoxSUAO") for _ in range(n))
            cost, audit, _ = conv.repair(s)
            assert (cost, audit) == plain(s), s


def test_segments_join_up():
    """Costs from state to state, added up from the end, then traced segment by segment, give the audit of the whole."""
    rng = random.Random(6)
    for _ in range(60):
        s = "".join(rng.choice("suauauaoxUA") for _ in range(rng.randrange(4, 60)))
        cuts = sorted(rng.sample(range(1, len(s)), 3))
        parts = [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)])]
        ends = [conv.END]
        for p in reversed(parts[1:]):
            line = conv.costs(p)
            ends.append(tuple(min(line[4 * e + q] + ends[-1][q] for q in range(4)) for e in range(4)))
        state, audit = conv.START, ""
        for p, end in zip(parts, reversed(ends)):
            _, some, state = conv.repair(p, state, end)
            audit += some
        assert audit == plain(s)[1], s


def repaired(spark, rows):
    report, turns = conv.repaired(conv.damaged(rows), also=rows)
    found = report.join(conv.digests(turns), "k", "left")
    return found.select(*COLUMNS[:-1], F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")), turns


def by_sql(rows):
    con = duckdb.connect()
    con.register("conversations", rows.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    return sorted(map(str, con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.CONVERSATIONS_SQL})").fetchall()))


def test_hot_conversation(spark):
    """One conversation over many partitions and segments, with repeated and equal rows, beside short ones."""
    rng = random.Random(7)
    rows = [(1, k // 2 if k % 9 == 0 else k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "No", f"text {k}.", "", "a! \n"])) for k in range(1_500)]
    rows += [(i, t, ["user", "assistant"][t % 2], f"turn {t} of {i}.") for i in range(2, 30) for t in range(6)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    found, turns = repaired(spark, frame)
    assert sorted(str(tuple(r)) for r in found.collect()) == by_sql(frame)
    assert turns.filter("NOT whole").select("k", "part", "seg").distinct().count() > 5


def test_awkward(spark):
    """Null ids, turns, roles and texts, odd roles, long texts, columns of other names, and conversations that lose every turn."""
    rows = [(None, None, None, None), (None, 3, "", "."), (5, None, "user", "x" * 50_000 + "."), (5, None, "tool", "?"), (5, 2, "Assistant", " \t"), (6, 1 << 62, "user", "é!"), (6, -5, "assistant", "漢")]
    rows += [(i, 0, "user", "Only one turn.") for i in range(100, 160)] + [(6, -5, "assistant", "漢")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    other = frame.select("*", *(F.create_map(F.lit("k"), F.lit(1)).alias(c) for c in ("k", "key", "part", "seg", "fault", "digest", "salt", "__fault", "dotted.name")))
    found, _ = repaired(spark, other)
    got = [tuple(r) for r in found.collect()]
    assert sorted(map(str, got)) == by_sql(frame)
    lost = [r for r in got if r[6] == 0 and r[7] == ""]
    assert lost and all(r[8] == hashlib.sha256(b"").hexdigest() for r in lost)
    assert repaired(spark, frame.filter("false"))[0].count() == 0


@pytest.mark.parametrize("part", range(2))
def test_repaired_turns(spark, part):
    """What is stored obeys the grammar."""
    rows = spark.createDataFrame([(i, t, ["system", "user", "user", "assistant", "tool"][(i * 7 + t * t + part) % 5], f"t{t % 4}") for i in range(40) for t in range(i % 7)], "conv_id long, turn long, role string, text string")
    _, turns = conv.repaired(rows)
    whole = {}
    for r in turns.orderBy("k", "part", "seg").collect():
        whole[r["k"]] = whole.get(r["k"], "") + "".join(x[0] for x in r["roles"])
    import re

    assert whole and all(re.fullmatch("(s?(ua)+)?", x) for x in whole.values())

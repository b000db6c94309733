"""Conversation structure repair: each conversation is aligned to the alternating grammar `(s?(ua)+)?`.

Roles count by their first letter. An edit of a turn is Keep (0), Rerole to user or assistant (2) or Delete (3; blank turns
and repeats must go); Insert puts an empty turn of user or assistant anywhere (2); a truncated turn that stays adds 1. The audit
is the cheapest sequence of edits' first letters, of several the least in ASCII.

Method: Wagner-Fischer tables of the turns against the grammar's strings. The strings of all lengths that share a beginning
share a table, whose last row has the cost of each length. A table is computed within an Ukkonen band: a cell d places off the
diagonal costs 2 d or more, so cells further off than the incumbent (first the repair by rerolling alone, then the best
length so far) are left out, and so are all lengths outside the band. Each cheapest length is traced back, and the audits are compared.

Turns are range-partitioned by conversation and turn, so a conversation of any size lies in many tasks, and cut into
segments of SEGMENT turns. Conversations that lie within a partition and a segment are repaired there. For the others each segment's table gives
the costs from every state of the grammar to every other; these are added up from the end, each segment is traced for every state
it may begin in, and a last walk picks one. What meets in one task there has a letter a turn, as has the audit itself.
No turn's text is shuffled again, but those of cut conversations when `digests` streams through them.

Defined cases: null ids form a conversation of their own; null roles and texts are one space; turns without a number come
first; turns of one number go by role, then by the MD5 of the text, so repeated rows stand side by side; ids that
`also` names without a turn get zeros and an empty audit; other columns, of any name, play no part.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, written

SEGMENT, SEGMENT_CHARS, SLACK = 128, 1 << 22, 8
KEEP, REROLE, DELETE, INSERT, CUT, FAR = 0, 2, 3, 2, 1, 1 << 40
#: The states of the grammar: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The costs at which a conversation may end in each state.
END = (0, FAR, FAR, 0)
#: What inserts alone cost from state to state.
MOVE = ((0, FAR, 2, 4), (FAR, 0, 2, 4), (FAR, FAR, 0, 2), (FAR, FAR, 2, 0))
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {"u": "user", "a": "assistant"}


def strings(state: int) -> list[str]:
    """How the grammar's strings go on from a state: beginnings, before `uaua...` or `auau...`."""
    return ["", "s"] if state == START else [""]


def letter(state: int, first: str, place: int) -> str:
    """The letter at a place of such a string."""
    if place < len(first):
        return first[place]
    return "ua"[(place - len(first) + (state == USER)) % 2]


def after(state: int, first: str, length: int) -> int:
    return STATE[letter(state, first, length - 1)] if length else state


def rerolled(rows: str, state: int) -> tuple[int, int]:
    """The cost of a repair by rerolling alone, and the state it ends in."""
    cost = 0
    for x in rows:
        low = x.lower()
        want = "s" if state == START and low == "s" else NEXT[state]
        cost += (low != want) * REROLE + x.isupper() * CUT
        state = STATE[want]
    return cost, state


class Table:
    """The Wagner-Fischer table of rows against a string of the grammar, `reach` places to either side of the diagonal."""

    def __init__(self, rows: str, state: int, first: str, reach: int):
        self.rows, self.state, self.first, self.reach = rows, state, first, reach
        width = 2 * reach + 1
        self.letters = [letter(state, first, j) for j in range(len(rows) + reach)]
        line = [FAR] * width
        line[reach] = 0
        self.lines = [line]
        self._inserts(line, 0)
        for i, x in enumerate(rows, 1):
            before, line = line, [FAR] * width
            low, cut = x.lower(), x.isupper() * CUT
            for d in range(max(0, reach - i), width):
                j = i + d - reach
                best = before[d + 1] + DELETE if d + 1 < width else FAR
                if j:
                    want = self.letters[j - 1]
                    if low == want:
                        best = min(best, before[d] + cut)
                    elif want != "s":
                        best = min(best, before[d] + REROLE + cut)
                    if d and want != "s":
                        best = min(best, line[d - 1] + INSERT)
                line[d] = best
            self.lines.append(line)

    def _inserts(self, line: list[int], i: int) -> None:
        for d in range(self.reach + 1, len(line)):
            if self.letters[i + d - self.reach - 1] != "s":
                line[d] = min(line[d], line[d - 1] + INSERT)

    def cost(self, i: int, j: int) -> int:
        d = j - i + self.reach
        return self.lines[i][d] if 0 <= d <= 2 * self.reach and j >= 0 else FAR

    def lengths(self):
        """(length, cost) of each string within the band."""
        n = len(self.rows)
        for j in range(max(0, n - self.reach), n + self.reach + 1):
            if self.cost(n, j) < FAR:
                yield j, self.cost(n, j)

    def steps(self, i: int, j: int):
        """The edits that lead to a cell at its cost, as (letter, i, j) of where they come from."""
        here = self.cost(i, j)
        if i and self.cost(i - 1, j) + DELETE == here:
            yield "D", i - 1, j
        if j and self.letters[j - 1] != "s" and self.cost(i, j - 1) + INSERT == here:
            yield "I", i, j - 1
        if i and j:
            x, want = self.rows[i - 1], self.letters[j - 1]
            kept = x.lower() == want
            if (kept or want != "s") and self.cost(i - 1, j - 1) + (KEEP if kept else REROLE) + x.isupper() * CUT == here:
                yield "K" if kept else "R", i - 1, j - 1

    def audit(self, length: int, forced: list[int]) -> str:
        """The least of the cheapest audits to a length. forced: how many turns that must go stand before each row, and at last."""
        ways: dict[tuple[int, int], list[tuple[str, int, int]]] = {}
        open_ = [(len(self.rows), length)]
        known = set(open_)
        while open_:
            i, j = open_.pop()
            for edit, a, b in self.steps(i, j):
                ways.setdefault((a, b), []).append((edit, i, j))
                if (a, b) not in known:
                    known.add((a, b))
                    open_.append((a, b))
        i = j = 0
        out = ["D" * forced[0]]
        while (i, j) != (len(self.rows), length):
            edit, a, j = min(ways[i, j])
            out.append(edit)
            if a > i:
                out.append("D" * forced[a])
            i = a
        return "".join(out)


def _forced(symbols: str) -> tuple[str, list[int]]:
    """The rows that may stay, and how many others stand before each and at last."""
    parts, counts = [], [0]
    for x in symbols:
        if x == "x":
            counts[-1] += 1
        else:
            parts.append(x)
            counts.append(0)
    return "".join(parts), counts


def repair(symbols: str, state: int = START, end: tuple[int, ...] = END) -> tuple[int, str, int]:
    """(cost with that of the end, audit, state at the end) of turns: s, u, a, o (any other), capitals if truncated, x if it
    must go."""
    rows, forced = _forced(symbols)
    low = sum(x.isupper() for x in rows) * CUT + min(end)
    cost, last = rerolled(rows, state)
    incumbent = cost + min(m + e for m, e in zip(MOVE[last], end))
    best: list[tuple[str, int]] = []
    for first in strings(state):
        table = Table(rows, state, first, (incumbent - low) // 2)
        for length, cost in table.lengths():
            stop = after(state, first, length)
            if length < len(first) or cost + end[stop] > incumbent:
                continue
            if cost + end[stop] < incumbent:
                incumbent, best = cost + end[stop], []
            best.append((table.audit(length, forced), stop))
    audit, stop = min(best)
    return incumbent + DELETE * sum(forced), audit, stop


def costs(symbols: str) -> list[int]:
    """The cost of a segment from each state to each, line by line. Those over SLACK more than the least of their line may be
    too high: states differ by 6 at most in what is still to pay, so no cheapest repair takes them."""
    rows, forced = _forced(symbols)
    truncated = sum(x.isupper() for x in rows) * CUT
    out = []
    for state in range(4):
        line = [FAR] * 4
        for first in strings(state):
            table = Table(rows, state, first, (rerolled(rows, state)[0] + SLACK - truncated) // 2)
            for length, cost in table.lengths():
                if length >= len(first):
                    stop = after(state, first, length)
                    line[stop] = min(line[stop], cost + DELETE * sum(forced))
        out += line
    return out


_repaired = lru_cache(1 << 17)(repair)


def applied(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts of the repaired turns."""
    out_roles, out_texts, i = [], [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            out_roles.append(roles[i])
            state = STATE[roles[i][:1]]
        else:
            out_roles.append(ROLE[NEXT[state]])
            state = STATE[NEXT[state]]
        out_texts.append("" if edit == "I" else texts[i])
        i += edit != "I"
    return out_roles, out_texts


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (key, turn, role, text) as a faulty export has them, by the CRC-32 of `key:turn` modulo 20: 0 is lost, 1 has no
    text, 2 no `.!?`, 3 comes twice, 4 is the user's."""
    blank = F.lit(" ")
    label = F.concat(F.coalesce(named(key).cast("string"), blank), F.lit(":"), F.coalesce(named(turn).cast("string"), blank))
    own = rows.select(named(key).alias(key), named(turn).alias(turn), F.coalesce(named(role).cast("string"), blank).alias(role), F.coalesce(named(text).cast("string"), blank).alias(text), (F.crc32(label) % 20).alias("__fault"))
    fault = F.col("__fault")
    changed = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(named(text), "[.!?]", "")).otherwise(named(text))
    some = own.filter(fault != 0).withColumns({text: changed, role: F.when(fault == 4, "user").otherwise(named(role))})
    return some.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1)))).drop("__fault", "__copy")


def _key_id(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


FACTS = "k string, part int, seg int, open boolean, digests array<string>, initials string, faults string, least long, most long, turns long, first_turn long, last_turn long, illegal long, cost long, audit string, roles array<string>, texts array<string>"


class _Segment:
    def __init__(self, part: int, seg: int, key, k: str):
        self.part, self.seg, self.key, self.k, self.size = part, seg, key, k, 0
        self.rows: list[tuple] = []

    def add(self, turn, role, text, digest, fault) -> None:
        self.rows.append((turn, role, text, digest, fault))
        self.size += len(text)

    @property
    def full(self) -> bool:
        return len(self.rows) >= SEGMENT or self.size >= SEGMENT_CHARS

    def facts(self, open_: bool) -> dict:
        turns, roles, texts, digests, faults = map(list, zip(*self.rows))
        initials = [r[:1] for r in roles]
        numbered = [t for t in turns if t is not None]
        out = {
            "key": self.key, "k": self.k, "part": self.part, "seg": self.seg, "open": open_, "digests": digests if open_ else None,
            "initials": "".join(x if len(x) == 1 else "-" for x in initials), "faults": marked(digests, faults, set()),
            "least": min(numbered, default=None), "most": max(numbered, default=None), "turns": len(set(numbered)),
            "first_turn": numbered[0] if numbered else None, "last_turn": numbered[-1] if numbered else None,
            "illegal": sum(pair not in LEGAL for pair in zip(initials, initials[1:])), "cost": None, "audit": None, "roles": roles, "texts": texts,
        }
        if not open_:
            out["cost"], out["audit"], _ = _repaired(symbols(out["initials"], out["faults"]))
            out["roles"], out["texts"] = applied(out["audit"], START, roles, texts)
        return out


def marked(digests: list[str], faults: list[str], seen: set[str]) -> str:
    """A letter for each turn's first fault: b(lank), d(uplicate), t(runcated) or none (.)."""
    out = []
    for digest, fault in zip(digests, faults):
        out.append("d" if fault != "b" and digest in seen else fault)
        seen.add(digest)
    return "".join(out)


def symbols(initials: str, faults: str) -> str:
    kinds = (x if x in "sua" else "o" for x in initials)
    return "".join("x" if f in "bd" else k.upper() if f == "t" else k for k, f in zip(kinds, faults))


def _cut(batches):
    """Segments of a partition's ordered turns. Those of its first and last conversation, and of any that has several, are open."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, schema = TaskContext.get().partitionId(), None
    seg, held, ready, first, several = 0, None, [], None, False  # several: the conversation at hand has an earlier segment

    def batch():
        out = pa.RecordBatch.from_pylist(ready, schema=schema)
        ready.clear()
        return out

    for given in batches:
        if schema is None:
            kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
            schema = pa.schema([("key", given.schema.field("key").type), *((n, kinds[t]) for n, t in (x.split() for x in FACTS.split(", ")))])
        columns = [given.column(given.schema.get_field_index(c)).to_pylist() for c in ("key", "k", "turn", "role", "text", "digest", "fault")]
        for key, k, *row in zip(*columns):
            other = held is None or held.k != k
            if held is not None and (other or held.full):
                ready.append(held.facts(several or not other or held.k == first))
                several, held = not other, None
                if len(ready) >= 1_000 or ready[-1]["open"]:
                    yield batch()
            if held is None:
                held = _Segment(part, seg, key, k)
                first, seg = k if first is None else first, seg + 1
            held.add(*row)
    if held is not None:
        ready.append(held.facts(True))
    if ready:
        yield batch()


def segments(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations' turns in order, in segments; conversations that are whole are repaired."""
    blank = F.lit(" ")
    own = rows.select(named(key).alias("key"), _key_id(named(key)).alias("k"), named(turn).cast("long").alias("turn"), F.coalesce(named(role).cast("string"), blank).alias("role"), F.coalesce(named(text).cast("string"), blank).alias("text"))
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "b").when(whole, ".").otherwise("t")
    own = own.withColumns({"digest": F.concat(F.md5("text"), "role"), "fault": fault, "salt": F.monotonically_increasing_id()})
    order = ["k", "turn", "role", "digest", "salt"]  # a salt, so that even equal rows can be parted
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.drop("salt").mapInArrow(_cut, f"key {own.schema['key'].dataType.simpleString()}, {FACTS}")


def _summed(frames):
    for f in frames:
        f["faults"] = [marked(list(d), list(x), set(s) if s is not None else set()) for d, x, s in zip(f["digests"], f["faults"], f["seen"])]
        f["symbols"] = [symbols(i, x) for i, x in zip(f["initials"], f["faults"])]
        f["costs"] = [costs(s) for s in f["symbols"]]
        yield f.drop(columns=["digests", "seen"])


def _to_pay(f):
    """What is to pay behind each segment, from each state."""
    import pandas as pd

    end, out = END, []
    for r in f.sort_values(["part", "seg"], ascending=False).itertuples():
        out.append((r.k, r.part, r.seg, list(end)))
        end = tuple(min(r.costs[4 * s + q] + end[q] for q in range(4)) for s in range(4))
    return pd.DataFrame(out, columns=["k", "part", "seg", "end"])


def _traced(frames):
    for f in frames:
        found = [[repair(s, state, tuple(end)) for state in range(4)] for s, end in zip(f["symbols"], f["end"])]
        f["audits"] = [[x[1] for x in row] for row in found]
        f["states"] = [[x[2] for x in row] for row in found]
        yield f[["k", "part", "seg", "audits", "states"]]


def _walked(f):
    """The state in which each segment of a conversation begins, its audit, and its illegal pair with the segment before."""
    import pandas as pd

    state, last, out = START, None, []
    for r in f.sort_values(["part", "seg"]).itertuples():
        pair = last is not None and (last, r.initials[:1]) not in LEGAL
        out.append((r.k, r.part, r.seg, state, r.audits[state], int(pair)))
        state, last = r.states[state], r.initials[-1:]
    return pd.DataFrame(out, columns=["k", "part", "seg", "state", "audit", "joint"])


def repaired(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables. Conversations: key, gaps, blank, duplicate, truncated, illegal, cost and audit; also those of `also` (with the
    column key). Turns: k (names the conversation), part, seg, whole (nothing else belongs to it), and roles and texts, the
    repaired turns in order of (part, seg)."""
    found = written(segments(rows, key, turn, role, text), "conversation-segments")
    closed = found.filter("NOT open").select("key", "k", "least", "most", "turns", "illegal", "faults", "cost", "audit")
    at, open_ = ["k", "part", "seg"], found.filter("open")
    each = open_.select(*at, F.explode(F.array_distinct("digests")).alias("digest"))
    first = each.groupBy("k", "digest").agg(F.min(F.struct("part", "seg")).alias("first"))
    seen = each.join(first, ["k", "digest"]).filter(F.struct("part", "seg") > F.col("first")).groupBy(*at).agg(F.collect_list("digest").alias("seen"))
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism  # segments are small, but take time
    narrow = open_.select(*at, "digests", "initials", "faults").join(seen, at, "left").repartition(tasks, *at)
    blocks = narrow.mapInPandas(_summed, "k string, part int, seg int, initials string, faults string, symbols string, costs array<long>")
    blocks = written(blocks.join(open_.select(*at, "turns", "illegal", "least", "most", "first_turn", "last_turn", "key"), at), "conversation-blocks")
    to_pay = blocks.select(*at, "costs").groupBy("k").applyInPandas(_to_pay, "k string, part int, seg int, end array<long>")
    traced = blocks.select(*at, "symbols").join(to_pay, at).repartition(tasks, *at).mapInPandas(_traced, "k string, part int, seg int, audits array<string>, states array<int>")
    walked = blocks.select(*at, "initials").join(traced, at).groupBy("k").applyInPandas(_walked, "k string, part int, seg int, state int, audit string, joint int")
    walked = written(walked, "conversation-audits")
    joined = blocks.join(walked, at)
    cost_of = F.udf(lambda audit, faults: audit_cost(audit, faults), "long")
    sums = joined.groupBy("k").agg(
        F.first("key").alias("key"), F.min("least").alias("least"), F.max("most").alias("most"), F.count("*").alias("n"), F.sum(F.col("illegal") + F.col("joint")).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seg", "faults"))), lambda x: x["faults"]), "").alias("faults"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seg", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    # a number that goes on in the next segment is counted in both, and stands at an end of both
    again = blocks.select("k", F.explode(F.array_distinct(F.array("first_turn", "last_turn"))).alias("turn")).filter("turn IS NOT NULL").groupBy("k", "turn").agg((F.count("*") - 1).alias("more")).groupBy("k").agg(F.sum("more").alias("more"))
    counted = blocks.groupBy("k").agg(F.sum("turns").alias("turns"))
    cut = sums.join(counted, "k").join(again, "k", "left").withColumn("turns", F.col("turns") - F.coalesce("more", F.lit(0)))
    cut = cut.withColumn("cost", cost_of("audit", "faults")).select("key", "k", "least", "most", "turns", "illegal", "faults", "cost", "audit")
    whole = closed.unionByName(cut)
    count = lambda fault: F.length(F.regexp_replace("faults", f"[^{fault}]", "")).cast("long").alias({"b": "blank", "d": "duplicate", "t": "truncated"}[fault])
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    report = whole.select(F.col("key").alias(key), "k", gaps, count("b"), count("d"), count("t"), F.col("illegal").cast("long").alias("illegal"), F.col("cost").cast("long").alias("cost"), "audit")
    if also is not None:
        none = also.select(named(key).alias(key), _key_id(named(key)).alias("k")).distinct().join(report.select("k"), "k", "left_anti")
        zeros = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        report = report.unionByName(none.select(key, "k", *zeros, F.lit("").alias("audit")))

    @F.udf("struct<roles:array<string>,texts:array<string>>")
    def edited(audit, state, roles, texts):
        return applied(audit, state, roles, texts)

    mine = open_.select(*at, "roles", "texts").join(walked.select(*at, "state", "audit"), at).withColumn("new", edited("audit", "state", "roles", "texts"))
    turns = found.filter("NOT open").select(*at, F.lit(True).alias("whole"), "roles", "texts").unionByName(mine.select(*at, F.lit(False).alias("whole"), "new.roles", "new.texts"))
    return report, turns


def audit_cost(audit: str, faults: str) -> int:
    """What an audit costs over turns with the given faults."""
    rows, total = iter(faults), 0
    for edit in audit:
        fault = next(rows) if edit != "I" else "."
        total += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (CUT if edit in "KR" and fault == "t" else 0)
    return total


def _streamed(batches):
    """The SHA-256 of each conversation, whose pieces follow one another; nothing but its state is kept."""
    import pyarrow as pa

    k, state, any_, out = None, None, False, []
    for b in batches:
        for name, roles, texts in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("k", "roles", "texts"))):
            if name != k:
                if k is not None:
                    out.append({"k": k, "sha256": state.hexdigest()})
                k, state, any_ = name, hashlib.sha256(), False
            for role, text in zip(roles, texts):
                state.update(f"{chr(10) if any_ else ''}{role}:{text}".encode())
                any_ = True
    if k is not None:
        out.append({"k": k, "sha256": state.hexdigest()})
    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("k", pa.string()), ("sha256", pa.string())]))


def digests(turns: DataFrame) -> DataFrame:
    """k and sha256 of each conversation's repaired turns, `role:text` by lines. A cut conversation streams through one task: SHA-256
    takes its bytes in order."""
    lines = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"]))
    whole = turns.filter("whole").select("k", F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))
    cut = turns.filter("NOT whole").select("k", "part", "seg", "roles", "texts").repartition("k").sortWithinPartitions("k", "part", "seg")
    return whole.unionByName(cut.drop("part", "seg").mapInArrow(_streamed, "k string, sha256 string"))

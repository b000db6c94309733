"""Packing by cutting stock with column generation.

A document's ids (with an end id) are cut into whole sequences and a rest. The rests are counted in classes
of `unit` ids. A linear program over patterns (how many rests of each class share a sequence) is solved by
column generation: a knapsack by dynamic programming prices new patterns. The solution is rounded down, what
is left over is packed by first fit, and the patterns' places are given to the rests by their rank within a class.

What reaches the driver is counts of (cell, class), at most `MAX_CELLS` * 2048 / unit of them. Ranks are row
numbers within cells (dealt by address) plus the counts of earlier cells, so no class, key or repeated row lands in one task.
Ids are never shuffled: a piece is (document, start, length), and `sequences` joins ids to places if wanted.

Defined cases: a null or empty text is a document of the end id alone; an empty table gives an empty plan;
rows with equal or null ids are packed each by itself; an id keeps its type and value (it passes through Arrow as it is);
other columns are left out of the plan.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.addresses import addressed
from .common import cell, named, of_row, texts
from .wordbpe import word_ids

LENGTH, UNIT, END_ID, MAX_CELLS = 2048, 16, 1, 4096


def knapsack(values: np.ndarray, widths: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items (of any count) within room; negative values are left out."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        fits = widths <= r
        if fits.any():
            gains = np.where(fits, best[np.maximum(r - widths, 0)] + values, -np.inf)
            k = int(gains.argmax())
            if gains[k] > best[r] + 1e-12:
                best[r], took[r] = gains[k], k
    counts, r = np.zeros(len(widths), dtype=np.int64), room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            counts[took[r]] += 1
            r -= int(widths[took[r]])
    return float(best[room]), counts


def cutting_stock(demand: dict[int, int], room: int, rounds: int = 3000) -> list[tuple[dict[int, int], int]]:
    """[(pattern: width -> items, copies)], together exactly the demand (width -> items, widths 1 to room)."""
    widths = np.array(sorted(w for w, n in demand.items() if n > 0), dtype=np.int64)
    if not len(widths):
        return []
    need = np.array([demand[int(w)] for w in widths], dtype=float)
    basis = np.diag(room // widths).astype(float)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(widths)))
        value, counts = knapsack(prices, widths, room)
        if value <= 1 + 1e-7:
            break
        amounts, change = np.linalg.solve(basis, need), np.linalg.solve(basis, counts.astype(float))
        up = np.flatnonzero(change > 1e-9)
        leaves = up[np.argmin(np.maximum(amounts[up], 0) / change[up])]
        basis[:, leaves] = counts
    amounts = np.linalg.solve(basis, need)
    plan, left = [], need.astype(np.int64)
    for k in np.argsort(-amounts):
        column_ = basis[:, k].astype(np.int64)
        used = column_ > 0
        copies = min(int(np.floor(amounts[k] + 1e-9)), int((left[used] // column_[used]).min()))
        if copies > 0:
            plan.append(({int(w): int(n) for w, n in zip(widths[used], column_[used])}, copies))
            left -= column_ * copies
    bins: list[list] = []  # room left and pattern: fewer than the patterns' items, whatever the demand
    for w, n in sorted(zip(widths.tolist(), left.tolist()), reverse=True):
        for _ in range(n):
            for b in bins:
                if b[0] >= w:
                    break
            else:
                bins.append(b := [room, {}])
            b[0] -= w
            b[1][w] = b[1].get(w, 0) + 1
    return plan + [(b[1], 1) for b in bins]


@dataclass
class Places:
    """Where the rest of each rank of a class goes: arrays by class."""

    first: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    base: dict[int, np.ndarray]
    sequences: int

    @classmethod
    def of(cls, plan: list[tuple[dict[int, int], int]]) -> Places:
        rows: dict[int, list] = {}
        at: dict[int, int] = {}
        base = 0
        for pattern, copies in plan:
            for c, n in pattern.items():
                rows.setdefault(c, []).append((at.get(c, 0), n, base))
                at[c] = at.get(c, 0) + n * copies
            base += copies
        by = {c: np.array(r, dtype=np.int64).T for c, r in rows.items()}
        return cls({c: x[0] for c, x in by.items()}, {c: x[1] for c, x in by.items()}, {c: x[2] for c, x in by.items()}, base)

    def sequence(self, c: int, ranks: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.first[c], ranks, side="right") - 1
        return self.base[c][k] + (ranks - self.first[c][k]) // self.each[c][k]


def tokenized(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """key, doc_tokens, crcs (of each piece: whole sequences, then the rest if any) and, if wanted, ids."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        encoder = word_ids(tokenizer_path)
        end, step = END_ID.to_bytes(4, "little"), 4 * LENGTH
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = [x + end for x in encoder.encode(list(texts(part)))]
                out = {
                    key: part.column(part.schema.get_field_index("__key")),
                    "doc_tokens": pa.array([len(x) // 4 for x in found], pa.int64()),
                    "crcs": pa.array([[zlib.crc32(x[i : i + step]) for i in range(0, len(x), step)] for x in found], pa.list_(pa.int64())),
                }
                if with_ids:
                    out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    own = docs.select(named(key).alias("__key"), named(text).cast("string").alias("text"))
    return own.mapInArrow(run, f"`{key}` {key_type}, doc_tokens long, crcs array<long>" + ", ids array<int>" * with_ids)


def packed(tokens: DataFrame, key: str = "doc_id", unit: int = UNIT, cells: int | None = None) -> DataFrame:
    """tokens: a written table of key, doc_tokens and crcs. One row for each piece. Cells go by the rows' addresses, so equal
    rows are spread over them."""
    n = tokens.count() if cells is None else 0
    cells = cells or min(MAX_CELLS, max(32, n // 100_000))
    rest = F.col("doc_tokens") % LENGTH
    own = addressed(tokens).select(of_row(key).alias("key"), of_row("doc_tokens").alias("doc_tokens"), of_row("crcs").alias("crcs"), "file", "place")
    rows = own.select("key", "doc_tokens", "crcs", "file", "place", cell(cells, "file", "place").alias("cell"), F.ceil(rest / unit).cast("int").alias("class"), F.floor(F.col("doc_tokens") / LENGTH).cast("long").alias("whole"))
    counts = rows.groupBy("cell", "class").agg(F.count("*").alias("n"), F.sum("whole").alias("whole")).toPandas().sort_values(["class", "cell"])
    demand = {int(c): int(x) for c, x in counts[counts["class"] > 0].groupby("class")["n"].sum().items()}
    places = Places.of(cutting_stock(demand, LENGTH // unit))
    counts["before"] = counts.groupby("class")["n"].cumsum() - counts["n"]
    before = {(int(a), int(b)): int(x) for a, b, x in zip(counts["cell"], counts["class"], counts["before"])}
    by_cell = counts.groupby("cell")["whole"].sum().sort_index()
    whole_before = {int(c): int(x) for c, x in (by_cell.cumsum() - by_cell).items()}
    order = ["file", "place"]
    within = Window.partitionBy("cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumns({"rank": F.row_number().over(Window.partitionBy("cell", "class").orderBy(*order)).cast("long") - 1, "wholes": F.coalesce(F.sum("whole").over(within), F.lit(0))})
    schema = tokens.schema[key].dataType.simpleString()

    def place(batches):
        import pyarrow as pa

        for b in batches:
            number = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            classes, cells_, whole, total = number("class"), number("cell"), number("whole"), number("doc_tokens")
            ranks = number("rank") + np.array([before[x] for x in zip(cells_.tolist(), classes.tolist())], dtype=np.int64)
            sequence = np.full(len(ranks), -1, dtype=np.int64)
            for c in np.unique(classes[classes > 0]):
                at = classes == c
                sequence[at] = places.sequence(int(c), ranks[at])
            start = places.sequences + number("wholes") + np.array([whole_before[c] for c in cells_.tolist()], dtype=np.int64)
            pieces = whole + (classes > 0)
            doc = np.repeat(np.arange(len(ranks)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            is_whole = nth < whole[doc]
            crcs = b.column(b.schema.get_field_index("crcs")).flatten()
            out = {
                "start": nth * LENGTH,
                "length": np.where(is_whole, LENGTH, total[doc] % LENGTH),
                "ids_crc32": crcs,
                "doc_tokens": total[doc],
                "sequence_id": np.where(is_whole, start[doc] + nth, sequence[doc]),
                "place": np.where(is_whole, 0, (classes.astype(np.int64) << 44)[doc] + ranks[doc]),
            }
            ids = b.column(0).take(pa.array(doc, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in out.values())], names=["key", *out])

    pieces = ranked.drop("file", "place").mapInArrow(place, f"key {schema}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("place").withColumnRenamed("key", key)


def sequences(plan: DataFrame, tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """sequence_id and its ids: tokens (with ids, one row for each key) joined to a plan. A sequence has at most LENGTH ids."""
    cut = plan.select(named(key).alias("key"), "sequence_id", "offset", "start", "length").join(tokens.select(named(key).alias("key"), "ids"), "key").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("part"))
    parts = cut.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["part"])).alias("ids"))

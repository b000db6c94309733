"""Resharding by minimum-cost flow.

Rows lie in old shards, in files of bucketed blocks (a block is a range of the text's hash, so equal texts
share one). From the old shards' sizes and the new shards' capacities, a minimum-cost flow (a byte that stays
costs nothing, a byte that moves costs one) says how many bytes go from each old shard to each new one. Whole
blocks are dealt out to follow the flow, then single blocks are moved to even out the rest. Files of which no
block moves stay where they are; the others are rewritten.

What reaches the driver is one size for each block (`blocks` of them, a parameter) and one count for each
(shard, cell). Slots are gapless by the counts of earlier cells plus a row number within the cell.

The operator works on whole rows in a column `row`, beside which its own columns stand, so no column of the table clashes.

Defined cases: a null text has size 1 and lies with the empty texts; an empty table gives no rows; equal texts
lie in one shard, so a text that outweighs a shard's share leaves that shard over it; rows with a null id and repeated
rows get slots of their own; other columns of any name are carried along in the files.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import nested, of_row, scratch, written

BLOCKS, BUCKETS = 16_384, 16


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """flow[i][j], which moves all supply within the capacities at the least sum of cost(i, j) * flow. Successive
    shortest paths (Bellman-Ford) over the shards, whose numbers are small."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are too small")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        # nodes: old shards 0 to n-1, new shards n to n+m-1
        far = [0 if x > 0 else float("inf") for x in left] + [float("inf")] * m
        came: list = [None] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] + cost(i, j) < far[n + j] - 1e-12:
                        far[n + j], came[n + j], changed = far[i] + cost(i, j), i, True
                    if flow[i][j] and far[n + j] - cost(i, j) < far[i] - 1e-12:
                        far[i], came[i], changed = far[n + j] - cost(i, j), n + j, True
            if not changed:
                break
        end = min((far[n + j], j) for j in range(m) if room[j] > 0)[1]
        path, at = [], n + end
        while came[at] is not None:
            path.append((came[at], at))
            at = came[at]
        amount = min([left[at], room[end], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[at] -= amount
        room[end] -= amount
    return flow


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def transfers(sizes: dict[tuple[int, int], int], shards: int, rounds: int = 2_000) -> dict[int, int]:
    """block -> new shard. sizes: (old shard, block) -> bytes; each block lies in one old shard. Old shard i is new
    shard i, if that exists."""
    by_old: dict[int, list] = {}
    for (old, block), size in sorted(sizes.items()):
        by_old.setdefault(old, []).append((block, size))
    olds = sorted(by_old)
    room = capacities(sum(sizes.values()), shards)
    flow = min_cost_flow([sum(s for _, s in by_old[o]) for o in olds], room, lambda i, j: 0 if olds[i] == j else 1)
    place: dict[int, int] = {}
    held = [0] * shards
    for o, wanted in zip(olds, flow):
        order = sorted((j for j in range(shards) if wanted[j]), key=lambda j: (j != o, j))
        quota = {j: wanted[j] for j in order}
        large = max(quota.values()) / 16 if quota else 0
        for block, size in sorted(by_old[o], key=lambda x: (x[1] <= large, -x[1] if x[1] > large else 0, x[0])):
            if size > large:  # a heavy block first, where most room is
                j = max(order, key=lambda k: (quota[k], -k))
            else:  # the rest in order of blocks, so that few files are cut
                while len(order) > 1 and quota[order[0]] < size / 2:
                    order.pop(0)
                j = order[0]
            place[block] = j
            quota[j] -= size
            held[j] += size
    inside: list[list] = [[] for _ in range(shards)]
    for (_, block), size in sizes.items():
        inside[place[block]].append((size, block))
    for x in inside:
        x.sort()
    for _ in range(rounds):
        high, low = max(range(shards), key=held.__getitem__), min(range(shards), key=held.__getitem__)
        gap = held[high] - held[low]
        k = bisect_left(inside[high], (gap / 2, -1))
        options = [x for x in inside[high][max(0, k - 1) : k + 1] if 0 < x[0] < gap]
        if not options:
            break
        size, block = min(options, key=lambda x: (abs(x[0] - gap / 2), x))
        inside[high].remove((size, block))
        inside[low].insert(bisect_left(inside[low], (size, block)), (size, block))
        held[high] -= size
        held[low] += size
        place[block] = low
    return place


def sized(docs: DataFrame, text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """row (all of docs), size, text_crc32 and block."""
    whole = F.coalesce(of_row(text).cast("string"), F.lit(""))
    return nested(docs).withColumns({"size": F.octet_length(whole).cast("long") + 1, "text_crc32": F.crc32(whole), "block": F.pmod(F.xxhash64(whole), F.lit(blocks)).cast("int")})


def laid_out(rows: DataFrame, shards: int, blocks: int = BLOCKS, buckets: int = BUCKETS, folder: str | None = None) -> DataFrame:
    """`rows` (from `sized`) as they lie, once written, in shards of block ranges, each of `buckets` files at least, with
    old_shard and bucket. folder: where they are to stay; else the table goes with the application."""
    span = shards * buckets
    unit = F.floor(F.col("block").cast("long") * span / blocks)
    path = folder or scratch(rows.sparkSession, "shards")
    placed = rows.withColumns({"old_shard": F.floor(unit / buckets).cast("int"), "bucket": F.pmod(unit, F.lit(buckets)).cast("int")})
    placed.hint("rebalance", "old_shard", "bucket").write.option("compression", "zstd").partitionBy("old_shard", "bucket").parquet(path)
    return rows.sparkSession.read.schema(placed.schema).parquet(path)


def resharded(old: DataFrame, shards: int, folder: str | None = None) -> DataFrame:
    """Plans and does the transfers from the layout `old` (from `laid_out`). All rows with `shard`: files that needn't change
    are read where they are, the others from the folder that they have been rewritten to."""
    spark = old.sparkSession
    got = old.groupBy("old_shard", "bucket", "block").agg(F.sum("size").alias("size")).collect()  # `blocks` rows at most
    place = transfers({(r["old_shard"], r["block"]): r["size"] for r in got}, shards)
    touched = sorted({(r["old_shard"], r["bucket"]) for r in got if place[r["block"]] != r["old_shard"]})
    if not touched:
        return old.withColumn("shard", F.col("old_shard")).drop("old_shard", "bucket")
    moves = F.broadcast(spark.createDataFrame(sorted(place.items()), "block int, shard int"))  # a row for each block
    files = F.broadcast(spark.createDataFrame(touched, "old_shard int, bucket int"))
    new = folder or scratch(spark, "resharded")
    affected = old.join(files, ["old_shard", "bucket"], "left_semi").join(moves, "block").drop("old_shard", "bucket")
    affected.write.option("compression", "zstd").partitionBy("shard").parquet(new)
    stay = old.join(files, ["old_shard", "bucket"], "left_anti").withColumn("shard", F.col("old_shard")).drop("old_shard", "bucket")
    return spark.read.schema(affected.schema).parquet(new).unionByName(stay)


def slotted(rows: DataFrame, key: Column, cells: int | None = None) -> DataFrame:
    """rows with `slot`, gapless from 0 in each shard. rows are written once (leave out what isn't needed) with a cell, dealt by
    their order and by the place they come from, so that equal rows get many cells; slots are numbered within cells."""
    order = [key.alias("k"), F.col("text_crc32"), F.col("size")]
    dealt = written(rows.withColumns({"mixed": F.xxhash64(*order, F.monotonically_increasing_id())}), "slots")
    cells = cells or max(256, dealt.count() // 100_000)
    spread = dealt.withColumn("cell", F.pmod(F.col("mixed"), F.lit(cells)).cast("int"))
    counts = spread.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).drop("n")
    numbered = spread.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "cell").orderBy(*order, "mixed")))
    return numbered.join(F.broadcast(before), ["shard", "cell"]).withColumn("slot", F.col("before") + F.col("nth") - 1).drop("cell", "before", "nth", "mixed")

"""Originality: exact copies, and runs of near-equal windows between candidates and a fingerprint table.

A fingerprint is an item's windows, unit vectors in order. A candidate is suspicious if its hash is in the table, or
if some alignment of the shorter item within the longer has `min_run` or more consecutive windows with a cosine at or
above `least`. Two plans give the same rows:

`by_blocks` joins corpus with corpus. The midpoint of two unit vectors with cosine c is at most r = sqrt(2 - 2c) / 2 away
from either. So each vector is listed under every cell within r of it, in partition trees along the main axes of a bounded sample
(`partition_tree`). Both vectors of a pair are listed under their midpoint's cell, so no match is lost, while few others share
one. How many trees and how deep is decided by counting what the sample's own vectors would be listed under and compared with.
What shares a cell is first compared along the main axes (`HEAD` numbers that travel with the ids), and only what is left by whole
vectors. Equal vectors are one until the end, and vectors aren't shuffled with the cells.

`by_matrix` is for few candidates: their windows are sent to the table's partitions, which take matrix products of `ROWS`
windows. The number of windows is checked; beyond the bound `by_blocks` takes over.

Below the threshold neither knows the closest item: its columns are null there. `nearest` compares all windows of the candidates with
all of the table, by a grid of blocks and parts, and tells the closest item of each, however far it is.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import cosine
from .partition_tree import cells, plan
from .select import range_cell
from .settled import settled

LEAST, MIN_RUN, MAX_CANDIDATES, SAMPLE, HEAD, ROWS, PART = 0.985, 3, 20_000, 8_192, 8, 512, 131_072


def exact(candidates: DataFrame, db: DataFrame, key: str = "item", digest: str = "pcm_sha256") -> DataFrame:
    """candidate and the least item of the table with its hash."""
    known = db.filter(F.coalesce(F.col(digest), F.lit("")) != "").groupBy(digest).agg(F.min(key).alias("exact_duplicate_of"))
    return candidates.select(F.col(key).alias("candidate"), digest).join(known, digest).select("candidate", "exact_duplicate_of")


def sampled(vectors: DataFrame, n: int) -> np.ndarray:
    """About SAMPLE of the n vectors, those with the least hashes."""
    some = vectors if n <= SAMPLE else vectors.filter(F.col("h1") < F.lit(int((SAMPLE / n - 0.5) * 2**64)))
    return np.array([r["vec"] for r in sorted(some.select("h1", "h2", "vec").collect())], dtype=np.float64)


def _distinct(windows: DataFrame) -> DataFrame:
    """windows with the two hashes of their vector in place of it, and the distinct vectors; zero vectors match nothing."""
    some = windows.filter(F.exists("vec", lambda v: v != 0)).withColumn("vec", F.transform("vec", lambda v: v.cast("double") + 0.0))
    return some.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit("again"), "vec")})


def near_windows(a: DataFrame, b: DataFrame, dim: int, least: float = LEAST) -> DataFrame:
    """candidate, item, i, j, cos of all pairs of windows at or above the threshold. a: candidate, i, vec; b: item, j, vec
    (unit vectors; zero vectors match nothing)."""
    a, b = _distinct(a), _distinct(b)
    vectors = a.select("h1", "h2", "vec", F.lit(True).alias("in_a"), F.lit(False).alias("in_b")).union(b.select("h1", "h2", "vec", F.lit(False), F.lit(True)))
    vectors = settled(vectors.groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b")))
    n = vectors.count()
    if not n:
        return a.select("candidate", "i").join(b.select("item", "j", F.lit(0.0).alias("cos")), F.lit(False)).select("candidate", "item", "i", "j", "cos")
    width = float(np.sqrt(2 - 2 * least)) + 0.0005  # slack for float32
    found = plan(sampled(vectors, n), n, width / 2)
    head = [f"p{k}" for k in range(min(HEAD, len(found.axes)))]

    def placed(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                yield batch, found.places(batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1))

    def levels(batches):
        import pyarrow as pa

        for _, places in placed(batches):
            for g, tree in enumerate(found.trees):
                level = np.unique(cells(tree, found.of_group(places, g), found.depth, found.limit)[0])
                yield pa.RecordBatch.from_pydict({"g": pa.array([g] * len(level), pa.int32()), "level": pa.array(level, pa.int32())})

    taken = {tuple(r) for r in vectors.select("vec").mapInArrow(levels, "g int, level int").distinct().collect()}  # a few for each tree

    def listed(batches):
        import pyarrow as pa

        for batch, places in placed(batches):
            owners, keys, owns = [], [], []
            for g, tree in enumerate(found.trees):
                level, by_level = cells(tree, found.of_group(places, g), found.depth, found.limit)
                for d, (owner, cell) in by_level.items():
                    if (g, d) in taken:
                        keep = level[owner] >= d
                        owners.append(owner[keep])
                        keys.append(cell[keep] << 2 | g)
                        owns.append(level[owner[keep]] == d)
            owner = np.concatenate(owners)
            rows = batch.select(["h1", "h2", "in_a", "in_b"]).take(pa.array(owner))
            near = [pa.array(places[owner, k].astype(np.float32)) for k in range(len(head))]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(keys)), pa.array(np.concatenate(owns)), *near], names=["h1", "h2", "in_a", "in_b", "cell", "own", *head])

    keyed = vectors.mapInArrow(listed, "h1 long, h2 long, in_a boolean, in_b boolean, cell long, own boolean" + "".join(f", {p} float" for p in head))
    left = keyed.filter("in_a").select("cell", F.col("own").alias("own_a"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), *(F.col(p).alias(f"a_{p}") for p in head))
    right = keyed.filter("in_b").select("cell", F.col("own").alias("own_b"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), *(F.col(p).alias(f"b_{p}") for p in head))
    meeting = left.filter("own_a").join(right, "cell")
    if len(taken) > len(found.trees):  # some vectors stay at coarser levels, where the others are guests
        meeting = meeting.unionByName(left.filter("NOT own_a").join(right.filter("own_b"), "cell"))
    gap = reduce(lambda x, y: x + y, ((F.col(f"a_{p}") - F.col(f"b_{p}")) * (F.col(f"a_{p}") - F.col(f"b_{p}")) for p in head), F.lit(0.0))
    pairs = meeting.filter(gap <= width * width).select("a1", "a2", "b1", "b2").distinct()
    u = vectors.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("vec").alias("u"))
    v = vectors.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("vec").alias("v"))
    near = pairs.join(u, ["a1", "a2"]).join(v, ["b1", "b2"]).withColumn("cos", cosine(F.col("u"), F.col("v"))).filter(F.col("cos") >= least).select("a1", "a2", "b1", "b2", "cos")
    mine = a.select("candidate", "i", F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    theirs = b.select("item", "j", F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    return near.join(mine, ["a1", "a2"]).join(theirs, ["b1", "b2"]).select("candidate", "item", "i", "j", "cos")


def runs(pairs: DataFrame, sizes_a: DataFrame, sizes_b: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """candidate, closest_item, matched_windows, max_cosine, suspicious: the best alignment's longest run for each
    candidate with any near window. sizes: candidate, n and item, m. The shorter item lies wholly within the longer."""
    both = pairs.join(sizes_a, "candidate").join(sizes_b, "item")
    offset = F.when(F.col("n") <= F.col("m"), F.col("j") - F.col("i")).otherwise(F.col("i") - F.col("j"))
    place = F.when(F.col("n") <= F.col("m"), F.col("i")).otherwise(F.col("j"))
    inside = both.withColumns({"offset": offset, "place": place}).filter((F.col("offset") >= 0) & (F.col("offset") <= F.abs(F.col("m") - F.col("n"))))
    group = ["candidate", "item", "offset"]
    island = F.col("place") - F.row_number().over(Window.partitionBy(*group).orderBy("place"))
    each = inside.withColumn("island", island).groupBy(*group, "island").agg(F.count("*").alias("run"), F.max("cos").alias("cos"))
    aligned = each.groupBy(*group).agg(F.max("run").alias("run"), F.max("cos").alias("cos"))
    best = aligned.groupBy("candidate").agg(F.max(F.struct("run", "cos")).alias("top"))
    joined = aligned.join(best, "candidate").filter((F.col("run") == F.col("top.run")) & (F.col("cos") == F.col("top.cos")))
    return joined.groupBy("candidate").agg(F.min("item").alias("closest_item"), F.first("run").alias("matched_windows"), F.first("cos").alias("max_cosine")).withColumn("suspicious", F.col("matched_windows") >= min_run)


def sizes(windows: DataFrame, key: str, name: str) -> DataFrame:
    return windows.groupBy(key).agg(F.count("*").alias(name))


def alike(windows: DataFrame, key: str, place: str, size: str) -> DataFrame:
    """key, rep and its number of windows: rep is the least key of those with equal windows at equal places."""
    vec = F.transform("vec", lambda v: v.cast("double") + 0.0)
    total = lambda *salt: F.sum(F.xxhash64(*salt, F.col(place), vec).cast("decimal(20,0)"))
    signed = windows.groupBy(key).agg(F.count("*").alias(size), total().alias("s1"), total(F.lit("again")).alias("s2"))
    reps = signed.groupBy(size, "s1", "s2").agg(F.min(key).alias("rep"))
    return settled(signed.join(reps, [size, "s1", "s2"]).select(key, "rep", size))


def by_blocks(a: DataFrame, b: DataFrame, dim: int, least: float = LEAST, min_run: int = MIN_RUN) -> DataFrame:
    mine, theirs = alike(a, "candidate", "i", "n"), alike(b, "item", "j", "m")
    of_a, of_b = mine.filter("candidate = rep").drop("rep"), theirs.filter("item = rep").drop("rep")
    pairs = near_windows(a.join(of_a.drop("n"), "candidate", "left_semi"), b.join(of_b.drop("m"), "item", "left_semi"), dim, least)
    found = runs(pairs, of_a, of_b, min_run).withColumnRenamed("candidate", "rep")
    return mine.drop("n").join(found, "rep").drop("rep")


def _sliced(frames, *columns: str):
    """The windows of the table in parts of ROWS: each part's vectors as a matrix, and the columns as lists."""
    for f in frames:
        for at in range(0, len(f), ROWS):
            part = f.iloc[at : at + ROWS]
            yield np.stack(part["vec"].to_numpy()).astype(np.float64), *(part[c].tolist() for c in columns)


def _matrix(got: list) -> np.ndarray:
    return np.array([r["vec"] for r in got], dtype=np.float64).reshape(len(got), len(got[0]["vec"]) if got else 0)


def by_matrix(a: DataFrame, b: DataFrame, least: float = LEAST, min_run: int = MIN_RUN, max_windows: int = MAX_CANDIDATES) -> DataFrame:
    got = a.select("candidate", "i", "vec").limit(max_windows + 1).collect()
    if len(got) > max_windows:
        return by_blocks(a, b, len(got[0]["vec"]), least, min_run)
    spark = a.sparkSession
    held = spark.sparkContext.broadcast((_matrix(got), [r["candidate"] for r in got], [r["i"] for r in got]))

    def near(frames):
        import pandas as pd

        u, names, places = held.value
        for v, items, js in _sliced(frames, "item", "j") if len(u) else ():
            sims = u @ v.T
            x, y = np.nonzero(sims >= least)
            if len(x):
                yield pd.DataFrame({"candidate": [names[k] for k in x], "item": [items[k] for k in y], "i": [places[k] for k in x], "j": [js[k] for k in y], "cos": sims[x, y].tolist()})

    kinds = {c: (a if c in ("candidate", "i") else b).schema[c].dataType.simpleString() for c in ("candidate", "item", "i", "j")}
    pairs = b.select("item", "j", "vec").mapInPandas(near, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", cos double")
    return runs(pairs, sizes(a, "candidate", "n"), sizes(b, "item", "m"), min_run)


def nearest(a: DataFrame, b: DataFrame, max_windows: int = MAX_CANDIDATES, part: int = PART) -> DataFrame:
    """candidate, closest_item, max_cosine: the item with the greatest cosine of two windows that some alignment puts side by
    side, if any is over 0; of several the least. The table's windows are dealt into parts, the candidates' into blocks of about
    max_windows; every block is sent to every part, and meets its windows in matrix products. A task holds a part and a
    block; each pair of them leaves a row for each candidate, so nothing goes through the driver but two counts."""
    spark = a.sparkSession
    kinds = {"candidate": a.schema["candidate"].dataType.simpleString(), "item": b.schema["item"].dataType.simpleString()}
    mine = a.select("candidate", "i", F.transform("vec", lambda v: v.cast("double")).alias("vec")).join(sizes(a, "candidate", "n"), "candidate")
    theirs = b.select("item", "j", F.transform("vec", lambda v: v.cast("double")).alias("vec")).join(sizes(b, "item", "m"), "item")
    blocks, rows = max(1, -(-a.count() // max_windows)), b.count()
    parts = max(1, -(-rows // part), min(-(-rows // ROWS), 2 * spark.sparkContext.defaultParallelism))
    block = F.pmod(F.xxhash64("candidate", "i"), F.lit(blocks)).alias("block")
    none = lambda c: F.lit(None).cast(f"array<{c}>")
    packed = mine.groupBy(block).agg(F.collect_list("candidate").alias("names"), F.collect_list(F.col("i").cast("long")).alias("places"), F.collect_list("n").alias("sizes"), F.collect_list("vec").alias("vecs"))
    packed = packed.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "names", none(kinds["item"]).alias("items"), "places", "sizes", "vecs")
    dealt = theirs.select(F.pmod(F.xxhash64("item", "j"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), none(kinds["candidate"]).alias("names"), F.array("item").alias("items"), F.array(F.col("j").cast("long")).alias("places"), F.array("m").alias("sizes"), F.array("vec").alias("vecs"))
    grid = dealt.unionByName(packed).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")

    def best(batches):
        import pandas as pd

        at, held, whole = None, [], None
        for batch in batches:
            for number, kind, names, items, places, m, vecs in zip(*(batch[c] for c in batch.columns)):
                if number != at:
                    at, held, whole = number, [], None
                if not kind:
                    held.append((items[0], places[0], m[0], vecs[0]))
                    continue
                if not held:
                    continue
                if whole is None:
                    whole = np.array([h[0] for h in held], dtype=object), *(np.array([h[k] for h in held], dtype=np.int64) for k in (1, 2)), np.array([h[3] for h in held], dtype=np.float64)
                yield _best(np.array(names, dtype=object), np.array(places, dtype=np.int64), np.array(m, dtype=np.int64), np.array([*vecs], dtype=np.float64).reshape(len(vecs), -1), *whole, pd)

    found = grid.mapInPandas(best, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", cos double")
    first = found.groupBy("candidate").agg(F.min(F.struct((-F.col("cos")).alias("below"), "item")).alias("first"))
    return first.select("candidate", F.col("first.item").alias("closest_item"), (-F.col("first.below")).alias("max_cosine"))


def _best(names, i, n, u, items, j, m, v, pd):
    """A row for each candidate of a block: the closest of a part's items, if any cosine of windows side by side is over 0."""
    order = np.argsort(names, kind="stable")
    names, i, n, u = names[order], i[order], n[order], u[order]
    starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    top: list = [(0.0, None)] * len(starts)
    for at in range(0, len(items), ROWS):
        cut = slice(at, at + ROWS)
        ahead = (j[cut][None, :] - i[:, None]) * np.where(n[:, None] <= m[cut][None, :], 1, -1)
        sims = np.where((ahead >= 0) & (ahead <= np.abs(m[cut][None, :] - n[:, None])), u @ v[cut].T, -1.0)
        each = np.maximum.reduceat(sims, starts, axis=0)
        most = each.max(axis=1)
        for c in np.flatnonzero(most > 0):
            if most[c] >= top[c][0]:
                item = min(items[cut][y] for y in np.flatnonzero(each[c] == most[c]))
                if most[c] > top[c][0] or item < top[c][1]:
                    top[c] = (float(most[c]), item)
    return pd.DataFrame([(names[s], item, cos) for s, (cos, item) in zip(starts, top) if item is not None], columns=["candidate", "item", "cos"])


def screen(candidates: DataFrame, found: DataFrame, copies: DataFrame, closest: DataFrame | None = None) -> DataFrame:
    """The verdict for each candidate: exact copies first, then runs. found: from `by_blocks` or `by_matrix`. closest: from
    `nearest`, to name the closest items below the threshold too."""
    if closest is not None:
        far = closest.join(found, "candidate", "left_anti").select("candidate", "closest_item", F.lit(0).alias("matched_windows"), "max_cosine", F.lit(False).alias("suspicious"))
        found = found.unionByName(far)
    joined = candidates.select(F.col("item").alias("candidate")).join(copies, "candidate", "left").join(found, "candidate", "left")
    copy = F.col("exact_duplicate_of").isNotNull()
    return joined.select("candidate", "exact_duplicate_of", F.when(copy, F.col("exact_duplicate_of")).otherwise(F.col("closest_item")).alias("closest_item"), F.coalesce("matched_windows", F.lit(0)).alias("matched_windows"), F.when(copy, 1.0).otherwise(F.col("max_cosine")).alias("max_cosine"), (copy | F.coalesce("suspicious", F.lit(False))).alias("suspicious"))


def longest_run(rows: DataFrame, keys: list[str], order: str, condition: Column, cells: int = 256) -> DataFrame:
    """keys with the longest and the leading run of rows where the condition holds. A segmented scan: range cells of (keys, order)
    give their length and their leading, trailing and longest run, and a key's cells (`cells` at most) are merged in order."""
    marked = rows.select(*keys, F.col(order).alias("__o"), F.coalesce(condition, F.lit(False)).alias("__hit"))
    placed = marked.withColumn("__cell", range_cell(marked, [*keys, "__o"], cells))
    own = [*keys, "__cell"]
    w = Window.partitionBy(*own).orderBy("__o")
    islands = placed.withColumn("__n", F.row_number().over(w)).withColumn("__island", F.col("__n") - F.sum(F.col("__hit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = islands.groupBy(*own, "__island").agg(F.sum(F.col("__hit").cast("long")).alias("run"), F.count("*").alias("m"))
    last = F.max_by("run", "__island")
    blocks = each.groupBy(*own).agg(F.sum("m").alias("n"), F.max("run").alias("longest"), F.max(F.when(F.col("__island") == 0, F.col("run")).otherwise(0)).alias("leading"), last.alias("trailing"))
    start = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "longest", "leading", "trailing")))

    def merged(a: Column, b: Column) -> Column:
        return F.struct(
            (a["n"] + b["n"]).alias("n"), F.greatest(a["longest"], b["longest"], a["trailing"] + b["leading"]).alias("longest"),
            F.when(a["leading"] == a["n"], a["n"] + b["leading"]).otherwise(a["leading"]).alias("leading"),
            F.when(b["trailing"] == b["n"], b["n"] + a["trailing"]).otherwise(b["trailing"]).alias("trailing"),
        )

    of_key = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__cell", "n", "longest", "leading", "trailing"))).alias("cells"))
    whole = of_key.withColumn("all", F.aggregate("cells", start, merged))
    return whole.select(*keys, F.col("all.longest").alias("longest"), F.col("all.leading").alias("leading"))

"""Analytics of training runs, comparisons and queues."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import numbered, range_cell
from .settled import settled

#: Requests of a client in one block of the replay.
BLOCK = 65_536


def codebook_usage(codes: DataFrame, codebook: str, code: str, size: int) -> DataFrame:
    """For each codebook: unique codes, utilisation, dead codes, entropy (nats), perplexity, and whether it collapsed. Any
    categorical column will do."""
    counts = codes.groupBy(codebook, code).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(codebook))
    shares = counts.withColumn("h", -p * F.log(p))
    out = shares.groupBy(codebook).agg(F.count("*").alias("unique_codes"), F.sum("h").alias("entropy"))
    use, perplexity = F.col("unique_codes") / F.lit(size), F.exp("entropy")
    return out.select(codebook, "unique_codes", use.alias("utilization"), (F.lit(size) - F.col("unique_codes")).alias("dead_codes"), F.round("entropy", 6).alias("entropy"), F.round(perplexity, 6).alias("perplexity"), ((use < 0.05) | (perplexity < 2)).alias("collapsed"))


def curve_windows(curve: DataFrame, run: str, step: str, metric: str) -> DataFrame:
    """Means over the first and the last tenth (one row at least) of each run, and whether the metric fell."""
    w = Window.partitionBy(run)
    placed = curve.withColumns({"__i": F.row_number().over(w.orderBy(step)), "__n": F.count("*").over(w)})
    tenth = F.greatest(F.floor(F.col("__n") / 10), F.lit(1))
    mean = lambda c: F.avg(F.when(c, F.col(metric)))
    out = placed.groupBy(run).agg(mean(F.col("__i") <= tenth).alias("first_mean"), mean(F.col("__i") > F.col("__n") - tenth).alias("last_mean"))
    return out.withColumn("decreased", F.col("last_mean") < F.col("first_mean"))


def step_integrity(curve: DataFrame, run: str, step: str, expected: int | None = None) -> DataFrame:
    """Rows, distinct, repeated and missing steps of each run, within [0, expected) or else between its first and last."""
    inside = F.col(step).between(0, expected - 1) if expected is not None else F.lit(True)
    out = curve.groupBy(run).agg(F.count(step).alias("n_rows"), F.count_distinct(step).alias("n_steps"), F.count_distinct(F.when(inside, F.col(step))).alias("n_inside"), F.min(step).alias("first_step"), F.max(step).alias("last_step"))
    wanted = F.lit(expected) if expected is not None else F.col("last_step") - F.col("first_step") + 1
    out = out.withColumns({"n_repeated": F.col("n_rows") - F.col("n_steps"), "n_missing": wanted - F.col("n_inside")}).drop("n_inside")
    return out.withColumn("ok", (F.col("n_repeated") == 0) & (F.col("n_missing") == 0))


def missing_steps(curve: DataFrame, run: str, step: str) -> DataFrame:
    """The steps that each run lacks between its first and last."""
    span = curve.groupBy(run).agg(F.min(step).alias("a"), F.max(step).alias("b"))
    every = span.select(run, F.explode(F.sequence("a", "b")).alias(step))
    return every.join(curve.select(run, step), [run, step], "left_anti")


def collapse_history(snapshots: DataFrame, run: str, step: str, collapsed: str, utilization: str) -> DataFrame:
    """How often and when a run's codebooks were collapsed, and whether they recovered."""
    hit = F.when(F.col(collapsed), F.col(step))
    out = snapshots.groupBy(run).agg(F.count("*").alias("snapshots"), F.coalesce(F.sum(F.col(collapsed).cast("long")), F.lit(0)).alias("n_collapsed"), F.min(hit).alias("first_collapse"), F.max(hit).alias("last_collapse"), F.max_by(collapsed, step).alias("final_collapsed"), F.min(utilization).alias("min_utilization"), F.max(utilization).alias("max_utilization"), F.max_by(utilization, step).alias("final_utilization"))
    return out.withColumn("verdict", F.when(F.col("n_collapsed") == 0, "never").when(F.col("final_collapsed"), "collapsed").otherwise("recovered"))


def superseded(curve: DataFrame, resumes: DataFrame, run: str, step: str) -> DataFrame:
    """curve with `superseded`: rows at or behind the step from which their run was resumed. resumes: run, start_step.
    Rows without a step stay."""
    starts = resumes.groupBy(run).agg(F.min("start_step").alias("__start"))
    return curve.join(starts, run, "left").withColumn("superseded", F.coalesce(F.col(step) >= F.col("__start"), F.lit(False))).drop("__start")


def agreement(settings: DataFrame, run: str, names: list[str], varies: str) -> DataFrame:
    """setting, n_values and ok: all runs agree on every setting but the one that varies by design, which all differ in."""
    long = settings.unpivot([run], [*names], "setting", "value") if len({settings.schema[n].dataType for n in names}) == 1 else settings.select(run, *(F.col(n).cast("string").alias(n) for n in names)).unpivot([run], [*names], "setting", "value")
    counted = long.groupBy("setting").agg(F.count_distinct(F.coalesce(F.col("value").cast("string"), F.lit("null"))).alias("n_values"), F.count_distinct(run).alias("n_runs"))
    return counted.select("setting", "n_values", F.when(F.col("setting") == varies, F.col("n_values") == F.col("n_runs")).otherwise(F.col("n_values") == 1).alias("ok"))


def probe_means(rows: DataFrame, run: str, phase: str, item: str, metrics: list[str], loss: list[str] = ()) -> DataFrame:
    """run, metric, before, after, delta, n_items and same_items of a probe measured before and after training (phase: before, after);
    recon_loss is the sum of the metrics in `loss`. Both phases are alike only if they cover the same items: each has a hash of its
    items' set, a sum of hashes, so neither order nor partitioning matters."""
    total = lambda *salt: F.sum(F.xxhash64(*salt, F.col(item)).cast("decimal(20,0)"))
    sums = rows.groupBy(run, phase).agg(F.count("*").alias("n"), total().alias("h1"), total(F.lit("again")).alias("h2"), *(F.avg(m).alias(m) for m in metrics))
    if loss:
        sums = sums.withColumn("recon_loss", sum((F.col(m) for m in loss), F.lit(0.0)))
    long = sums.unpivot([run, phase, "n", "h1", "h2"], [*metrics, *(["recon_loss"] if loss else [])], "metric", "value")
    of = lambda name, c: F.max(F.when(F.col(phase) == name, F.col(c)))
    out = long.groupBy(run, "metric").agg(of("before", "value").alias("before"), of("after", "value").alias("after"), of("after", "n").alias("n_items"), *((of("before", c) == of("after", c)).alias(f"same_{c}") for c in ("n", "h1", "h2")))
    return out.select(run, "metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"), "n_items", F.coalesce(F.col("same_n") & F.col("same_h1") & F.col("same_h2"), F.lit(False)).alias("same_items"))


def comparison(candidates: DataFrame, curves: DataFrame, probes: DataFrame, history: DataFrame, key: str = "candidate", step: str = "step", metric: str = "loss", headline: str = "recon_loss") -> DataFrame:
    """A row for each candidate of a sweep, ranked by what its probe says after training: steps, the curve's first and last tenth, the headline before and after,
    and what its codebooks did. A candidate lacks what its run never wrote, and is complete if it has a curve and
    both measurements over the same items. curves: key, step, metric; probes: from `probe_means`; history: from
    `collapse_history`."""
    steps = curves.groupBy(key).agg(F.count_distinct(step).alias("n_steps"), F.max(step).alias("last_step"))
    probe = probes.filter(F.col("metric") == headline).select(key, "before", "after", "delta", "same_items")
    whole = candidates.select(key).distinct()
    for part in (steps, curve_windows(curves, key, step, metric), probe, history.select(key, F.col("verdict").alias("codebooks"), "n_collapsed", "final_utilization")):
        whole = whole.join(part, key, "left")
    out = whole.withColumn("complete", F.col("n_steps").isNotNull() & F.coalesce("same_items", F.lit(False)))
    return out.withColumn("place", F.when(F.col("complete"), F.row_number().over(Window.orderBy(F.desc("complete"), F.col("after").asc_nulls_last(), key))))  # a row for each candidate


def _draws(sizes: np.ndarray, at: int, iterations: int, seed: int) -> np.ndarray:
    """How many of each iteration's sum(sizes) draws fall into cell `at`. The cells are halved down to it, and each halving
    has its own seed, so the counts of all cells together are one multinomial draw."""
    low, high, total = 0, len(sizes), int(sizes.sum())
    got = np.full(iterations, total)
    while high - low > 1:
        mid = (low + high) // 2
        left = int(sizes[low:mid].sum())
        first = np.random.default_rng((seed, low, high)).binomial(got, left / total)
        got, low, high, total = (first, low, mid, left) if at < mid else (got - first, mid, high, total - left)
    return got


def _resampled(frame, sizes: np.ndarray, iterations: int, seed: int):
    """The sum over one cell's values (value, n) in every iteration, and as iteration -1 over the values themselves."""
    import pandas as pd

    frame = frame.sort_values("value")
    at, values, n = int(frame["cell"].iloc[0]), frame["value"].to_numpy(), frame["n"].to_numpy()
    draws = _draws(sizes, at, iterations, seed)
    rng = np.random.default_rng((seed, at, at + 1))
    sums = [(n * values).sum()]
    for part in range(0, iterations, 250):
        times = rng.multinomial(draws[part : part + 250], n / n.sum())
        with np.errstate(invalid="ignore"):
            sums.extend(np.where(times > 0, times * values, 0.0).sum(axis=1))
    return pd.DataFrame({"iteration": np.arange(-1, iterations), "cell": at, "s": sums})


def bootstrap(deltas: DataFrame, column: str = "delta", iterations: int = 10_000, seed: int = 42, cell_values: int = 2048, buckets: int = 1 << 16) -> DataFrame:
    """One row: n, mean, the bounds of its 95 % interval, wins, losses (ties too) and a verdict by the interval's sign. Equal
    deltas are one value with a count. The values stay in cells of about cell_values; each cell sums its share of every
    iteration's draws, and the driver gets the counts of `buckets` and the iterations' means. All draws are seeded, so
    partitioning changes nothing."""
    spark = deltas.sparkSession
    value = F.coalesce(F.col(column).cast("double"), F.lit(float("nan")))
    counted = deltas.groupBy(value.alias("value")).agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int"))
    won = F.sum(F.when((F.col("value") > 0) & ~F.isnan("value"), F.col("n")).otherwise(0))
    found = sorted(tuple(r) for r in counted.groupBy("bucket").agg(F.count("*"), F.sum("n"), won).collect())
    n, wins, low, high, mean = sum(r[2] for r in found), sum(r[3] for r in found), float("nan"), float("nan"), None
    if n:
        cells, sizes, held = [], [0], 0
        for bucket, m, rows, _ in found:
            if held >= cell_values:
                sizes.append(0)
                held = 0
            held += m
            sizes[-1] += rows
            cells.append((bucket, len(sizes) - 1))
        placed = counted.join(F.broadcast(spark.createDataFrame(cells, "bucket int, cell int")), "bucket").drop("bucket")  # `buckets` rows at most
        sizes, times = np.array(sizes), iterations if n >= 2 else 0
        sums = placed.groupBy("cell").applyInPandas(lambda frame: _resampled(frame, sizes, times, seed), "iteration long, cell long, s double")
        total = F.aggregate(F.array_sort(F.collect_list(F.struct("cell", "s"))), F.lit(0.0), lambda a, x: a + x["s"])  # in one order
        means = {i: t / n for i, t in sums.groupBy("iteration").agg(total).collect()}  # `iterations` numbers
        mean = float(means.pop(-1))
        if means:
            ordered = sorted(means.values())
            low, high = ordered[int(0.025 * iterations)], ordered[min(int(0.975 * iterations), iterations - 1)]
    verdict = "improved" if low > 0 else "worse" if high < 0 else "inconclusive"
    return spark.createDataFrame([(n, mean, low, high, wins, n - wins, verdict)], "n long, mean double, low double, high double, wins long, losses long, verdict string")


def running(rows: DataFrame, key: str, order: list[str], value: str, cells: int = 256) -> DataFrame:
    """rows with the highest value so far and the last that isn't null. A segmented scan: within range cells of (key, order), and
    from the maxima and last values of a key's earlier cells, of which it has `cells` at most. So a key may have any number of rows."""
    placed = rows.withColumn("__cell", range_cell(rows, [key, *order], cells))
    found = placed.groupBy(key, "__cell").agg(F.max(value).alias("__max"), F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__last"))
    earlier = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = found.select(F.col(key).alias("__key"), F.col("__cell").alias("__at"), F.max("__max").over(earlier).alias("__max"), F.last("__last", ignorenulls=True).over(earlier).alias("__last"))
    w = Window.partitionBy(key, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({"peak": F.max(value).over(w), "latest": F.last(value, ignorenulls=True).over(w)})
    joined = own.join(before, own[key].eqNullSafe(F.col("__key")) & (F.col("__cell") == F.col("__at")))
    return joined.withColumns({"peak": F.greatest("peak", "__max"), "latest": F.coalesce("latest", "__last")}).drop("__key", "__cell", "__at", "__max", "__last")


def health(scalars: DataFrame, series: str, value: str) -> DataFrame:
    """series, n, all_finite, moves, verdict of each series. verdict is null (unproven) for a series without values."""
    finite = ~(F.isnan(value) | F.col(value).isin(float("inf"), float("-inf")))
    out = scalars.groupBy(series).agg(F.count(value).alias("n"), F.bool_and(finite).alias("all_finite"), (F.count_distinct(F.round(value, 9)) > 1).alias("moves"))
    return out.withColumn("verdict", F.when(F.col("n") > 0, F.col("all_finite") & F.col("moves")))


def queue_stats(jobs: DataFrame) -> DataFrame:
    """Jobs by status with their mean waiting and running seconds. jobs: status, created_at, started_at, finished_at."""
    seconds = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6
    return jobs.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg(seconds(F.col("created_at"), F.col("started_at"))), 3).alias("queue_seconds"), F.round(F.avg(seconds(F.col("started_at"), F.col("finished_at"))), 3).alias("run_seconds"))


def queue_position(jobs: DataFrame, order: list[str], waiting: str = "pending") -> DataFrame:
    """The waiting jobs with their `position` (from 1) in order: numbered within ranges of it, so no task has them all."""
    queue = jobs.filter(F.col("status") == waiting)
    return numbered(queue, "status", order, range_cell(queue, order), "position", "__n").drop("__n")


def keep_if_better(pairs: DataFrame, weak: Column, new_flags: Column, gain: float = 1.0, drop: float = 0.5) -> DataFrame:
    """One row: the weak items' mean gain, the strong items' worst change, items with new flags, and whether to keep. pairs:
    base, treatment."""
    delta = F.col("treatment") - F.col("base")
    out = pairs.agg(F.avg(F.when(weak, delta)).alias("weak_gain"), F.min(F.when(~weak, delta)).alias("worst_strong"), F.coalesce(F.sum((F.size(new_flags) > 0).cast("long")), F.lit(0)).alias("flagged"))
    return out.withColumn("keep", F.coalesce((F.col("weak_gain") >= gain) & (F.coalesce("worst_strong", F.lit(0.0)) >= -drop) & (F.col("flagged") == 0), F.lit(False)))


def benchmark_summary(results: DataFrame, model: str = "model") -> DataFrame:
    """Generated, failed and the real-time factor (seconds of generation for a second of audio)."""
    ok = F.col("error").isNull()
    audio = F.sum(F.when(ok, F.col("audio_seconds")))
    return results.groupBy(model).agg(F.sum(ok.cast("long")).alias("generated"), F.sum((~ok).cast("long")).alias("failed"), F.when(audio > 0, F.sum(F.when(ok, F.col("generation_seconds"))) / audio).alias("real_time_factor"))


def breadth(prompts: DataFrame, per_category: int = 3, held_out: int = 10, held_categories: int = 6, languages: int = 3) -> DataFrame:
    """One row: whether a prompt set is broad enough. prompts: id, category, heldout, language."""
    small = prompts.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum(F.col("heldout").cast("long")).alias("h"))
    out = small.agg(F.sum("n").alias("prompts"), (F.sum("n") == F.sum("ids")).alias("ids_unique"), F.min("n").alias("smallest_category"), F.sum("h").alias("held_out"), F.sum((F.col("h") > 0).cast("long")).alias("held_categories"))
    spoken = prompts.agg(F.count_distinct(F.when(F.col("language") != "en", F.col("language"))).alias("other_languages"))
    whole = out.crossJoin(spoken)  # one row each
    return whole.withColumn("ok", F.col("ids_unique") & (F.col("smallest_category") >= per_category) & (F.col("held_out") >= held_out) & (F.col("held_categories") >= held_categories) & (F.col("other_languages") >= languages))


def admitted_requests(log: DataFrame, client: str, ts: str, per_minute: int, daily: int, block: int = BLOCK) -> DataFrame:
    """log with `accepted`: at most per_minute accepted in any 60 s, and a daily quota that runs from a client's first
    accepted request. Only accepted requests count, so the rule goes from one accepted request to its successor: the first
    that neither the per_minute accepted last nor the quota bars. Requests are sorted by ranges and cut into blocks, so a client of any
    size lies in many tasks; one task then leaps through the client's blocks in order, from successor to successor. It sees a
    time (8 bytes) a request, a block at a time, and takes a step for each accepted one. A request without a time
    is not accepted. log: client, ts, event_id."""
    order = [client, ts, "event_id", "__salt"]
    dealt = log.withColumn("__salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("__salt")

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, last, n = TaskContext.get().partitionId(), -1, None, block
        for b in batches:
            blocks, places = [], []
            for who in b.column(b.schema.get_field_index(client)).to_pylist():
                if n >= block or who != last:
                    number, last, n = number + 1, who, 0
                blocks.append(number)
                places.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()), pa.array(places, pa.int32())], names=[*b.schema.names, "__part", "__block", "__place"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)
    rows = settled(dealt.mapInArrow(cut, f"{fields}, __part int, __block int, __place int"), "requests")
    timed = rows.filter(F.col(ts).isNotNull()).groupBy(F.col(client).alias("client"), "__part", "__block")
    times = timed.agg(F.array_sort(F.collect_list(F.struct("__place", F.unix_micros(F.col(ts).cast("timestamp")).alias("us")))).alias("each"))
    blocks = times.select("client", "__part", "__block", F.transform("each", lambda x: x["__place"]).alias("places"), F.transform("each", lambda x: x["us"]).alias("times"))

    def leap(batches):
        import pyarrow as pa

        from .ratelimit import Admitted, leaps

        last, state = None, None
        for b in batches:
            hits: list[tuple[int, int, int]] = []
            for k, (who, part, number) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]))):
                if state is None or who != last:
                    last, state = who, Admitted()
                places, us = (b.column(c)[k].values.to_numpy() for c in (3, 4))
                state, found = leaps(state, us, per_minute, daily)
                hits += [(part, number, int(places[x])) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int32()) for k in range(3)], names=["__part", "__block", "__place"])

    accepted = blocks.repartition("client").sortWithinPartitions("client", "__part", "__block").mapInArrow(leap, "__part int, __block int, __place int")
    at = ["__part", "__block", "__place"]
    return rows.join(accepted.withColumn("accepted", F.lit(True)), at, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False))).drop(*at)

"""The jobs that never end, as Structured Streaming. Windows and watermarks are this library's choice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import parsed_log
from ..operators.ratelimit import Admitted, admit
from ..operators.select import top_per_group
from . import tables


def monitor(lines: DataFrame, alive: str | None = None) -> DataFrame:
    """The state of each run from its log lines: latest step, epoch, loss and gradient, peaks, errors and a stage. lines:
    run_id, line_no, line and, if named, a boolean `alive` (a heartbeat; the latest counts); a stream or a table. A run that is
    alive is training; one that isn't has failed if it has errors, is stopped if it has a step, and else is starting. Without
    heartbeats runs without errors count as alive once they have a step."""
    p = parsed_log(lines)
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    out = p.groupBy("run_id").agg(*(latest(c) for c in ("step", "epoch", "loss", "grad_norm", *([alive] if alive else []))), F.max("loss").alias("peak_loss"), F.max("grad_norm").alias("peak_grad_norm"), F.sum(F.col("is_error").cast("long")).alias("n_errors"))
    living = F.coalesce(F.col(alive), F.lit(False)) if alive else (F.col("n_errors") == 0) & F.col("step").isNotNull()
    return out.withColumn("stage", F.when(living, "training").when(F.col("n_errors") > 0, "failed").when(F.col("step").isNotNull(), "stopped").otherwise("starting"))


def last_errors(lines: DataFrame, n: int = 3, chars: int = 300) -> DataFrame:
    """run_id and `errors`: the last characters of its last n error lines, in order."""
    bad = parsed_log(lines).filter("is_error").select("run_id", "line_no", F.expr(f"right(trim(line), {chars})").alias("line"))
    few = top_per_group(bad, "run_id", [F.desc("line_no")], F.lit(n))
    return few.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("e")).select("run_id", F.transform("e", lambda x: x["line"]).alias("errors"))


def incremental(spark: SparkSession, source: str, schema, key: str, target: str, work: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Processes files as they come; keys that the target already has are left out, so a rerun repeats nothing, and a crash at any
    point neither (`tables.increment`). Rows without a key, and those whose work has a problem, are kept apart. The query,
    which stops once all files present are done."""

    def step(batch: DataFrame, number: int) -> None:
        tables.increment(batch, number, target, key, work)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, key: str, ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first arrival of each hash; with a time column, state is kept for the delay only. Rows without a hash pass."""
    full = stream.filter(F.coalesce(F.col(key), F.lit("")) != "")
    return full.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]) if ts else full.dropDuplicates([key])


def admission(stream: DataFrame, client: str, ts: str, per_minute: int, daily: int) -> DataFrame:
    """client, event_id, ts, accepted: the same rule as `experiments.admitted_requests`, in order of arrival (of times within a
    batch), with each client's few times as state, dropped after a day without requests. A request without a time is
    not accepted. `admission.ordered_admission` waits for the order of times."""
    import pandas as pd

    kind = stream.schema[client].dataType.simpleString()

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        past = Admitted(*state.get) if state.exists else Admitted()
        past = past._replace(recent=tuple(past.recent))
        rows, accepted = pd.concat(list(frames)).sort_values([ts, "event_id"]), []
        for at, absent in zip(rows[ts].astype("datetime64[us]").astype("int64").tolist(), rows[ts].isna()):
            ok = False
            if not absent:
                past, ok = admit(past, at, per_minute, daily)
            accepted.append(ok)
        rows["accepted"] = accepted
        state.update((list(past.recent), past.opened, past.used))
        state.setTimeoutDuration(86_400_000)
        yield rows[[client, "event_id", ts, "accepted"]]

    return stream.groupBy(client).applyInPandasWithState(step, f"`{client}` {kind}, event_id long, `{ts}` timestamp, accepted boolean", "recent array<long>, opened long, used long", "append", "ProcessingTimeTimeout")


def queue_depth(events: DataFrame, ts: str = "ts", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events by status in each window."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, window), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def expired(files: DataFrame, hours: float, now) -> DataFrame:
    """Files older than the retention. `tables.marked` and `tables.removed` remove them in two phases."""
    return files.filter(F.col("modificationTime") < F.lit(now) - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {hours * 3600})"))


def resolved_curve(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, superseded) rows of an appended curve: of each (run, step) the latest session counts. rows: run_id, step,
    session and metrics. Rows without a step stay."""
    w = Window.partitionBy("run_id", "step").orderBy(F.desc("session"))
    ranked = rows.withColumn("__r", F.when(F.col("step").isNotNull(), F.row_number().over(w)).otherwise(1))
    return ranked.filter("__r = 1").drop("__r"), ranked.filter("__r > 1").drop("__r")


def appended_curve(stream: DataFrame, target: str, checkpoint: str):
    """Appends a stream of curve rows to `target`, a folder for each batch, so a batch that is tried again repeats nothing.
    `resolved_curve` over the folder gives the current and the superseded rows. The query, which stops once all rows present
    are done."""

    def step(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

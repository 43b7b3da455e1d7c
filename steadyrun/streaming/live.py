"""Incremental forms of the batch operators.

Every runner takes a streaming DataFrame, drains what is there (``availableNow``) and returns the
result as a batch DataFrame over tables in a shared folder. State lives in Spark's checkpoint; results
are written per micro-batch under its id, so a replayed micro-batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from steadyrun.functions.spread import running_totals
from steadyrun.operators import answers, stability
from steadyrun.sources.scratch import shared_dir


def _drain(stream: DataFrame, path: str, mode: str, handle: Callable[[DataFrame, int], None]) -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
    )
    query.awaitTermination()


def _prepare(stream: DataFrame, path: str) -> None:
    """An empty first batch, so that a stream with no input still has a result."""
    empty = stream.sparkSession.createDataFrame([], stream.schema)
    empty.write.mode("overwrite").parquet(f"{path}/batch=-1")


def _latest(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The row of the last micro-batch of each key, with its number."""
    rest = [c for c in changes.columns if c not in key and c != "batch"]
    last = F.max_by(F.struct("batch", *rest), "batch").alias("last")
    return changes.groupBy(*key).agg(last).select(*key, "last.*")


def _first(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is first by ``order``; other columns break ties."""
    rest = [c for c in dict.fromkeys([*order, *rows.columns]) if c not in key]
    return rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("first")).select(*key, "first.*").select(*rows.columns)


def upsert(stream: DataFrame, key: Sequence[str], path: str, slots: int = 4, order: Sequence[str] | None = None) -> DataFrame:
    """Latest row per key of an update-mode stream; with ``order``, the first row per key of a stream of plain rows.

    What a micro-batch brings is written to one of ``slots - 1`` folders in turn, and each ``slots``-th micro-batch is
    folded with them into a snapshot, in one of two folders in turn. So the disk holds two snapshots and ``slots - 1``
    micro-batches, however many there were. A replayed micro-batch writes the same folders again from what those before
    it left.

    Rows of an update-mode stream carry the number of their micro-batch and the last one counts. With ``order`` the first
    one counts, whichever micro-batch brought it; so no state store is needed, and memory is that of an aggregate, which
    spills. Either way it does no harm that a folder is read both before and after folding.
    """
    spark = stream.sparkSession
    schema = stream.schema if order else StructType([*stream.schema.fields, StructField("batch", LongType())])
    changes = [f"{path}/changes/slot={k}" for k in range(slots - 1)]
    sides = [f"{path}/snapshot/side={k}" for k in range(2)]
    nothing = spark.createDataFrame([], schema)
    for part in [*changes, *sides]:
        # Those of an earlier run of the same stream stay.
        nothing.write.mode("ignore").parquet(part)

    def read(*chosen: str) -> DataFrame:
        return spark.read.schema(schema).parquet(*chosen)

    def held(rows: DataFrame) -> DataFrame:
        return _first(rows, key, order) if order else _latest(rows, key)

    last: list[int] = []

    def handle(rows: DataFrame, batch: int) -> None:
        last[:] = [batch]
        told = rows if order else rows.withColumn("batch", F.lit(batch).cast("long"))
        turn, side = batch % slots, batch // slots % 2
        if turn < slots - 1:
            told.write.mode("overwrite").parquet(changes[turn])
        else:
            held(read(*changes, sides[1 - side]).unionByName(told)).write.mode("overwrite").parquet(sides[side])

    _drain(stream, path, "append" if order else "update", handle)
    if last:
        # What came before the last folding is in its snapshot, one row per key.
        since, folded = (last[0] + 1) % slots, (last[0] + 1) // slots
        snapshot = sides[(folded - 1) % 2]
        now = held(read(*changes[:since], snapshot)) if since else read(snapshot)
    else:
        now = held(read(*changes, *sides))
    return now if order else now.drop("batch")


def append(stream: DataFrame, path: str) -> DataFrame:
    """All rows of an append-mode stream."""
    return appended(stream, path).drop("batch")


def appended(stream: DataFrame, path: str) -> DataFrame:
    """All rows of an append-mode stream, with the number of the micro-batch that brought them."""
    spark = stream.sparkSession
    _prepare(stream, f"{path}/rows")

    def handle(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    _drain(stream, path, "append", handle)
    return spark.read.parquet(f"{path}/rows")


def live_cells(trials: DataFrame, order: Sequence[str], path: str | None = None) -> DataFrame:
    """Cells that grow as attempts are logged, equal to the batch ``cells`` of the deduplicated log.

    An attempt counts once, with the copy that is first by ``order``, whichever copy arrives first. What is held is
    one short row per attempt, however many copies there are, and those of the micro-batches not folded yet; it lies
    in the folders of ``upsert``. Trials need an index.
    """
    path = path or shared_dir(trials.sparkSession, "live-cells")
    kept = [*stability.TRIAL_KEY, "accepted", *[c for c in ("latency_ms",) if c in trials.columns]]
    # Problems tell attempts apart best, so most comparisons end there.
    key = ["problem_id", *[c for c in stability.TRIAL_KEY if c != "problem_id"]]
    # Not the folder itself, which may hold the checkpoint of an earlier form that had state.
    attempts = upsert(trials.select(*dict.fromkeys([*kept, *order])), key, f"{path}/attempts", order=order)
    return stability.cells(attempts.select(*kept))


def rank_error(k: int) -> float:
    """How far the rank of a quantile from a sketch of size ``k`` may be off, as a share of all ranks: three times
    what a KLL sketch keeps in 99 of 100 cases. Groups of fewer than ``k`` values are exact."""
    return 3 * 2.446 / k**0.9433


def live_percentiles(
    rows: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], k: int = 1024, path: str | None = None
) -> DataFrame:
    """Percentiles of ``value`` per group as rows arrive, within ``rank_error(k)``; nulls are dropped.

    The state of a group is one mergeable KLL sketch, whose size depends on ``k`` and hardly on the rows. Copies of
    a row count again.
    """
    path = path or shared_dir(rows.sparkSession, "live-percentiles")
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch")
    held = upsert(rows.where(F.col(value).isNotNull()).groupBy(*by).agg(sketch), by, path)
    values = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in probs.items()]
    return held.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), *values)


def dedupe_intake(
    trials: DataFrame, path: str | None = None, event_time: str | None = None, delay: str = "7 days"
) -> DataFrame:
    """Each attempt once, however often a resumed run logs it.

    With ``event_time`` the state is dropped after ``delay``: a copy that comes later than that passes
    here and is counted once by the batch operator only. Without it the state keeps every key.
    """
    path = path or shared_dir(trials.sparkSession, "live-intake")
    if event_time is None:
        return append(trials.dropDuplicates(stability.TRIAL_KEY), path)
    marked = trials.withColumn("__at", F.col(event_time).cast("timestamp")).withWatermark("__at", delay)
    return append(marked.dropDuplicatesWithinWatermark(stability.TRIAL_KEY).drop("__at"), path)


def live_job_state(events: DataFrame, path: str | None = None) -> DataFrame:
    """Last known state of every (model, prompt) job."""
    path = path or shared_dir(events.sparkSession, "live-jobs")
    latest = events.groupBy("model_id", "prompt_type").agg(
        F.max_by(F.struct("status", "normalized_exists"), F.struct("ts", "event_id")).alias("last")
    )
    return upsert(latest, ["model_id", "prompt_type"], path).select("model_id", "prompt_type", "last.*")


def live_collect(lines: DataFrame, manifest: DataFrame, path: str | None = None) -> DataFrame:
    """Chat answers joined to a fixed manifest as their files arrive."""
    path = path or shared_dir(lines.sparkSession, "live-collect")
    parsed = answers.chat_answers(lines).select("custom_id", "text", "input_tokens", "output_tokens", "error")
    return append(parsed.join(manifest, "custom_id"), path)


def live_collect_finished(
    arrivals: DataFrame, states: DataFrame, path: str | None = None,
    longest: str = "30 days", grace: str = "7 days", delay: str = "7 days",
) -> DataFrame:
    """Answers of jobs that are completed, with done_at, when that was, and ``late``: whether they came after it.

    ``arrivals`` has model_id, prompt_type, custom_id and at; ``states`` has model_id, prompt_type, status and at.
    Answers of jobs that never complete are not there. Both streams wait for each other: an answer for a completion
    up to ``longest`` after it, a completion for answers up to ``grace`` after it; state older than that and the
    watermarks' ``delay`` is dropped. A job completed again later keeps its first completion; an answer with the
    same columns that arrives again counts once.
    """
    path = path or shared_dir(arrivals.sparkSession, "live-finished")
    came = arrivals.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)
    done = states.where("status = 'completed'").select(
        F.col("model_id").alias("__model"), F.col("prompt_type").alias("__prompt"), F.col("at").cast("timestamp").alias("done_at")
    ).withWatermark("done_at", delay)
    met = came.join(
        done,
        (F.col("model_id") == F.col("__model")) & (F.col("prompt_type") == F.col("__prompt"))
        & F.expr(f"at >= done_at - interval {longest} and at <= done_at + interval {grace}"),
    ).drop("__model", "__prompt")
    first = append(met, path).groupBy(*arrivals.columns).agg(F.min("done_at").alias("done_at"))
    return first.withColumn("late", F.col("at") > F.col("done_at"))


RUN_STATE = "open boolean, lead bigint, trail bigint"
RUN_EVENTS = (
    "account bigint, span bigint, kind string, event_id bigint, place bigint, open boolean, lead bigint, trail bigint"
)


def _run_processor(threshold: int, span_seconds: int):
    """A processor of (account, span): made here, so that it travels by value."""
    from pyspark.sql.streaming import StatefulProcessor

    class Runs(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.run = handle.getValueState("run", RUN_STATE)

        def handleInputRows(self, key, rows, timers):
            import pandas as pd

            (account, span), part = key, pd.concat(list(rows))
            part = part.sort_values(["ts", "event_id"])
            known = self.run.exists()
            open_, lead, trail = self.run.get() if known else (True, 0, 0)
            out = []
            for event, submitted in zip(part["event_id"].tolist(), part["submission_id"].notna().tolist()):
                if submitted:
                    open_, trail = False, 0
                    continue
                trail += 1
                lead += open_
                if open_ and lead <= threshold:
                    out.append((account, span, "leading", event, lead, None, None, None))
                elif not open_ and trail == threshold:
                    out.append((account, span, "breach", event, trail, None, None, None))
            self.run.update((open_, lead, trail))
            if not known:
                # Until the watermark passes the end of the span.
                self.handle.registerTimer((span + 1) * span_seconds * 1000)
            out.append((account, span, "span", None, None, open_, lead, trail))
            names = ["account", "span", "kind", "event_id", "place", "open", "lead", "trail"]
            frame = pd.DataFrame(out, columns=names)
            counts = ["account", "span", "event_id", "place", "lead", "trail"]
            yield frame.astype({**{c: "Int64" for c in counts}, "open": "boolean"})

        def handleExpiredTimer(self, key, timers, info):
            import pandas as pd

            self.run.clear()
            yield pd.DataFrame()

        def close(self) -> None:
            pass

    return Runs()


def live_failure_runs(
    submissions: DataFrame, threshold: int = 10, path: str | None = None, span_seconds: int = 3600, delay: str = "30 days"
) -> DataFrame:
    """The attempt at which an account's run of failures reaches the threshold.

    A state processor keeps, per account and span of time, whether it had a success yet, the failures before the
    first and those after the last one; so an account with most of the attempts is many keys. It tells breaches
    within a span at once. The failures a span begins with are told with their place, ``threshold`` of them at
    most, as they may go on a run of the spans before; that is settled by one pass over the spans' short rows.

    State is three numbers a span, dropped when the watermark (``delay`` behind the latest attempt) passes the
    span's end; attempts later than that are left out. Attempts that a later micro-batch brings for a span count
    as later than those it had. The state store must be RocksDB; it is set for this query.
    """
    spark = submissions.sparkSession
    path = path or shared_dir(spark, "live-failures")
    tried = submissions.where("has_code").select(
        F.col("account").cast("bigint").alias("account"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").cast("bigint").alias("event_id"), F.col("submission_id").cast("bigint").alias("submission_id"),
    ).withWatermark("ts", delay)
    span = F.floor(F.unix_seconds("ts") / span_seconds).alias("span")
    told = tried.withColumn("span", span).groupBy("account", "span").transformWithStateInPandas(
        _run_processor(threshold, span_seconds), RUN_EVENTS, "Append", "EventTime"
    )
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = appended(told, path)
    finally:
        spark.conf.set(name, before)
    return settled_breaches(rows, threshold)


def settled_breaches(rows: DataFrame, threshold: int) -> DataFrame:
    """(account, event_id) of all breaches, from what the processor told, with ``batch``."""
    spans = rows.where("kind = 'span'").groupBy("account", "span").agg(
        F.max_by(F.struct("open", "lead", "trail"), "batch").alias("last")
    ).select("account", "span", "last.*")
    # A run goes on over spans without a success; it starts with what the last one with a success left over.
    closed = F.when(F.col("open"), 0).otherwise(1).cast("bigint")
    order = [F.col("span")]
    told = running_totals(spans, ["account"], order, {"closed": closed, "failed": F.when(F.col("open"), F.col("lead")).otherwise(0)})
    at = told.withColumn("closed_before", F.col("closed") - closed).withColumn("failed_before", F.col("failed") - F.when(F.col("open"), F.col("lead")).otherwise(0))
    starts = at.where(~F.col("open")).select("account", F.col("closed").alias("closed_before"), "trail", F.col("failed").alias("base"))
    carried = at.select("account", "span", "closed_before", "failed_before").join(starts, ["account", "closed_before"], "left")
    carried = carried.select(
        "account", "span", (F.coalesce("trail", F.lit(0)) + F.col("failed_before") - F.coalesce("base", F.lit(0))).alias("carried")
    )
    leading = rows.where("kind = 'leading'").join(carried, ["account", "span"])
    reached = leading.where(F.col("carried") + F.col("place") == threshold).select("account", "event_id")
    return reached.union(rows.where("kind = 'breach'").select("account", "event_id"))

"""Streams drained over whole tables; each equals its batch twin."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from steadyrun.functions.spread import join_groups
from steadyrun.operators import stability
from steadyrun.plans.common import LOG_ORDER, sql
from steadyrun.plans.q_answers import OUT_TOKENS, PARTS, chat_lines
from steadyrun.plans.q_stability import BY, RATES, rates
from steadyrun.sources.scratch import shared_dir, stored
from steadyrun.sources.tables import view
from steadyrun.streaming import live

QUERIES = {}


def arrived(run, *sources):
    """What ``run`` gives for streams that arrive in turns; each of ``sources`` is (df, time column, turns).

    A turn is a range of the time, rows without one coming first, and is written by the tasks that read ``df``, so it
    is many files. It has landed as a whole before the runner drains the streams again from their checkpoint: turns
    come in their order, one micro-batch each. A file stream alone would go by when each file was written.
    """
    spark = sources[0][0].sparkSession
    checkpoint = shared_dir(spark, "live")
    landed = []
    for df, order, turns in sources:
        shares = [k / turns for k in range(1, turns)]
        bounds = stored(df.agg(F.percentile_approx(order, shares, 1000).alias("bounds")), "bounds").select("bounds").scalar()
        # A row without a time is of the first turn.
        passed = [F.when(F.col(order) > F.get(bounds, F.lit(k)), 1).otherwise(0) for k in range(turns - 1)]
        turn = sum(passed, F.lit(0))
        landed.append((df.withColumn("__turn", turn), shared_dir(spark, "arriving"), turns, df.schema))
    for k in range(max(turns for _, _, turns, _ in landed)):
        for told, path, turns, _ in landed:
            if k < turns:
                told.where(F.col("__turn") == k).drop("__turn").write.mode("append").parquet(path)
        streams = [spark.readStream.schema(schema).parquet(path) for _, path, _, schema in landed]
        result = run(*streams, path=checkpoint)
    return result


def log(spark, sf):
    """The log; copies of an attempt are logged on different days, so in different turns."""
    return stability.with_labels(view(spark, sf, "v_trial_log")), "logged_at", 4


QUERIES["stream_stability"] = (
    lambda spark, sf: rates(
        stability.cell_totals(arrived(partial(live.live_cells, order=LOG_ORDER), log(spark, sf)), BY)
    ),
    sql(f"select model_name, strategy, {RATES} from cells group by model_name, strategy"),
)
QUERIES["stream_dedupe"] = (
    # Copies of an attempt may be logged years apart.
    lambda spark, sf: arrived(
        partial(live.dedupe_intake, event_time="logged_at", delay="3000 days"), log(spark, sf)
    ).select(*stability.TRIAL_KEY),
    sql("select distinct model_name, problem_id, strategy, trial_index from log"),
)
QUERIES["stream_job_state"] = (
    lambda spark, sf: arrived(live.live_job_state, (view(spark, sf, "v_job_state"), "ts", 6)),
    sql("""select model_id, prompt_type, status, normalized_exists from (
  select *, row_number() over (partition by model_id, prompt_type order by ts desc, event_id desc) as rn from v_job_state) t
where rn = 1"""),
)


def collected(spark, sf):
    lines = chat_lines(view(spark, sf, "v_answers", streams=["documents"]))
    manifest = view(spark, sf, "v_manifest").select("custom_id", "problem_id", "prompt_type", "trial_index")
    return live.live_collect(lines, manifest).withColumn("text", F.md5("text"))


QUERIES["stream_collect"] = (
    collected,
    sql(f"""select m.custom_id, m.problem_id, m.prompt_type, m.trial_index, md5({PARTS}) as text, input_tokens,
       {OUT_TOKENS} as output_tokens, case when error is not null then concat('{{"code":"', error, '"}}') end as error
from v_answers a join (select custom_id, problem_id, prompt_type, trial_index from v_manifest) m on a.custom_id = m.custom_id"""),
)
QUERIES["stream_failure_runs"] = (
    lambda spark, sf: arrived(
        partial(live.live_failure_runs, threshold=5), (view(spark, sf, "v_submissions"), "ts", 3)
    ),
    sql("""with c as (select *, sum(case when submission_id is not null then 1 else 0 end)
       over (partition by account order by ts, event_id rows unbounded preceding) as island
     from v_submissions where has_code),
f as (select account, event_id, row_number() over (partition by account, island order by ts, event_id) as k
      from c where submission_id is null)
select account, event_id from f where k = 5"""),
)


def latencies_live(spark, sf):
    """Percentiles of all logged latencies from sketches, and whether their ranks are within the stated bound."""
    probs = {"p50": 0.5, "p90": 0.9}
    log = stability.with_labels(view(spark, sf, "v_trial_log")).where("latency_ms <> 0").select(*BY, "logged_at", "latency_ms")
    run = partial(live.live_percentiles, by=BY, value="latency_ms", probs=probs, k=512)
    found = stored(arrived(run, (log, "logged_at", 4)), "percentiles")
    counts = [
        F.avg(F.when(F.col("latency_ms") < F.col(p), 1.0).otherwise(0.0)).alias(f"{p}_below") for p in probs
    ] + [F.avg(F.when(F.col("latency_ms") <= F.col(p), 1.0).otherwise(0.0)).alias(f"{p}_upto") for p in probs]
    ranks = join_groups(log, found, BY).groupBy(*BY, "n").agg(*counts)
    bound = live.rank_error(512)
    return ranks.select(
        *BY, "n",
        *[((F.col(f"{p}_below") <= share + bound) & (F.col(f"{p}_upto") >= share - bound)).alias(f"{p}_within") for p, share in probs.items()],
    )


QUERIES["stream_latency"] = (
    latencies_live,
    sql("""select model_name, strategy, count(*) as n, true as p50_within, true as p90_within
from log where latency_ms <> 0 group by model_name, strategy"""),
)


START = 1_700_000_000


def arrivals(spark, sf):
    """Answers arrive a second apart, from a fixed time on."""
    at = F.timestamp_seconds(F.col("doc_id") + START).alias("at")
    return view(spark, sf, "v_answers").select("custom_id", "model_id", "prompt_type", at)


def job_events(spark, sf):
    """Each job runs from its first answer; all but one kind complete when nine tenths of the seconds are over."""
    ends = F.floor((F.max("at").cast("long") - START) * 9 / 10) + START
    jobs = arrivals(spark, sf).groupBy("model_id", "prompt_type").agg(F.min("at").alias("first"), F.timestamp_seconds(ends).alias("last"))
    lost = (F.col("model_id") == "gpt-4o") & (F.col("prompt_type") == "minimal")
    end = F.when(lost, "failed").otherwise("completed")
    events = F.array(
        F.struct(F.lit("in_progress").alias("status"), F.col("first").alias("at")), F.struct(end.alias("status"), F.col("last").alias("at"))
    )
    return jobs.select("model_id", "prompt_type", F.inline(events))


QUERIES["stream_collect_finished"] = (
    lambda spark, sf: arrived(
        live.live_collect_finished, (arrivals(spark, sf), "at", 3), (job_events(spark, sf), "at", 2)
    ).select("custom_id", "model_id", "late"),
    sql("""with jobs as (
  select model_id, prompt_type, max(doc_id) * 9 // 10 as done from v_answers group by model_id, prompt_type)
select distinct a.custom_id, a.model_id, a.doc_id > j.done as late
from v_answers a join jobs j on a.model_id = j.model_id and a.prompt_type = j.prompt_type
where not (a.model_id = 'gpt-4o' and a.prompt_type = 'minimal')"""),
)

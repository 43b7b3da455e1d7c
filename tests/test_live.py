"""Streams over many files equal the batch operators."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from steadyrun.operators import crossrun, stability
from steadyrun.plans import q_answers, q_live
from steadyrun.sources.tables import view
from steadyrun.streaming import live


@pytest.fixture(scope="module")
def split(spark, sf, tmp_path_factory):
    """Write a view as several files, oldest first, and read it back as a stream of one file a trigger."""

    def run(df, order, parts=4):
        base = tmp_path_factory.mktemp("split")
        whole = str(base / "whole")
        df.repartitionByRange(parts, order).sortWithinPartitions(order).write.parquet(whole)
        files = base / "files"
        files.mkdir()
        names = sorted(f for f in os.listdir(whole) if f.endswith(".parquet"))
        for i, name in enumerate(names):
            shutil.copy(os.path.join(whole, name), files / f"{i}.parquet")
            os.utime(files / f"{i}.parquet", (1000 + i * 60, 1000 + i * 60))
        reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(str(files)), spark.read.parquet(str(files))

    return run


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_cells(spark, sf, split):
    log = stability.with_labels(view(spark, sf, "v_trial_log"))
    # One long cell, so that later files change blocks that earlier ones wrote.
    long = spark.range(200).select(
        F.lit("m").alias("model_name"), F.lit("long").alias("problem_id"), F.lit("minimal").alias("strategy"),
        F.col("id").cast("int").alias("trial_index"), (F.col("id") >= 130).cast("int").alias("accepted"),
        F.lit(None).cast("timestamp").alias("logged_at"),
    )
    order = ["logged_at", *[f"tie_{i}" for i in range(1, 8)]]
    df = log.select(*stability.TRIAL_KEY, "accepted", *order).unionByName(long, allowMissingColumns=True)
    # Copies of an attempt fall into different files, the later day first in one of two.
    stream, batch = split(df, "tie_1")
    batch = stability.dedupe_trials(batch, [F.col(c) for c in order])
    cols = [*stability.CELL, "n", "a", "first_pass", "first_accepted"]
    got = live.live_cells(stream, order)
    assert rows(got, *cols) == rows(stability.cells(batch), *cols)
    assert got.where("problem_id = 'long'").first().first_accepted == 131


def test_dedupe(spark, sf, split):
    log = stability.with_labels(view(spark, sf, "v_trial_log")).drop("ts")
    stream, batch = split(log, "logged_at")
    want = rows(batch.select(*stability.TRIAL_KEY).distinct(), *stability.TRIAL_KEY)
    assert rows(live.dedupe_intake(stream), *stability.TRIAL_KEY) == want
    stream, _ = split(log, "logged_at")
    kept = live.dedupe_intake(stream, event_time="logged_at", delay="36500 days")
    assert rows(kept, *stability.TRIAL_KEY) == want


def test_job_state(spark, sf, split):
    stream, batch = split(view(spark, sf, "v_job_state"), "event_id")
    cols = ["model_id", "prompt_type", "status", "normalized_exists"]
    want = crossrun.latest_state(batch, cols[:2], cols[2:])
    assert rows(live.live_job_state(stream), *cols) == rows(want, *cols)


@pytest.mark.parametrize("parts, threshold", [(1, 3), (5, 3), (9, 2)])
def test_failure_runs(spark, sf, split, parts, threshold):
    df = view(spark, sf, "v_submissions").withColumn("account", F.col("account") % 3)
    stream, batch = split(df, "ts", parts)
    want, run = [], {}
    for r in sorted(batch.collect(), key=lambda r: (r.ts, r.event_id)):
        if r.has_code:
            run[r.account] = 0 if r.submission_id is not None else run.get(r.account, 0) + 1
            if run[r.account] == threshold:
                want.append((r.account, r.event_id))
    assert rows(live.live_failure_runs(stream, threshold), "account", "event_id") == sorted(want)


def test_collect(spark, sf, split):
    lines = q_answers.chat_lines(view(spark, sf, "v_answers"))
    stream, batch = split(lines, "doc_id")
    manifest = view(spark, sf, "v_manifest").select("custom_id", "problem_id")
    got = live.live_collect(stream, manifest)
    assert got.count() == batch.count() and got.select("custom_id").distinct().count() == batch.count()


def test_turns_arrive_in_order_and_are_many_files(spark):
    times = spark.range(4000).select(F.timestamp_seconds(F.col("id") * 60).alias("at"), F.col("id").alias("k"))
    times = times.unionByName(spark.range(1).select(F.lit(None).cast("timestamp").alias("at"), (F.col("id") - 1).alias("k")))
    seen = []

    def run(first, second, path):
        new = live.append(first, path + "/first"), live.append(second, path + "/second")
        seen.append(tuple(df.agg(F.count("k"), F.max("k"), F.min("k")).first() for df in new))
        return new

    first, second = q_live.arrived(run, (times.repartition(6), "at", 4), (times.repartition(6), "at", 2))
    assert [s[0] for s in seen] == [(n + 1, n - 1, -1) for n in (s[0][0] - 1 for s in seen)]
    assert len({s[0] for s in seen}) == 4 and [s[1][0] for s in seen[1:]] == [4001] * 3 and seen[0][1][0] < 4001
    assert rows(first, "k") == rows(second, "k") == rows(times, "k")
    # No task writes a whole turn.
    assert len(first.inputFiles()) >= 8


@pytest.mark.parametrize("batches", [1, 3, 4, 5, 7, 8, 9])
def test_upserts_read_what_the_last_folding_left(spark, tmp_path, batches):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in range(batches):
        spark.range(k, k + 3).select("id", F.lit(k).alias("v")).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id long, v int").parquet(str(source))
        got = live.upsert(stream.groupBy("id").agg(F.max("v").alias("v")), ["id"], out)
        if k % 2 or k == batches - 1:
            assert rows(got, "id", "v") == [(i, min(i, k)) for i in range(k + 3)]
    # Folded changes are not put together again.
    assert ("HashAggregate" in (plan := got._jdf.queryExecution().executedPlan().toString()) or "SortAggregate" in plan) == (batches % 4 > 0)
    again = live.upsert(stream.groupBy("id").agg(F.max("v").alias("v")), ["id"], out)
    assert rows(again, "id", "v") == rows(got, "id", "v")


def test_disk_and_replay_of_upserts(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = "k int, v int"

    def arrive(lo, hi):
        for n in range(lo, hi):
            part = str(tmp_path / f"part{n}")
            spark.createDataFrame([(k, n) for k in range(50) if n == 0 or k % 10 == n % 10], schema).coalesce(1).write.parquet(part)
            name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
            shutil.copy(os.path.join(part, name), source / f"{n:03d}.parquet")
            os.utime(source / f"{n:03d}.parquet", (1000 + n, 1000 + n))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        return live.upsert(stream.groupBy("k").agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("n")), ["k"], out)

    def want(files):
        held = {k: [n for n in range(files) if n == 0 or k % 10 == n % 10] for k in range(50)}
        return sorted((k, max(v), len(v)) for k, v in held.items())

    assert rows(arrive(0, 9), "k", "v", "n") == want(9)
    # The stream goes on from where it was; its last micro-batch, folded already, is written again.
    assert rows(arrive(9, 20), "k", "v", "n") == want(20)
    on_disk = sum(spark.read.parquet(f"{out}/{d}").count() for d in ("changes", "snapshot"))
    assert on_disk <= 2 * 50 + 4 * 50
    os.remove(f"{out}/checkpoint/commits/19")
    crc = f"{out}/checkpoint/commits/.19.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert rows(arrive(20, 20), "k", "v", "n") == want(20)


@pytest.mark.parametrize("files", [1, 3, 4, 6, 9])
def test_first_rows_without_state(spark, tmp_path, files):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    # Copies of a key come in later and in earlier micro-batches than the first one, and twice in one; some have no time.
    data = [(k, (k * 7 + n * 5) % 11 or None, (k + n * 3) % 4, f"{k}-{n}") for n in range(files) for k in range(40) if (k + n) % 3 or n == 0]
    for n in range(files):
        mine = [r for r in data if r[3].endswith(f"-{n}")]
        spark.createDataFrame(mine + mine[:5], "k int, at int, tie int, v string").coalesce(1).write.parquet(part := str(tmp_path / f"part{n}"))
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        shutil.copy(os.path.join(part, name), source / f"{n}.parquet")
        os.utime(source / f"{n}.parquet", (1000 + n, 1000 + n))
    want = sorted(min((r for r in data if r[0] == k), key=lambda r: (r[1] or 0, r[2], r[3])) for k in range(40))

    def run():
        stream = spark.readStream.schema("k int, at int, tie int, v string").option("maxFilesPerTrigger", 1).parquet(str(source))
        return rows(live.upsert(stream, ["k"], out, order=["at", "tie"]), "k", "at", "tie", "v")

    assert run() == want and run() == want
    # The last micro-batch is written again.
    for name in (f"{files - 1}", f".{files - 1}.crc"):
        if os.path.exists(f"{out}/checkpoint/commits/{name}"):
            os.remove(f"{out}/checkpoint/commits/{name}")
    assert run() == want
    assert spark.read.parquet(*(f"{out}/snapshot/side={s}" for s in range(2))).count() <= 2 * 40


def test_cells_keep_no_state(spark, sf, split, tmp_path):
    """A state store holds every attempt in memory, which at 60 copies of the log was more than 12 GB."""
    log = stability.with_labels(view(spark, sf, "v_trial_log"))
    order = ["logged_at", *[f"tie_{i}" for i in range(1, 8)]]
    stream, batch = split(log.drop("ts"), "tie_1", 6)
    got = live.live_cells(stream, order, str(tmp_path))
    batch = stability.dedupe_trials(batch, [F.col(c) for c in order])
    cols = [*stability.CELL, "n", "a", "first_pass", "first_accepted", "latencies"]
    assert rows(got, *cols) == rows(stability.cells(batch), *cols)
    assert list(tmp_path.glob("**/checkpoint/commits/5")) and not list(tmp_path.glob("**/checkpoint/state"))


def test_percentiles_from_sketches(spark, split):
    import random

    rng = random.Random(4)
    data = [(rng.choice(["a", "a", "a", None]), i, rng.choice([None, rng.lognormvariate(0, 2)])) for i in range(9000)]
    stream, _ = split(spark.createDataFrame(data, "g string, i int, v double"), "i", 5)
    got = {r.g: r for r in live.live_percentiles(stream, ["g"], "v", {"p10": 0.1, "p90": 0.9}, k=256).collect()}
    for g in ("a", None):
        values = sorted(v for h, _, v in data if h == g and v is not None)
        assert got[g].n == len(values)
        for name, p in (("p10", 0.1), ("p90", 0.9)):
            rank = sum(v <= got[g][name] for v in values) / len(values)
            assert abs(rank - p) <= live.rank_error(256)


def test_answers_of_finished_jobs(spark, split):
    answers = [(f"a{n}", ["x", "y", "z"][n % 3], "minimal", 100 + n) for n in range(30)]
    events = [("x", "minimal", "completed", 115), ("x", "minimal", "completed", 500), ("y", "minimal", "failed", 110), ("z", "minimal", "in_progress", 90)]
    a = spark.createDataFrame(answers, "custom_id string, model_id string, prompt_type string, s long").withColumn("at", F.timestamp_seconds("s"))
    e = spark.createDataFrame(events, "model_id string, prompt_type string, status string, s long").withColumn("at", F.timestamp_seconds("s"))
    came, _ = split(a, "at", 3)
    states, _ = split(e.drop("s"), "at", 2)
    got = rows(live.live_collect_finished(came, states), "custom_id", "late")
    assert got == sorted((i, s > 115) for i, m, _, s in answers if m == "x")


def test_no_input(spark, tmp_path):
    schema = "model_id string, prompt_type string, event_id bigint, ts timestamp, status string, normalized_exists boolean"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path))
    assert live.live_job_state(stream).count() == 0

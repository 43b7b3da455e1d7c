"""Files in, files out."""

import hashlib
import json
import os
import pathlib
import time

import pytest
from pyspark.sql import functions as F

from steadyrun.operators import crossrun, problems as prob, stability
from steadyrun.plans import q_crossrun, q_sources
from steadyrun.sources import json_arrays, readers, writers
from steadyrun.sources.scratch import shared_dir


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def trial(**more):
    return json.dumps({"model_name": "m", "problem_id": "1", "strategy": "with_prompt", "trial_index": 0, "status": "Accepted", **more})


def test_trial_archive(spark, tmp_path):
    a = put(tmp_path / "a" / "x.jsonl", "\n".join([trial(), "", "{broken", trial(trial_index=1, strategy="")]) + "\n")
    put(tmp_path / "b" / "x.jsonl", trial(accepted_bool=1) + "\n")
    put(tmp_path / "b" / "notes.txt", trial() + "\n")
    dirs = [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "a")]
    rows = readers.read_trial_archive(spark, dirs)
    assert rows.count() == 3
    assert sorted(r.strategy for r in rows.collect()) == ["default", "detailed", "detailed"]
    assert rows.agg(F.sum("accepted_bool")).first()[0] == 1
    once = stability.dedupe_trials(rows, [F.col("source_file")])
    assert once.count() == 2
    assert readers.bad_lines(spark, a).first().bad_lines == 1
    assert readers.read_trials(spark, a).count() == 2


def test_drifting_types_keep_the_row(spark, tmp_path):
    lines = [
        trial(trial_index=0, runtime_percentile="N/A"), trial(trial_index=1, latency_ms="12.5"),
        trial(trial_index=2, accepted_bool=True), trial(trial_index=3, prompt_tokens=1.5), trial(trial_index=4),
        trial(trial_index="5", raw_response={"a": [1]}), "[1, 2]", "7", '{"model_name": "m"',
    ]
    path = put(tmp_path / "d" / "x.jsonl", "\n".join(lines) + "\n")
    rows = readers.read_trial_archive(spark, [str(tmp_path / "d")])
    for columns in (rows.columns, ["model_name"], ["runtime_percentile"], ["model_name", "accepted_bool"]):
        assert len(rows.select(*columns).collect()) == 6
    assert rows.count() == 6
    got = {r.trial_index: r for r in rows.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    assert (got[0].runtime_percentile, got[1].latency_ms, got[2].accepted_bool, got[3].prompt_tokens) == (None, 12.5, 1, 2)
    assert got[5].raw_response == '{"a":[1]}'
    assert [(r.field, r["values"]) for r in readers.bad_fields(spark, path).collect()] == [("runtime_percentile", 1)]
    assert readers.bad_lines(spark, path).first().bad_lines == 3


def test_problem_order_follows_the_paths(spark, tmp_path):
    a = put(tmp_path / "a.json", json.dumps([{"question_id": 1, "title_slug": "a"}]))
    b = put(tmp_path / "b.json", json.dumps([{"question_id": k, "title_slug": "b" * 9000} for k in (2, 3)]))
    for paths, want in (([a, b], ["1", "2", "3"]), ([b, a], ["2", "3", "1"])):
        rows = readers.read_problems(spark, paths)
        assert [r.question_id for r in rows.orderBy("seq").collect()] == want


def test_a_file_of_an_array_is_many_tasks(spark, tmp_path):
    odd = ['plain', 'brace } in { text', 'quote " and \\ and \\" }', "}\n{", "ünïcode }", "", "x" * 3000, '"}', "\\"]
    rows = [{"problem_id": str(k), "title": odd[k % len(odd)], "topics": [odd[(k * 7) % len(odd)]] * (k % 3),
             "with_prompt": [{"status": odd[(k + j) % len(odd)]} for j in range(k % 4)]} for k in range(400)]
    forms = {"indented.json": json.dumps(rows, indent=2), "compact.json": json.dumps(rows, separators=(",", ":")), "empty.json": "[]", "blank.json": " \n"}
    for name, text in forms.items():
        put(tmp_path / "all" / name, text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        path = str(tmp_path / "all" / "indented.json")
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 10
        for ranges in (None, 23):
            got = json_arrays.elements(spark, [path], ranges).orderBy("seq").collect()
            assert [json.loads(r.text) for r in got] == rows
        both = json_arrays.elements(spark, [str(tmp_path / "all")]).orderBy("seq").collect()
        assert [json.loads(r.text) for r in both] == rows + rows
        got = readers.read_results(spark, path).orderBy(F.col("problem_id").cast("int")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.problem_id, r.title, r.topics, [a.status for a in r.with_prompt]) for r in got] == [
        (r["problem_id"], r["title"], r["topics"], [a["status"] for a in r["with_prompt"]]) for r in rows
    ]


def test_bad_elements_of_arrays(spark, tmp_path):
    path = put(tmp_path / "x.json", '[{"problem_id": "1"}, {"problem_id": bad}, {"problem_id": "3", "title": "t}"}, {"problem_id": "4", "title": {"a')
    assert [r.problem_id for r in readers.read_results(spark, path).collect()] == ["1", "3"]
    assert readers.read_problems(spark, put(tmp_path / "e.json", "")).count() == 0


def test_written_arrays_are_valid_and_in_order(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("problem_id"), F.concat(F.lit("t}\""), "id").alias("title")).repartition(7)
    json_arrays.write_array(df, str(tmp_path / "a"), [F.col("problem_id")], files=3)
    files = sorted((tmp_path / "a").glob("*/*.txt"))
    assert [r["problem_id"] for f in files for r in json.loads(f.read_text())] == list(range(1000)) and len(files) == 3
    back = json_arrays.elements(spark, [str(f.parent) for f in files]).orderBy("seq").collect()
    assert [json.loads(r.text)["problem_id"] for r in back] == list(range(1000))


def test_summaries_are_written_compressed_in_files_of_bounded_size(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(q_crossrun, "ROWS_PER_FILE", 100)
    monkeypatch.setattr(q_crossrun, "shared_dir", lambda spark, label: str(tmp_path / label))
    rows = q_crossrun.summaries_read(spark, sf).count()
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    files = list((tmp_path / "summaries").glob("*/part-*"))
    assert len(files) == -(-orders // 100) > 4 and all(f.name.endswith(".txt.lz4") for f in files)
    assert 0 < rows <= orders


def test_large_arrays_are_one_file_a_range(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        title = F.repeat(F.md5(F.col("id").cast("string")), F.lit(20)).alias("title")
        df = spark.range(100_000).select(F.col("id").alias("problem_id"), title).repartition(31)
        for name, files in (("four", 4), ("all", None)):
            json_arrays.write_array(df, str(tmp_path / name), [F.col("problem_id")], *[files] * (files is not None))
            found = sorted((tmp_path / name).glob("*/*.txt"))
            assert len(found) == (files or 40)
            assert [r["problem_id"] for f in found for r in json.loads(f.read_text())] == list(range(100_000))
        got = readers.read_problems(spark, str(tmp_path / "all")).orderBy("seq").select("problem_id").limit(500).collect()
        assert [int(r.problem_id) for r in got] == list(range(500))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_arrays_are_read_without_moving_their_text(spark, tmp_path):
    path = put(tmp_path / "a.json", json.dumps([{"problem_id": str(k), "title": "t}" * 50} for k in range(2000)], indent=1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        plan = json_arrays.elements(spark, [path])._jdf.queryExecution().executedPlan().toString()
        assert [json.loads(r.text)["problem_id"] for r in json_arrays.elements(spark, [path]).orderBy("seq").collect()] == [str(k) for k in range(2000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # Only the parts of elements that go over the end of a split are shuffled, not the whole ones.
    whole = plan[:plan.index("NOT whole")]
    assert "whole" in whole and "Exchange hashpartitioning(file" not in whole.split("Union")[1].split("FileScan")[0]


@pytest.mark.parametrize("name, files", [("trial_archive", "archive-*/*.json.lz4"), ("results_flat", "results-*/*/*.txt.lz4")])
def test_written_archives_and_results_are_compressed(spark, sf, name, files):
    base = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(base.glob(files))
    q_sources.QUERIES[name][0](spark, sf)
    assert len(set(base.glob(files)) - before) > 0


def test_cells_of_a_trial_table_move_no_attempts(spark, tmp_path):
    cols = "model_name string, problem_id string, strategy string, trial_index int, accepted int"
    rows = [(f"m{k % 3}", f"p{k % 17}", ["detailed", "minimal"][k % 2], k // 34, int(k % 5 > 1)) for k in range(2000)]
    df = spark.createDataFrame(rows, cols)
    for part in (df.where("trial_index < 30"), df.where("trial_index >= 30")):
        writers.write_trial_table(part, "trials_by_cell", str(tmp_path / "t"), buckets=4)
    try:
        read = spark.table("trials_by_cell")
        assert read.count() == 2000
        got = stability.cells(read.where("model_name = 'm1'"))
        plan = got._jdf.queryExecution().toString()
        physical = plan[plan.index("== Physical Plan =="):]
        assert "Exchange" not in physical and "model_name" in physical.split("PartitionFilters")[1][:80]
        want = stability.cells(df.where("model_name = 'm1'"))
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
        assert all("Exchange hashpartitioning" not in line for line in stability.cell_counts(read)._jdf.queryExecution().toString().splitlines())
    finally:
        spark.sql("drop table trials_by_cell")


def test_results_file(spark, tmp_path):
    doc = [{"problem_id": "1", "title": "T", "difficulty": " hard", "topics": ["A", "B"],
            "with_prompt": [{"status": "Accepted", "latency_ms": "12.5"}, {"status": "Wrong Answer", "latency_ms": "x"}],
            "without_prompt": [{"status": "Accepted"}, {"status": "Accepted"}]},
           {"problem_id": "2", "title": "U", "difficulty": "Easy", "topics": [], "with_prompt": []}]
    rows = readers.flatten_results(readers.read_results(spark, put(tmp_path / "r.json", json.dumps(doc, indent=2)))).collect()
    assert len(rows) == 4
    assert [(r.strategy, r.trial_index, r.status, r.latency_ms) for r in rows][:2] == [("detailed", 0, "Accepted", 12.5), ("detailed", 1, "Wrong Answer", None)]
    assert rows[0].difficulty == "Hard" and rows[0].topics == "A, B"


def test_problem_file(spark, tmp_path):
    docs = [{"question_id": 5, "frontend_question_id": 1, "title_slug": "a", "difficulty": "EASY"},
            {"backend_question_id": 6, "problem_id": "2", "title_slug": "b", "difficulty": "Medium", "isPaidOnly": True},
            {"question_id": 7, "title_slug": "c", "difficulty": "easy "}]
    rows = readers.read_problems(spark, put(tmp_path / "p.json", json.dumps(docs)))
    got = [(r.question_id, r.frontend_question_id, r.difficulty) for r in prob.load_problems(rows).orderBy("seq").collect()]
    assert got == [("5", "1", "Easy"), ("6", "2", "Medium"), ("7", "7", "Easy")]
    assert [r.question_id for r in prob.load_problems(rows, "easy", 1).collect()] == ["5"]
    assert [r.title_slug for r in prob.select_problems(rows, limit=1, offset=1, skip_premium=True).collect()] == ["c"]
    assert [r.title_slug for r in prob.select_problems(rows, offset=2).collect()] == ["c"]
    assert prob.select_problems(rows, offset=9).count() == 0
    bad = readers.read_problems(spark, put(tmp_path / "bad.json", json.dumps([{"title_slug": "zz"}])))
    with pytest.raises(Exception, match="without backend id: zz"):
        prob.load_problems(bad).collect()


def test_summaries_and_leaderboard_files(spark, tmp_path):
    base = {"model_name": "m", "prompt_type": "detailed", "dataset": "main", "num_problems": 100, "stability_runs": 5,
            "run_level_pass_rate": 58.8, "run_level_ci_95": [55.72, 61.81], "average_variance": 0.0388, "pass@1": 60.5}
    for i, more in enumerate([{}, {"generation_mode": "qwen_batch"}, {"prompt_type": "standard"}]):
        put(tmp_path / "s" / f"{i}.json", json.dumps({**base, **more, "experiment_name": f"2025010{i}_000000"}, indent=4))
    rows = crossrun.load_summaries(readers.read_summaries(spark, str(tmp_path / "s")))
    assert sorted(r.generation_mode for r in rows.collect()) == ["qwen_batch", "realtime"]
    out = str(tmp_path / "boards")
    writers.write_leaderboard(crossrun.dedupe_summaries(rows), out)
    back = spark.read.option("header", True).csv(f"{out}/leaderboard.csv").collect()
    assert len(back) == 2 and back[0]["RLPR 95% CI"] == "[55.72, 61.81]" and back[0]["Model"] == "m"
    lines = [r.value for r in spark.read.text(f"{out}/paper_leaderboard.md").collect()]
    assert sum(line.startswith("| m |") for line in lines) == 2
    assert lines[0].startswith("# ") and lines[2].startswith("_Filters: dataset=`main`, num_problems>=10")
    assert spark.read.text(f"{out}/leaderboard.tex").count() == 8
    doc = json.loads(spark.read.text(f"{out}/paper_leaderboard.json").first().value)
    assert doc["num_rows"] == 2 and doc["rows"][0]["Model"] == "m" and doc["filters"]["min_stability_runs"] == 3
    assert doc["columns"][:2] == ["Model", "Prompt"] and "AV 95% CI" in doc["columns"]


def test_save_summary_replaces_one_experiment(spark, tmp_path):
    path = str(tmp_path / "saved")
    df = spark.createDataFrame([("a", 1.005), ("b", 66.666)], "experiment_name string, run_level_pass_rate double")
    writers.save_summary(df, path)
    writers.save_summary(df.where("experiment_name = 'a'").withColumn("run_level_pass_rate", F.lit(2.125)), path)
    got = {r.experiment_name: r.run_level_pass_rate for r in spark.read.parquet(path).collect()}
    assert got == {"a": 2.12, "b": 66.67}


def test_merge_archives_newer_file_wins(spark, tmp_path):
    old = put(tmp_path / "old" / "t.jsonl", trial(code="old") + "\n" + trial(trial_index=1, code="only") + "\n")
    put(tmp_path / "new" / "t.jsonl", trial(code="new", strategy="detailed") + "\n")
    past = time.time() - 1000
    os.utime(old, (past, past))
    parts = [readers.read_archives(spark, [str(tmp_path / d)]) for d in ("old", "new")]
    merged = readers.merge_archives(parts, stability.TRIAL_KEY, [F.desc("modified_at")])
    assert sorted(r.code for r in merged.collect()) == ["new", "only"]


def test_manifest_file(spark, tmp_path):
    doc = [{"custom_id": "a", "model_id": "m", "trial_index": 1, "topics": ["x"], "input_file_body": {"k": 1}}]
    row = readers.read_manifest(spark, put(tmp_path / "m.json", json.dumps(doc, indent=2))).first()
    assert (row.custom_id, row.trial_index, row.topics, row.prompt_hash) == ("a", 1, ["x"], None)


def test_batch_output_shards(spark, tmp_path):
    put(tmp_path / "o" / "1.jsonl", '{"a": 1}\n\n{"b": \n')
    put(tmp_path / "o" / "2.jsonl.out", '  \n{"c": 3}\nnot json\n')
    assert sorted(r.value for r in readers.read_batch_outputs(spark, str(tmp_path / "o")).collect()) == ['{"a": 1}', '{"c": 3}']


def test_run_id_from_file(spark, tmp_path):
    path = put(tmp_path / "my cfg+1.v2.json", '{"a": 1}')
    row = readers.read_configs(spark, path).select(
        readers.run_id("p", F.col("path"), F.col("content")).alias("plain"),
    ).first()
    assert row.plain == "p_my_cfg_1.v2_" + hashlib.sha1(b'{"a": 1}').hexdigest()[:10]


def test_trials_round_trip_and_requests(spark, tmp_path):
    df = spark.createDataFrame([("m1", 1, "é\n"), ("m2", 2, "x")], "model_name string, trial_index int, prompt string")
    path = str(tmp_path / "trials")
    writers.write_trials(df, path)
    writers.write_trials(df, path)
    kept = spark.read.parquet(path).where("model_name = 'm1'")
    assert kept.count() == 2
    assert "PartitionFilters: [isnotnull(model_name" in kept._jdf.queryExecution().toString()
    lines = str(tmp_path / "requests")
    writers.write_requests(df.select(F.struct("prompt", "trial_index").alias("request")), lines)
    got = [r.value for r in spark.read.text(lines).collect()]
    assert sorted(json.loads(x)["prompt"] for x in got) == ["x", "é\n"] and all(x.isascii() for x in got)


def test_solutions_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("T", "detailed", "x = 1"), ("U", "minimal", None)], "t string, s string, c string").coalesce(1)
    path = str(tmp_path / "solutions")
    writers.write_solutions(df.select(writers.solution_block(F.col("t"), F.col("s"), F.col("c")).alias("block")), path)
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.startswith("part"))
    assert text == "## T (detailed)\n```python\nx = 1\n```\n\n## U (minimal)\n```python\n# No code generated\n```\n\n"


def test_shared_dir_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    one, two = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert one.startswith(base) and one != two


def test_scan_is_pruned(spark, sf):
    from steadyrun.plans.common import counts

    plan = counts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert "l_shipmode" not in schema and "l_orderkey" in schema

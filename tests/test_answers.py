"""Raw answers: extraction, odd JSON, ladders and joins."""

import json

import pytest
from pyspark.sql import functions as F

from steadyrun.functions import codetext
from steadyrun.operators import answers as ans, requests as req
from steadyrun.plans import q_answers

ANSWERS = [
    "Here:\n\n```python\nclass Solution:\n    def f(self):\n        return 1\n```\n bye",
    "\nclass Solution:\n    def f(self, nums):\n\n        seen = {}\n        return []\n   ",
    "It uses a map.\n\nclass Solution:\n    x = 1\n\ndef other():\n    pass\n",
    "<THINK>class Wrong:\n  pass</THINK>\n```\na = 1\n```\n```python\nb = 2\n```",
    "<|thinking|>x<|/thinking|>def f():\n  return 2",
    "<think>only thoughts</think>",
    "no code at all, from here on none",
    "from os import path\nprint(1)",
    "words\n   return x",
    "the return \n of it",
    "```js\nlet a;\n```",
    "a sub-class of things\nclass  Ünï:\n  y = 2\nclass B: pass",
    "```python3   \nx = 'é'\n```",
    "plain ``` fence",
    "\u00a0 import re",
]


# The code that each answer should give.
CODES = [
    'class Solution:\n    def f(self):\n        return 1',
    'class Solution:\n    def f(self, nums):\n\n        seen = {}\n        return []',
    'class Solution:\n    x = 1',
    'a = 1',
    'def f():\n  return 2',
    None,
    None,
    'from os import path\nprint(1)',
    'words\n   return x',
    None,
    None,
    'class of things',
    "x = 'é'",
    None,
    'import re',
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ANSWERS)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", codetext.extract_code(F.col("t")).alias("c")).collect()}
    assert got == dict(enumerate(CODES))


def test_long_answers_do_not_overflow(spark):
    body = "\n".join(f"    a{i} = '\\n\\\"{i}'" for i in range(40000))
    texts = [f"<think>{body}</think>```python\nclass A:\n{body}\n```", f"class A:\n{body}", json.dumps({"code": body})[:-2]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select(
        F.length(codetext.extract_code(F.col("t"))).alias("n"), F.length(codetext.structured_code(F.col("t"))).alias("m")
    ).collect()
    assert out[0].n > len(body) and out[1].n > len(body) and out[2].m == len(body)


def test_structured_code(spark):
    cases = {
        '{"code": "a\\nb"}': "a\nb",
        '{"code" :"x = \\"1\\"\\n\\ty\\\\n\\q\n z", "n": 2}': 'x = "1"\n\ty\\n\\q z',
        '{"other": 1}': '{"other": 1}',
        "plain text": "plain text",
        '{"code": "  \n"': '{"code": "  \n"',
        '{"code": "cut off\\nhere': "cut off\nhere",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.c for r in df.select("t", codetext.structured_code(F.col("t")).alias("c")).collect()}
    assert got == cases


def test_syntax_gate(spark):
    cases = {"x = 1": True, "class A": False, "a\0b": False, "": True, "(" * 5000: False}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.v for r in df.select("t", codetext.is_valid_python(F.col("t")).alias("v")).collect()}
    assert got == {**cases, None: None}


def lines(spark, docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value string")


def chat(cid, content, usage=None, **more):
    body = {"choices": [{"message": {"content": content}}], "usage": usage}
    return {"custom_id": cid, "response": {"body": body}, **more}


def test_chat_lines_of_every_kind(spark):
    docs = [
        chat("text", "hi", {"prompt_tokens": 3, "completion_tokens": "4"}),
        chat("list", [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]),
        chat("json text", '[{"type": "text", "text": "kept as it is"}]'),
        chat("null", None, {"prompt_tokens": None}),
        chat("number", 5),
        {"custom_id": "none", "response": {"body": {"choices": []}}},
        {"custom_id": "gone", "response": None, "error": {"code": 1}},
        chat("text error", "x", error="late"),
        {"custom_id": "body error", "response": {"body": {"error": {"m": 2}}}},
        chat("no error", "x", error={}),
        {"custom_id": 7},
        "not json",
    ]
    got = {r.custom_id: r for r in ans.chat_answers(lines(spark, docs)).collect()}
    text = {k: r.text for k, r in got.items()}
    assert text["text"] == "hi" and text["list"] == "a\nb"
    assert text["json text"] == '[{"type": "text", "text": "kept as it is"}]'
    assert text["null"] == text["number"] == text["none"] == text["gone"] == ""
    assert (got["text"].input_tokens, got["text"].output_tokens, got["null"].input_tokens) == (3, 4, 0)
    errors = {k: r.error for k, r in got.items()}
    assert errors["gone"] == '{"code":1}' and errors["text error"] == "late" and errors["body error"] == '{"m":2}'
    assert errors["no error"] is None and errors["text"] is None


def test_message_lines(spark):
    def block(*blocks, kind="succeeded", **more):
        return {"custom_id": "c", "result": {"type": kind, "message": {"content": list(blocks)}, **more}}

    tool = {"type": "tool_use", "name": req.CODE_TOOL, "input": {"code": "x"}}
    text = {"type": "text", "text": "said"}
    docs = [block(text, tool), block(text), block({"type": "tool_use", "name": "other", "input": {"code": "y"}}),
            block(kind="errored", error={"e": 1}), block(text, kind="canceled"),
            block({"type": "tool_use", "name": req.CODE_TOOL, "input": {}}, text)]
    rows = ans.message_answers(lines(spark, docs)).collect()
    assert [r.text for r in rows] == ["x", "said", "", "", "", ""]
    assert [r.error for r in rows] == [None, None, None, '{"e":1}', "canceled", None]


def test_generate_lines_and_hash_match(spark):
    def echoed(text, **more):
        return {"request": {"contents": [{"role": "user", "parts": [{"text": text}]}]}, **more}

    answer = {"response": {"candidates": [{"content": {"parts": [{"text": '{"code": "z"}'}]}}]}}
    docs = [echoed("p1", **answer), echoed("p1", status="quota"), echoed("p2"), echoed("unknown", **answer)]
    df = lines(spark, docs).withColumn("n", F.monotonically_increasing_id())
    rows = [("m", "p1", "a", 1), ("m", "p1", "b", 2), ("m", "p2", "c", 3), ("k", "p1", "d", 4)]
    manifest = spark.createDataFrame(rows, "model_id string, p string, custom_id string, n int")
    manifest = manifest.withColumn("prompt_hash", F.md5("p"))
    answers = ans.generate_answers(df).withColumn("model_id", F.lit("m"))
    other = answers.where("prompt_hash = md5('p1')").withColumn("model_id", F.lit("k"))
    both = ans.match_by_hash(answers.unionByName(other), manifest, "n", "n")
    assert [(r.custom_id, r.answers_of_hash) for r in both.where("model_id = 'k'").collect()] == [("d", 2)]
    got = both.where("model_id = 'm'").collect()
    assert sorted((r.custom_id or "-", r.text, r.error or "") for r in got) == [
        ("-", "z", ""), ("b", "", "quota"), ("c", "", "No response from the service"),
    ]


def test_families(spark):
    docs = {
        "us.anthropic.claude-x": {"content": [{"type": "thinking", "text": "t"}, {"type": "text", "text": "a"}, {"type": "text"}]},
        "amazon.nova-1": {"output": {"message": {"content": [{"text": "n"}, {"text": "m"}]}}, "usage": {"inputTokens": 2}},
        "meta.llama-1": {"generation": "l", "prompt_token_count": 5},
        "x.DeepSeek-1": {"choices": [{"message": {"content": "d"}}], "usage": {"prompt_tokens": 0, "input_tokens": 9}},
        "zz": {"completion": "", "text": "last"},
        "zz-empty": {},
    }
    rows = [(m, json.dumps({"recordId": m, "modelOutput": o})) for m, o in docs.items()]
    got = ans.model_output_answers(spark.createDataFrame(rows, "m string, value string"), F.col("m")).collect()
    assert [r.text for r in got] == ["a\n", "n\nm", "l", "d", "last", ""]
    assert [r.input_tokens for r in got] == [0, 2, 5, 9, 0, 0]


def test_ladder(spark):
    rows = [("a", "```\nx = 1\n```", None), ("b", "", None), ("c", "prose", None), ("d", "```\nclass\n```", None),
            ("e", "x", "boom"), ("f", "```\n\n\n```", None), ("g", None, None)]
    df = spark.createDataFrame(rows, "custom_id string, text string, error string").withColumns(
        {"input_tokens": F.lit(7), "output_tokens": F.lit(1), "model_id": F.lit("gpt-4o")}
    )
    got = {r.custom_id: r for r in ans.classify(ans.priced(df)).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "a": "Success", "b": "Generation Failed", "c": "Extraction Failed", "d": "Syntax Error",
        "e": "Generation Failed", "f": "Extraction Failed", "g": "Generation Failed",
    }
    assert (got["e"].input_tokens, got["e"].cost, got["e"].raw_response) == (0, 0.0, None)
    assert got["a"].cost == pytest.approx((7 * 0.005 + 0.015) / 1000) and got["a"].code == "x = 1"


def test_resolution_retry_and_strict_join(spark):
    s = "custom_id string, answer string, error string, n int"
    outputs = spark.createDataFrame([("a", "1", None, 1), ("a", "2", None, 2), ("b", None, "bad", 3)], s)
    errors = spark.createDataFrame([("a", None, "late", 9), ("c", None, "lost", 9), (None, None, "x", 9)], s)
    got = {r.custom_id: (r.answer, r.error) for r in ans.resolve(outputs, errors, ["n"]).collect()}
    assert got == {"a": ("2", None), "b": (None, "bad"), "c": (None, "lost")}

    retry = spark.createDataFrame([("b", "new", None, 1), ("c", None, "again", 1)], s)
    merged = ans.merge_retry(outputs.where("n > 1"), retry)
    assert {r.custom_id: (r.answer, r.replaced) for r in merged.collect()} == {"a": ("2", False), "b": ("new", True)}
    left = ans.remaining_errors(errors.where("custom_id is not null"), retry)
    assert {r.custom_id: r.error for r in left.collect()} == {"a": "late", "c": "again"}

    manifest = spark.createDataFrame([("a",), ("z",)], "custom_id string")
    with pytest.raises(Exception, match="no generation for z"):
        ans.join_manifest(manifest, outputs).collect()
    done = ans.complete(manifest, outputs.where("n = 2").withColumn("status", F.lit("ok"))).collect()
    assert {r.custom_id: (r.status, r.error) for r in done} == {
        "a": ("ok", None), "z": ("Generation Failed", "Missing batch result"),
    }


def test_prompt_values_are_not_scanned(spark):
    df = spark.createDataFrame([("{code_template} {x}", "T")], "d string, t string")
    got = df.select(req.render_prompt("A{problem_description}B{code_template}", F.col("d"), F.col("t")).alias("p"))
    assert got.first().p == "A{code_template} {x}BT"


def test_ids(spark):
    cols = [F.lit(x) for x in ("qwen plus/1", "12", "two--sum é", "detailed")]
    full = req.custom_id(*cols, F.lit(3))
    row = spark.range(1).select(full.alias("i"), req.parse_custom_id(full).alias("m"), req.job_name(F.lit("r_1"), cols[0], cols[3], 12).alias("j")).first()
    assert row.i == "model=qwen_plus_1|problem=12|slug=two--sum_|prompt=detailed|trial=3"
    assert row.m["slug"] == "two--sum_" and row.j == "r-1-qwen-plu"


def test_items_of_any_length(spark):
    # One problem has most attempts; its chunks are bounded and flatten to what went in.
    rows = [("m", "hot", ["detailed", "minimal"][k % 3 == 0], k // 2 if k % 11 else None, f"s{k}") for k in range(3000)]
    rows += [("m", f"p{k}", "minimal", 0, "x") for k in range(5)] + [("m", None, "detailed", 1, "y")] * 2
    df = spark.createDataFrame(rows, "model_id string, problem_id string, prompt_type string, trial_index int, status string").repartition(6)
    items = ans.assemble_items(df, ["model_id", "problem_id"], ["status"], size=100)
    found = items.collect()
    assert max(max(len(r.with_prompt), len(r.without_prompt)) for r in found) == 100
    hot = sorted((r for r in found if r.problem_id == "hot"), key=lambda r: r.chunk)
    assert [r.chunk for r in hot] == list(range(len(hot))) and len(hot) == 20
    indexes = [a.trial_index for r in hot for a in r.with_prompt]
    assert indexes == sorted(indexes, key=lambda i: (i is not None, i or 0))
    back = ans.flatten_items(items, ["model_id", "problem_id"]).select(*df.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_requests_of_a_small_table_are_made_by_many_tasks(spark):
    problems = spark.range(2000).select(F.col("id").cast("string").alias("frontend_question_id")).coalesce(1)
    made = req.expand_requests(problems, ["a", "b"], ["detailed"], 3)
    per_task = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 12_000 == made.distinct().count() and len(per_task) == 4 and max(per_task) < 4000


def test_hash_match_sorts_only_what_it_gives(spark, sf):
    unread = F.when(F.col("n") >= 0, F.raise_error(F.lit("a prompt was sorted")))
    manifest = spark.createDataFrame([("m", "h", "a", 1)], "model_id string, prompt_hash string, custom_id string, n int")
    answers = manifest.select("model_id", "prompt_hash", "n", F.lit("t").alias("text"))
    found = ans.match_by_hash(answers, manifest.withColumn("prompt", unread.cast("string")), "n", "n").collect()
    assert [(r.custom_id, r.text) for r in found] == [("a", "t")]
    plan = q_answers.hash_match(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    sums = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert len(sums) == 2 and not any("value#" in line for line in sums)

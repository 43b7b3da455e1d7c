"""Near-duplicate groups (op4) against all pairs on small corpora."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from steadyrun.llm import graph, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Groups(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def shingle_set(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def brute_force(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    groups = Groups()
    for i, (a, _) in enumerate(rows):
        groups.find(a)
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                groups.link(a, rows[j][0])
    return sorted((a, len(s), groups.find(a), groups.find(a) == a) for (a, _), s in zip(rows, sets))


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Été", "A", "a"]

    def text(n):
        return [rnd.choice(vocabulary) for _ in range(n)]

    rows = []
    for _ in range(25):
        base = text(rnd.choice([1, 2, 4, 30, 80]))
        for _ in range(rnd.choice([1, 1, 3, 6])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append(rnd.choice([" ", "\n", "\t "]).join(copy))
    # One large group of near copies, many of them on the border.
    base = text(120)
    for _ in range(60):
        copy = list(base)
        for _ in range(rnd.randint(0, 7)):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
        rows.append(" ".join(copy).upper() if rnd.random() < 0.2 else " ".join(copy))
    rows += ["", "  \n", None, "Été", "été", "a", "A"]
    rnd.shuffle(rows)
    return list(enumerate(rows, start=10))


@pytest.mark.parametrize("width, percent, members", [(3, 85, 256), (5, 80, 8)])
def test_equals_all_pairs(spark, monkeypatch, width, percent, members):
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    rows = corpus(width)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_dedup.near_duplicates(df, width, percent, bands=40)
    assert sorted(tuple(r) for r in got.collect()) == brute_force(rows, width, percent)


def test_odd_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(5, text), (5, text), (2, text + " nine"), (2, "all other words are here now"), (None, text), (None, "alone"), (7, None)]
    df = spark.createDataFrame([(*r, b"x", True, 1) for r in rows], "doc_id long, text string, node binary, kept boolean, number int")
    got = near_dedup.near_duplicates(df, width=3, percent=80).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter(
        {(5, 2, False): 2, (2, 2, True): 2, (None, 2, False): 1, (None, None, True): 1, (7, 7, True): 1}
    )
    assert near_dedup.near_duplicates(df.where("false")).count() == 0


def test_very_long_text(spark):
    words = " ".join(f"w{k}" for k in range(60000))
    df = spark.createDataFrame([(1, words), (2, words + " end"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 3, 85).collect()}
    assert got == {1: (59998, 1), 2: (59999, 1), 3: (1, 3)}


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randint(-50, 400), rnd.randint(-50, 400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1040)]
    groups = Groups()
    for a, b in links:
        if a != b:
            groups.link(a, b)
    df = spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {x: groups.find(x) for x in groups}
    assert graph.components(df.where("false")).count() == 0


def test_stage_keeps_one_row_of_repeated_rows_and_of_rows_without_id(spark):
    def words(name, n=40):
        return " ".join(f"{name}{k}" for k in range(n))

    rows = [(5, words("a"))] * 3 + [(2, words("a") + " end")] * 2 + [(None, words("a"))]
    rows += [(None, words("b"))] * 4 + [(None, words("b") + " end")] + [(None, words("c"))]
    rows += [(7, words("d")), (7, words("e")), (8, words("e")), (None, words("f")), (9, words("f")), (3, ""), (4, None)]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, df.repartition(5), "")
    assert got.columns == df.columns
    found = Counter((r.doc_id, (r.text or "")[:1]) for r in got.collect())
    assert found == Counter([(2, "a"), (None, "b"), (None, "c"), (7, "d"), (7, "e"), (9, "f"), (3, ""), (4, "")])
    again = corpus_pipeline.near_duplicates(spark, df.repartition(3), "")
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))

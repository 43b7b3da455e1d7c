"""Encoding, grammar shards (op1) and packing (op8) against the tokenizers library and plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from steadyrun.llm import grammar, packing, queries, tokens

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
POOL = "abcXYZ'stmrelvd 019²½.,!?|<>-_ \n\t\r\x0b\x85\xa0 　éÉßÿİΣς日本́­\x00\x1c\x1f\x7f"
TEXTS = [
    (3, "two words"), (1, None), (2, ""), (9, " \n "), (9, "same id, other text"), (9, " \n "),
    (None, "no id"), (4, "long " * 9000), (5, "x" * 30000), (6, "<|endoftext|> is text"),
]


def library(path):
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture()
def docs(spark):
    rows = [(i, t, 7, "s") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, length int, part string").repartition(3)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_library(path, monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION", 50)
    own, want, rnd = tokens.Encoder(path), library(path), random.Random(1)
    for _ in range(6000):
        text = "".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 14)))
        assert own(text) == packed(want(text)), repr(text)


def test_unknown_configuration_encodes_whole_texts():
    assert tokens._form({"model": {"type": "WordPiece"}}) is None
    assert tokens._form({"model": {"type": "BPE"}, "pre_tokenizer": {"type": "Whitespace"}}) is None


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 7, 50, 6000):
        ids = rng.integers(0, 3, n).astype(np.uint32)
        symbols, rules, lengths, ends = grammar.compress(ids, 5, 6, 100, 2)
        assert (grammar.expand(symbols, rules, 5, ends) == ids).all()
        assert n < 1000 or len(symbols) < n / 3
        low, high = grammar._planes(symbols)
        spans = np.ones(len(symbols), np.int64)
        spans[symbols >= 5] = lengths[symbols[symbols >= 5] - 5]
        row = dict(
            low=low, high=high, n_symbols=len(symbols), alphabet=5, rounds=ends, rules=rules.astype("<u4").tobytes(),
            lengths=lengths.astype("<u4").tobytes(),
            samples=(np.cumsum(spans) - spans)[:: grammar.SAMPLE].astype("<u4").tobytes(),
        )
        for _ in range(100):
            a, b = sorted(rng.integers(0, n + 1, 2))
            assert (grammar.slice_ids(row, a, b) == ids[a:b]).all()


def uses(symbols):
    """Uses of each pair, overlaps left out."""
    found, last = Counter(), {}
    for k, pair in enumerate(zip(symbols, symbols[1:])):
        if last.get(pair) != k - 1 or pair[0] != pair[1]:
            last[pair] = k
            found[pair] += 1
    return found


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    # 40,000 pairs of two symbols ten times each, then a text that needs many rounds.
    pairs = np.arange(80_000, dtype=np.uint32)
    many = np.concatenate([rng.permutation(pairs.reshape(-1, 2)).ravel() for _ in range(10)])
    copies = np.tile(rng.integers(0, 500, 700).astype(np.uint32), 60)
    noise = rng.integers(0, 6, 3000).astype(np.uint32)
    for ids, alphabet in ((many, 80_000), (copies, 500), (noise, 6), (np.zeros(999, np.uint32), 1)):
        symbols, rules, lengths, ends = grammar.compress(ids, alphabet, None, 1 << 14, 8)
        assert max(uses(symbols.tolist()).values(), default=0) < 8
        assert (grammar.expand(symbols, rules, alphabet, ends) == ids).all()
        assert (grammar.expand_all(symbols, rules, alphabet, ends) == ids).all()
        assert all(len(grammar.expand_all(np.array([alphabet + k]), rules, alphabet, ends)) == n for k, n in enumerate(lengths[:50]))


def test_wide_symbols_are_counted_exactly():
    small = np.random.default_rng(5).integers(0, 8, 2000).astype(np.uint32)
    live, wide = np.arange(len(small) - 1), small + np.uint32(2**31)
    got, want = (grammar._replaced(x, live, 2**30, 100, 8) for x in (wide, small))
    assert (got[2] == want[2] + np.uint32(2**31)).all() and (got[1] == want[1]).all()
    assert len(got[0]) == len(want[0]) < len(small)


def test_more_than_16_bits():
    symbols = np.array([1, 70000, 65535, 65536, 140000] * 5, np.uint32)
    low, high = grammar._planes(symbols)
    assert (grammar._symbols(low, high, len(symbols)) == symbols).all()
    assert (grammar._symbols(low, high, len(symbols), 8, 19) == symbols[8:19]).all()


def test_shards(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    grammar.shards(docs, BYTES, 50257, shard_size=500).write.parquet(path)
    got = sorted(grammar.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    encode = library(BYTES)
    want = Counter((i, len(x), zlib.crc32(packed(x))) for i, x in ((i, encode(t) + [0]) for i, t in TEXTS))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    for row in spark.read.parquet(path).collect():
        for k, n in enumerate(row["doc_ids_count"]):
            assert len(grammar.document_ids(row.asDict(), k)) == n


def test_no_documents(spark, docs, tmp_path):
    path, none = str(tmp_path / "none"), docs.where("false")
    grammar.shards(none, BYTES, 50257).write.parquet(path)
    assert grammar.read_documents(spark, path).count() == 0
    assert packing.pack(none, WORDS).count() == 0


def layout(counts, capacity):
    """Bins of (offset, length) that the plan gives all pieces."""
    bins = defaultdict(list)
    for length, slots in packing.plan(dict(counts), capacity).items():
        for rank in range(counts[length]):
            k = np.searchsorted(slots[:, 0], rank, side="right") - 1
            bins[int(slots[k, 1] + rank - slots[k, 0])].append((int(slots[k, 2]), length))
    return bins


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - x)
    return len(rooms)


def test_plan_places_all_and_beats_plain_best_fit():
    better = 0
    for seed in range(150):
        rnd = random.Random(seed)
        capacity, n = rnd.choice([7, 10, 30, 100, 2048]), rnd.choice([1, 3, 10, 60, 300])
        low = rnd.choice([1, capacity // 4 or 1])
        lengths = [rnd.randint(low, capacity) for _ in range(n)]
        bins = layout(Counter(lengths), capacity)
        for held in bins.values():
            held.sort()
            assert [o for o, _ in held] == [sum(x for _, x in held[:k]) for k in range(len(held))]
            assert sum(x for _, x in held) <= capacity
        assert Counter(x for held in bins.values() for _, x in held) == Counter(lengths)
        plain = best_fit_decreasing(lengths, capacity)
        assert len(bins) <= plain
        better += len(bins) < plain
    assert better


def test_reduction_keeps_the_optimum():
    def optimum(lengths, capacity):
        best = [len(lengths)]

        def go(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(lengths):
                best[0] = len(rooms)
                return
            for i in range(len(rooms)):
                if rooms[i] >= lengths[k] and rooms[i] not in rooms[:i]:
                    go(k + 1, rooms[:i] + [rooms[i] - lengths[k]] + rooms[i + 1 :])
            go(k + 1, rooms + [capacity - lengths[k]])

        go(0, [])
        return best[0]

    for seed in range(120):
        rnd = random.Random(seed)
        capacity = rnd.choice([10, 20, 50])
        lengths = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))), reverse=True)
        bins, stock = packing.Bins(capacity), packing.Stock(Counter(lengths))
        packing.reduce_instance(stock, bins)
        rest = sorted((x for x, n in stock.counts.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in bins.groups) + optimum(rest, capacity) == optimum(lengths, capacity)


def test_pack(docs):
    got = packing.pack(docs, WORDS, capacity=64).collect()
    encode = library(WORDS)
    want = Counter()
    for i, t in TEXTS:
        ids = encode(t) + [0]
        for k, at in enumerate(range(0, len(ids), 64)):
            want[i, k, at, len(ids[at : at + 64]), zlib.crc32(packed(ids[at : at + 64]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == [sum(x for _, x in held[:k]) for k in range(len(held))]
        assert sum(x for _, x in held) <= 64
    assert len(by) == -(-sum(r.length for r in got) // 64)


LITERALS = ["end <|endoftext|> of", "<|startoftext|><|endoftext|>\n é", "a<|endoftext|>日本 <|ENDOFTEXT|>", "plain"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_added_tokens_equal_the_unmodified_library(path):
    own, made, rnd = tokens.Encoder(path, added_tokens=True), Tokenizer.from_file(path), random.Random(2)
    for text in LITERALS + ["".join(rnd.choice([*POOL, "<|endoftext|>", "<|startoftext|>"]) for _ in range(12)) for _ in range(3000)]:
        assert own(text) == packed(made.encode(text, add_special_tokens=False).ids), repr(text)


def test_queries_take_added_tokens(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(LITERALS)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for query, path in ((queries.op1_repair_shards, BYTES), (queries.op8_dominance_packing, WORDS)):
        made = Tokenizer.from_file(path)
        got = {r.doc_id: r.ids_crc32 for r in query(spark, str(tmp_path)).collect()}
        assert got == {k: zlib.crc32(packed(made.encode(t, add_special_tokens=False).ids + [0])) for k, t in enumerate(LITERALS)}
    pieces = corpus_pipeline.packed(spark, df, str(tmp_path))
    assert {r.doc_id: r.ids_crc32 for r in pieces.collect()} == got

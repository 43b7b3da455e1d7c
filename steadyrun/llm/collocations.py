"""Operator 13: phrase collocations from streams of counts in prefix and suffix order.

Texts become windows: at each word the words that follow it within its piece, up to a length. In a stream of
counted windows in prefix order (first word first) those that begin with a phrase stand together, so one pass
gives the counts of all phrases up to that length.

1. Pairs of neighbours are counted by 64-bit keys. A key that is not frequent is that of no frequent pair; the
   others are kept in a bit field of fixed size. Keys that clash only let in more pairs.
2. A longer phrase can be frequent only where all its pairs are, so a window goes on along a run of pairs in the
   field. Windows of one word and more are counted with their words, and one pass over the sorted stream gives the
   exact counts of words and phrases.
3. The frequent phrases are streamed in prefix order and in suffix order (last word first). Each stream is joined
   in lockstep with the phrases it has just passed: those the present one begins (ends) with are the path that
   leads to it. The prefix stream gives the counts of left parts and of extensions to the right, the suffix stream
   those of right parts and of extensions to the left. Nothing is looked up by a hash.

Streams are cut into sorted ranges of about equal size. All that a range needs from before its first row are the
counts on that row's path; these few are joined to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from steadyrun.sources.scratch import stored

PIECES = re.compile(rb"[^.,;:!?\n-\r]+")
#: The field of frequent pairs has 2^26 bits, 8 MB, at every size.
FIELD_BITS = 26
KEYS = 1 << 22
HELD = 500_000
STRETCH = 1 << 16
ODD = np.uint64(0x9E3779B97F4A7C15)
COUNTED = "lang string, phrase string, n long"
WALKED = "lang string, phrase string, words int, n long, above array<long>, extended long, part int"


class Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def pair_keys(lang: bytes, hashes: np.ndarray) -> np.ndarray:
    """The keys of neighbouring words, from the words' hashes."""
    mixed = (hashes[:-1] ^ np.uint64(xxhash.xxh3_64_intdigest(lang))) * ODD
    mixed = ((mixed ^ (mixed >> np.uint64(32))) + hashes[1:]) * ODD
    return (mixed ^ (mixed >> np.uint64(29))) * ODD


def stretches(text: bytes) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The words of a text, some pieces at a time, and whether a word and the next are in the same piece."""

    def of(words: list[bytes], lasts: list[int]) -> tuple[list[bytes], np.ndarray]:
        inner = np.ones(len(words), bool)
        inner[lasts] = False
        return words, inner[:-1]

    words, lasts = [], []
    for piece in PIECES.finditer(text):
        more = piece[0].split()
        if more:
            words += more
            lasts.append(len(words) - 1)
        if len(words) > STRETCH:
            yield of(words, lasts)
            words, lasts = [], []
    if words:
        yield of(words, lasts)


def windows(words: list[bytes], joined: np.ndarray, most: int) -> Iterator[bytes]:
    """The window that begins at each word and goes on while the words are ``joined`` to the next."""
    yield from compress(words, np.append(~joined, True).tolist())
    starts = np.flatnonzero(joined)
    # Where the run of joined words ends that holds a place.
    ends = np.where(joined, len(joined), np.arange(len(joined)))
    ends = np.minimum.accumulate(ends[::-1])[::-1][starts]
    for at, end in zip(starts.tolist(), np.minimum(ends + 1, starts + most).tolist(), strict=True):
        yield b" ".join(words[at:end])


def _pair_sums(docs: DataFrame) -> DataFrame:
    """(key, n) of all pairs of neighbours; a key may be there several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = Hashes(), [], 0

        def emptied() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(keys), STRETCH):
                part = slice(at, at + STRETCH)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(counts[part], pa.int64())], ["key", "n"])
            held.clear()

        for batch in batches:
            langs, texts = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "body"))
            for lang, text in zip(langs, texts, strict=True):
                for words, inner in stretches(text.lower()):
                    held.append(pair_keys(lang, hashes.of(words))[inner])
                    size += len(words)
                if size > KEYS:
                    yield from emptied()
                    size = 0
        if held:
            yield from emptied()

    return docs.mapInArrow(run, "key long, n long")


def _field(docs: DataFrame, least: int) -> bytes:
    """The bits of all frequent keys; at most 2^20 sums of 64 bits come to the driver."""
    frequent = _pair_sums(docs).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    places = frequent.select(F.shiftrightunsigned("key", 64 - FIELD_BITS).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))
    sums = places.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    field = np.zeros(1 << (FIELD_BITS - 6), np.int64)
    field[sums.column("at").to_numpy()] = sums.column("bits").to_numpy()
    return field.tobytes()


def counted_windows(docs: DataFrame, shared: Broadcast, most: int) -> DataFrame:
    """(lang, phrase, n) of the windows of all texts, added up as far as a task can hold them.

    A phrase ends in a space, so in order of bytes those it begins follow it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.frombuffer(shared.value, np.uint8)
        hashes, counts, held = Hashes(), {}, 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, counter in counts.items():
                phrases, sizes = [p + b" " for p in counter], list(counter.values())
                for at in range(0, len(phrases), STRETCH):
                    part = pa.array(phrases[at : at + STRETCH], pa.binary()).cast(pa.string())
                    names = pa.array([lang] * len(part), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([names, part, pa.array(sizes[at : at + STRETCH], pa.int64())], ["lang", "phrase", "n"])
            counts.clear()

        for batch in batches:
            langs, texts = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "body"))
            for lang, text in zip(langs, texts, strict=True):
                counter = counts.setdefault(lang, Counter())
                before = len(counter)
                for words, inner in stretches(text.lower()):
                    places = pair_keys(lang, hashes.of(words)) >> np.uint64(64 - FIELD_BITS)
                    known = (field[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1
                    counter.update(windows(words, inner & (known == 1), most))
                held += len(counter) - before
                if held > HELD:
                    yield from emptied()
                    held = 0
        yield from emptied()

    return docs.mapInArrow(run, COUNTED)


def _in_ranges(table: DataFrame, rows: int) -> DataFrame:
    """``table`` in sorted ranges of (lang, phrase) of about ``rows`` rows."""
    ranges = max(1, -(-table.count() // rows))
    return table.repartitionByRange(ranges, "lang", "phrase").sortWithinPartitions("lang", "phrase")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], int]]:
    """([lang, word, ...], n) of a stream, one after the other."""
    for batch in batches:
        langs, phrases = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "phrase"))
        for lang, phrase, n in zip(langs, phrases, batch.column("n").to_pylist(), strict=True):
            yield [lang, *phrase.split()], n


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == STRETCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], names)


def phrase_counts(windows: DataFrame, least: int, range_rows: int) -> DataFrame:
    """(lang, phrase, n) of the phrases that begin windows, with n >= ``least``; the empty phrase, which has the
    number of all windows of its lang, is there at any count.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, int]]:
        path, counts, edge = [], [], None
        # A count is added to that of the shorter phrase when it is complete.
        for row, n in _paths(batches):
            edge = len(row) if edge is None else edge
            same = 0
            for x, y in zip(path, row):
                if x != y:
                    break
                same += 1
            if same < len(path):
                while len(path) > same:
                    total = counts.pop()
                    # What the first or last row begins with may go on in another range.
                    if total >= least or len(path) <= max(edge, 1):
                        yield path[0], b"".join(w + b" " for w in path[1:]), total
                    path.pop()
                    if counts:
                        counts[-1] += total
                edge = min(edge, same)
            path += row[same:]
            counts += [0] * (len(row) - same)
            counts[-1] += n
        while path:
            total = counts.pop()
            yield path[0], b"".join(w + b" " for w in path[1:]), total
            path.pop()
            if counts:
                counts[-1] += total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(summed(batches), ["lang", "phrase", "n"], [pa.binary(), pa.binary(), pa.int64()]):
            yield pa.RecordBatch.from_arrays([b[0].cast(pa.string()), b[1].cast(pa.string()), b[2]], ["lang", "phrase", "n"])

    total = _in_ranges(windows, range_rows).mapInArrow(run, COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return total.where((F.col("n") >= least) | (F.col("phrase") == ""))


def lockstep(counts: DataFrame, range_rows: int) -> DataFrame:
    """Per phrase of ``counts`` (lang, phrase, n; with a phrase all that it begins with are there): n, the counts
    ``above`` of those it begins with, shortest first, and ``extended``, the largest count of those one word longer.
    """

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        path, known, longer, part = [], [], [], TaskContext.get().partitionId()

        def ended(depth: int) -> Iterator[tuple]:
            while len(path) > depth:
                if len(path) > 1:
                    phrase = b"".join(w + b" " for w in path[1:])
                    yield path[0], phrase, len(path) - 1, known[-1], known[1:-1], longer[-1], part
                for held in (path, known, longer):
                    held.pop()

        for row, n in _paths(batches):
            same = _common(path, row)
            yield from ended(same)
            path += row[same:]
            # Unknown are only those on the first row's path that were passed in an earlier range.
            known += [None] * (len(row) - same)
            longer += [0] * (len(row) - same)
            known[-1] = n
            if len(row) > 1:
                longer[-2] = max(longer[-2], n)
        yield from ended(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "words", "n", "above", "extended", "part"]
        types = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32()]
        for b in _batches(walked(batches), names, types):
            yield pa.RecordBatch.from_arrays([b[0].cast(pa.string()), b[1].cast(pa.string()), *b.columns[2:]], names)

    rows = stored(_in_ranges(counts, range_rows).mapInArrow(run, WALKED), "lockstep")
    # The path that leads into a range: at most one row per length and range.
    open_ = rows.where("n is null").select("lang", "phrase", "words", "part").join(counts.select("lang", "phrase", "n"), ["lang", "phrase"])
    led = open_.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("words", "n"))).alias("led"))
    filled = F.transform("above", lambda n, k: F.coalesce(n, F.try_element_at("led", k + 1)))
    above = F.when(F.col("n").isNotNull(), filled)
    return rows.join(led, "part", "left").select("lang", "phrase", "words", "n", above.alias("above"), "extended")


def _reversed(phrase: str) -> F.Column:
    """The words of a phrase that ends in a space, last one first."""
    return F.concat(F.array_join(F.reverse(F.split(F.rtrim(phrase), " ")), " "), F.lit(" "))


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000, range_rows: int = 1 << 20
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` phrases of each lang by score.

    ``docs`` has text and lang; a null text is empty, a null lang ``und``. Texts, A-Z in lower case, are cut at
    ``.,;:!?`` and line breaks into pieces and at spaces and tabs into words. Candidates are phrases of 2 to
    ``longest`` words with a count a of ``least`` or more. n is the number of words of the lang, l and r are the
    counts of the two parts of the cut with the lowest floor(1000 a n / (l r)), the shorter left part in ties.
    Candidates that only occur within one longer candidate are dropped. Ties go to the larger a, then the smaller
    phrase by its bytes. Rows that repeat count again; other columns are ignored; an empty table gives no rows.

    A task holds ``KEYS`` keys, ``HELD`` windows and the words of one piece; a sorted range has about ``range_rows`` rows.
    """
    if least < 1 or longest < 2:
        raise ValueError("least is 1 or more, longest 2 or more")
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("body")
    ).where("body is not null")
    spark = docs.sparkSession
    field = spark.sparkContext.broadcast(_field(texts, least))
    counted = stored(counted_windows(texts, field, longest), "windows")
    sums = stored(phrase_counts(counted, least, range_rows), "phrases")
    counts = sums.where("phrase <> ''")

    prefix = lockstep(counts, range_rows)
    suffix = lockstep(counts.select("lang", _reversed("phrase").alias("phrase"), "n"), range_rows)
    nothing = F.lit(None).cast("array<long>")
    both = prefix.withColumnRenamed("above", "lefts").withColumn("rights", nothing).unionByName(
        suffix.withColumn("phrase", _reversed("phrase")).withColumnRenamed("above", "rights").withColumn("lefts", nothing)
    )
    known = both.where("words >= 2").groupBy("lang", "phrase", "words").agg(
        *[F.max(c).alias(c) for c in ("n", "lefts", "rights", "extended")]
    )
    kept = known.where("extended < n").withColumnRenamed("n", "a")
    totals = sums.where("phrase = ''").select("lang", "n")
    cuts = """array_min(transform(sequence(1, words - 1), k -> named_struct(
        'score', (cast(1000 * a as decimal(18, 0)) * cast(n as decimal(18, 0)))
            div (cast(lefts[k - 1] as decimal(18, 0)) * cast(rights[words - k - 1] as decimal(18, 0))),
        'k', k, 'l', lefts[k - 1], 'r', rights[words - k - 1])))"""
    scored = kept.join(totals, "lang").withColumn("cut", F.expr(cuts)).select(
        "lang", F.rtrim("phrase").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score"
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

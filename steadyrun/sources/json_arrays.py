"""JSON arrays of objects in files that many tasks share.

A file is cut at every closing brace, which Spark's text source does in splits. Whether a brace stands in a string
is told by the number of quotes before it, and how deep it is by the structural braces before it. Each split is
summed up for both states it may begin in, without moving its text; the few rows of all splits tell the state each
one begins in, and a second scan puts its elements together. Only elements that go over the end of a split meet
their other parts by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from steadyrun.sources.scratch import stored


def _plain(path: Column) -> Column:
    """A path without scheme and host, and without encoded characters."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _scanner():
    """The two passes over the pieces of a scan, made here so that they travel by value.

    The pieces of a split come together and in order; a task may have several splits.
    """
    import numpy as np
    import pyarrow.compute as pc

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
        """Parts of the batches that lie in one split each."""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            file, block = batch.column("file"), batch.column("block").to_numpy()
            differs = pc.not_equal(file.slice(1), file.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (np.diff(block) != 0)
            cuts = [0, *(np.flatnonzero(differs) + 1).tolist(), n]
            for a, b in zip(cuts, cuts[1:]):
                yield (file[a].as_py(), int(block[a])), batch.slice(a, b - a)

    def counted(value: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quotes of each piece, and the structural braces it opens if it begins outside and inside a string."""
        bare = pc.replace_substring_regex(value.cast(pa.binary()), r"(?s)\\.", "")

        def opened(text: pa.Array) -> np.ndarray:
            return pc.count_substring(pc.replace_substring_regex(text, r'(?s)"[^"]*("|$)', ""), "{").to_numpy()

        rest = pc.replace_substring_regex(bare, r'(?s)^[^"]*("|$)', "", max_replacements=1)
        return pc.count_substring(bare, '"').to_numpy().astype(np.int64), opened(bare), opened(rest)

    def levels(
        parts: tuple[np.ndarray, np.ndarray, np.ndarray], inside: int, depth: int
    ) -> tuple[np.ndarray, np.ndarray, int]:
        """Depth after each piece, whether its closing brace is structural, and whether the last one ends in a string."""
        quotes, outer, inner = parts
        after = (np.cumsum(quotes) + inside) % 2
        before = np.concatenate([[inside], after[:-1]])
        change = np.where(before == 1, inner, outer).astype(np.int64) - (after == 0)
        return depth + np.cumsum(change), after == 0, int(after[-1])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per split: its quotes and, for both states it may begin in, the change of depth and how many
        structural braces close at each level."""
        at, quotes, state = None, 0, []

        def row() -> pa.RecordBatch:
            counts = pa.map_(pa.int64(), pa.int64())
            values = [([at[0]], pa.string()), ([at[1]], pa.int64()), ([quotes], pa.int64())]
            for _, depth, ends in state:
                values += [([depth], pa.int64()), ([list(ends.items())], counts)]
            names = ["file", "block", "quotes", "change_0", "ends_0", "change_1", "ends_1"]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in values], names=names)

        for split, batch in splits(batches):
            if split != at:
                if at is not None:
                    yield row()
                at, quotes, state = split, 0, [(0, 0, {}), (1, 0, {})]
            parts = counted(batch.column("value"))
            quotes += int(parts[0].sum())
            for k, (inside, depth, ends) in enumerate(state):
                level, structural, inside = levels(parts, inside, depth)
                for one, n in zip(*(x.tolist() for x in np.unique(level[structural], return_counts=True))):
                    ends[one] = ends.get(one, 0) + n
                state[k] = (inside, int(level[-1]), ends)
        if at is not None:
            yield row()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The elements of each split, and the parts of those that go over its ends."""
        at, inside, depth, number, held, whole = None, 0, 0, 0, [], True

        def rows(texts: pa.Array, first: int, is_whole: list[bool]) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([at[0]] * n, pa.string()), pa.array([at[1]] * n, pa.int64()),
                    pa.array(range(first, first + n), pa.int64()), pa.array(is_whole, pa.bool_()), texts,
                ],
                names=["file", "block", "number", "whole", "text"],
            )

        def rest() -> Iterator[pa.RecordBatch]:
            if held:
                yield rows(pa.array(["".join(held)], pa.string()), number, [False])

        for split, batch in splits(batches):
            if split != at:
                yield from rest()
                inside, depth, number = (batch.column(c)[0].as_py() for c in ("inside", "depth", "number"))
                at, held, whole = split, [], inside == 0 and depth == 0
            value = batch.column("value").cast(pa.string())
            level, structural, inside = levels(counted(value), inside, depth)
            depth = int(level[-1])
            ends = np.flatnonzero(structural & (level == 0)) + 1
            starts = np.concatenate([[0], ends]).astype(np.int32)
            closed = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), value), "}")
            if len(ends):
                texts = pc.binary_join_element_wise(closed, "}", "").cast(pa.string())
                if held:
                    texts = pa.concat_arrays([pa.array(["".join(held) + texts[0].as_py()], pa.string()), texts.slice(1)])
                yield rows(texts, number, [whole] + [True] * (len(ends) - 1))
                number, held, whole = number + len(ends), [], True
            held += [piece + "}" for piece in value.slice(int(starts[-1])).to_pylist()]
        yield from rest()

    return summed, joined


def elements(
    spark: SparkSession, paths: Sequence[str], ranges: int | None = None, pattern: str | None = None
) -> DataFrame:
    """(seq, text) of every object in arrays of objects; ``seq`` is (place of the path among ``paths``, file, number).

    A path is a file or a directory; files of a directory, those of ``pattern`` if given, go by their names. A file of
    one object is an array of one. An element that is no JSON is left
    out. If a file breaks off, its last element stays if a closing brace makes it whole. Memory of a task grows
    with the largest element, not with the file. ``ranges`` is the number of tasks that put together what goes over
    the end of a split, the shuffle partitions unless given.
    """
    paths = list(dict.fromkeys(paths))
    reader = spark.read.option("lineSep", "}")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    cut = reader.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    summed, joined = _scanner()
    counts = "map<bigint, bigint>"
    sums = stored(
        cut.mapInArrow(
            summed,
            f"file string, block bigint, quotes bigint, change_0 bigint, ends_0 {counts}, change_1 bigint, ends_1 {counts}",
        ),
        "splits",
    )
    # One row per split.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def before(c: str | Column) -> Column:
        return F.coalesce(F.sum(c).over(earlier), F.lit(0))

    starts = sums.withColumn("inside", F.pmod(before("quotes"), F.lit(2)))
    begins = F.col("inside") == 0
    starts = starts.withColumn("depth", before(F.when(begins, F.col("change_0")).otherwise(F.col("change_1"))))
    ends = F.when(begins, F.col("ends_0")).otherwise(F.col("ends_1"))
    starts = starts.withColumn("ended", F.coalesce(F.try_element_at(ends, -F.col("depth")), F.lit(0)))
    starts = starts.select("file", "block", "inside", "depth", before("ended").alias("number"))
    lost = F.raise_error(F.lit("the files were cut in other places than before: read them again"))
    met = cut.join(F.broadcast(stored(starts, "starts")), ["file", "block"], "left").select(
        "value", "file", "block", F.coalesce("inside", lost.cast("bigint")).alias("inside"), "depth", "number"
    )
    found = stored(met.mapInArrow(joined, "file string, block bigint, number bigint, whole boolean, text string"), "elements")
    over = found.where("not whole").select("file", "number", "block", "text")
    over = over.repartition(ranges, "file", "number") if ranges else over
    # The parts of one element.
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    over = over.groupBy("file", "number").agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    every = found.where("whole").select("file", "number", "text").unionByName(over.select("file", "number", text.alias("text")))
    bare = every.withColumn("text", F.regexp_replace("text", r"^[\s\[,\x{FEFF}]+", ""))
    bare = bare.where(F.startswith("text", F.lit("{")) & F.try_parse_json("text").isNotNull())
    # Of a path and its folder, the earlier one.
    given = spark.createDataFrame([(p.rstrip("/"), k) for k, p in reversed(list(enumerate(paths)))], "path string, place int")
    given = given.select(_plain(F.col("path")).alias("path"), "place").groupBy("path").agg(F.min("place").alias("place"))
    own = sums.select("file").distinct().withColumn("plain", _plain(F.col("file")))
    own = own.withColumn("own_path", F.explode(F.array("plain", F.regexp_replace("plain", "/[^/]*$", ""))))
    own = own.join(given, F.col("own_path") == F.col("path"), "left").groupBy("file").agg(F.min("place").alias("place"))
    placed = bare.join(F.broadcast(stored(own, "files")), "file", "left")
    return placed.select(F.struct("place", "file", "number").alias("seq"), "text")


def write_array(
    rows: DataFrame, path: str, order: Sequence[Column], files: int | None = None, compression: str = "none"
) -> None:
    """``rows`` as JSON arrays, one element a line, in ``files`` files (the shuffle partitions unless given) that are
    in order by name.

    A file is a range of the order, whose bounds Spark samples, and is sorted and written by one task; the brackets
    are set as the rows pass, so nothing comes between sorting and writing. ``compression`` is a codec of Spark's
    text sink; a compressed file is read by one task, so large tables then need as many files as tasks.
    """
    files = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"), F.struct(*order).alias("__order"))
    keys = [F.col("__order"), F.xxhash64("value")]

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = "[", None
        for batch in batches:
            values = batch.column("value").to_pylist()
            if not values:
                continue
            if held is not None:
                values.insert(0, held)
            held = values.pop()
            if values:
                lines = [value + "," for value in values]
                lines[0], head = head + lines[0], ""
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([head + held + "]"], pa.string())], names=["value"])

    sorted_lines = lines.repartitionByRange(files, *keys).sortWithinPartitions(*keys).select("value")
    sorted_lines.mapInArrow(bracketed, "value string").write.mode("overwrite").text(
        f"{path}/part=0", compression=compression
    )

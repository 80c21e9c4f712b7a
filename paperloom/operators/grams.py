"""A stored index of the three-character grams of chunks, and searches for strings by containment.

Chunks are numbered in the order in which searches rank them: the shorter first, then by file, place and id.  For each
gram and each block of numbers the index holds the sorted numbers of the chunks that contain it, as packed
differences.  A string's candidates are the chunks that have all its grams; its first candidates are verified on the
text, so the k shortest chunks that hold a string are found without looking at those behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shared_dir, written

SIZE = 3
#: Chunk numbers of a block of postings, as a power of two; differences within a block fit two bytes.
BLOCK_BITS = 14
#: Strings, times the candidates looked at of each, up to which they are broadcast (16 bytes each); beyond it joins are by sorting and merging.
BROADCAST_PAIRS = 1 << 20
#: Characters of asked strings up to which their grams are broadcast.
BROADCAST_CHARS = 4 << 20
#: Bytes of text or of posting lists that a task works on at once.
SLICE_BYTES = 2 << 20
_POSTINGS = "gram long, block long, n int, places binary"


class GramIndex(NamedTuple):
    """``chunks`` with ord (their number) and n_chars; ``postings``: gram, block, n, places."""

    chunks: DataFrame
    postings: DataFrame


def codes(points: np.ndarray) -> np.ndarray:
    """Grams that start at each place but the last two: three code points of 21 bits in one number."""
    p = points.astype(np.int64)
    return (p[:-2] << 42) | (p[1:-1] << 21) | p[2:]


def _sorted_distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def inverted(numbers: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(gram, block, packed places, how many) of the distinct grams of some texts with rising numbers."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < SIZE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    own = np.flatnonzero(of[: -SIZE + 1] == of[SIZE - 1 :])  # no gram goes over the border of two texts
    held = np.zeros(int(points.max()) + 1, bool)
    held[points] = True
    letters, bits = np.flatnonzero(held), max(1, (len(texts) - 1).bit_length())
    wide = max(1, (len(letters) - 1).bit_length())
    if SIZE * wide + bits <= 63:  # a gram by the places of its letters, and its text, fit one number: plain numbers are sorted, many times faster than their order is found
        p = (np.cumsum(held) - 1)[points]
        pairs = (((p[:-2] << 2 * wide | p[1:-1] << wide | p[2:])[own]) << bits) | of[own]
        pairs = _sorted_distinct(pairs)
        key, low = pairs >> bits, (1 << wide) - 1
        gram = (letters[key >> 2 * wide] << 42) | (letters[key >> wide & low] << 21) | letters[key & low]
    else:
        grams, at = np.unique(codes(points)[own], return_inverse=True)
        pairs = _sorted_distinct(at << bits | of[own])
        gram = grams[pairs >> bits]
    number = numbers[pairs & ((1 << bits) - 1)]
    block, place = number >> BLOCK_BITS, (number & ((1 << BLOCK_BITS) - 1)).astype(np.int32)
    head = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])])[: len(gram)])
    steps = np.diff(place, prepend=0)
    steps[head] = place[head]
    raw, cuts = steps.astype("<u2").tobytes(), [*(2 * head).tolist(), 2 * len(gram)]
    return gram[head], block[head], [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.diff([*head, len(gram)])


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has up to ``SLICE_BYTES`` in a column of strings, or one row: working arrays are many times a batch's size."""
    for batch in batches:
        total = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


def build(chunks: DataFrame, path: str | None = None) -> GramIndex:
    """Write the index of ``chunks`` (chunk_id, file_name, chunk_index, text) below ``path``, or a new shared folder.

    Chunks without a file name are left out; a null text has no gram; other columns stay with the chunks.  Texts are inverted where they lie, so
    what is shuffled is packed; files are sorted by gram, and a gram that many chunks hold is spread by its blocks.
    """
    path = path or shared_dir(chunks.sparkSession)
    order = ["n_chars", "file_name", "chunk_index", "chunk_id"]
    rows = chunks.filter("file_name IS NOT NULL").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id())
    stored = written(dealt, f"{path}/chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            gram, block, places, n = inverted(batch.column(0).to_numpy(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(block), pa.array(n, pa.int32()), pa.array(places, pa.binary())], ["gram", "block", "n", "places"])

    made = stored.select("ord", F.coalesce(F.lower("text"), F.lit(""))).mapInArrow(run, _POSTINGS)
    return GramIndex(stored, written(made.repartition("gram", "block").sortWithinPartitions("gram", "block"), f"{path}/postings"))


def load(spark, path: str) -> GramIndex:
    """The index that ``build`` wrote below ``path``."""
    return GramIndex(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/postings"))


def string_grams(strings: DataFrame) -> DataFrame:
    """(string, n_grams, gram): the distinct grams of each string of three characters or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in batch.column(0).to_pylist():
                own = np.unique(codes(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)))
                rows += [(s, len(own), g) for g in own.tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64()), strict=True)], ["string", "n_grams", "gram"])

    return strings.select("string").filter(F.length("string") >= SIZE).mapInArrow(run, "string string, n_grams int, gram long")


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(string, ord) of chunks that have all grams of a string, from posting rows sorted by string and block: a chunk is counted once a gram."""
    key, need, met = None, 0, np.zeros(1 << BLOCK_BITS, np.int64)

    def found() -> tuple[list[str], np.ndarray]:
        places = np.flatnonzero(met == need) if key else np.zeros(0, np.int64)
        return ([key[0]] * len(places), (key[1] << BLOCK_BITS) + places) if key else ([], places)

    for batch in slices(batches, 3):
        strings, ords = [], []
        for string, block, n, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (string, block) != key:  # a group may go on from the batch before
                own = found()
                strings += own[0]
                ords.append(own[1])
                key, need = (string, block), n
                met[:] = 0
            met[np.cumsum(np.frombuffer(places, "<u2"), dtype=np.int64)] += 1  # a list has a place once
        if strings:
            yield pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), pa.array(np.concatenate(ords))], ["string", "ord"])
    strings, ords = found()
    if strings:
        yield pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), pa.array(ords)], ["string", "ord"])


def candidates(index: GramIndex, grams: DataFrame, hint: str) -> DataFrame:
    """(string, ord): every chunk that has all grams of a string."""
    met = index.postings.join(grams.hint(hint), "gram").select("string", "block", "n_grams", "places")
    return met.repartition("string", "block").sortWithinPartitions("string", "block").mapInArrow(_common, "string string, ord long")


def shortest_holding(index: GramIndex, strings: DataFrame, k: int, holds: Column | None = None) -> DataFrame:
    """(string, ord, rank): the first ``k`` chunks in the index's order that hold each distinct lower-case ``string``, of three characters or more.

    ``holds`` is a further condition on string and low (the lower-case text).  Of each string the first 4 k candidates are verified; only for strings
    that then lack hits, and have further candidates, are all the others verified too.
    """
    grams = written(string_grams(strings.select("string").distinct()))
    size = grams.agg(F.sum(F.length("string") + 16).alias("chars"), F.count_distinct("string").alias("n")).first()
    hint = "broadcast" if (size.chars or 0) <= BROADCAST_CHARS else "merge"
    met = candidates(index, grams, hint)
    place = Window.partitionBy("string").orderBy("ord")
    texts = index.chunks.select("ord", F.lower("text").alias("low"))
    test = F.col("low").contains(F.col("string")) if holds is None else F.col("low").contains(F.col("string")) & holds

    def verified(rows: DataFrame, pairs: int) -> DataFrame:
        by = "broadcast" if pairs <= BROADCAST_PAIRS else "merge"
        return texts.join(rows.hint(by), "ord").filter(test).select("string", "ord")

    near = written(met.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= 4 * k + 1))
    first = written(verified(near.filter(F.col("place") <= 4 * k), size.n * 4 * k))
    got = first.groupBy("string").agg(F.count("*").alias("got"))
    lacking = near.filter(F.col("place") > 4 * k).select("string").join(got.hint("merge"), "string", "left").filter(F.coalesce("got", F.lit(0)) < k)
    lacking = lacking.select("string")
    if lacking.isEmpty():
        every = first
    else:
        lacking = written(lacking)
        more = candidates(index, grams.join(lacking.hint("merge"), "string", "left_semi"), hint)
        every = first.join(lacking.hint("merge"), "string", "left_anti").unionByName(verified(more, BROADCAST_PAIRS + 1))
    return every.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)

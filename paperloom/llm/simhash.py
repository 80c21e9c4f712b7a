"""Operator 7: SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed for whole batches with numpy, compared tile against
tile with exclusive-or and bit counts, and tiles whose population counts differ
beyond the radius never meet.  A tile pair gives links to a local root, not all
pairs, so a group of thousands of copies costs a link per member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components

RADIUS = 3
#: Fingerprints in a tile (512 KB).
TILE = 65_536
#: Comparisons in one numpy call.
BLOCK_CELLS = 1 << 21
#: XXH64's primes (fixed values).
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[[9, 10, 11, 12, 13]] = 0x20


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_slices(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of ``buf`` at once, slices of one length together.  ``buf`` needs 8 spare bytes at its end."""
    u8, u4 = (np.ndarray((len(buf) - n + 1,), kind, buf, strides=(1,)) for n, kind in ((8, "<u8"), (4, "<u4")))
    p1, p2, p3, p4, p5 = map(np.uint64, (P1, P2, P3, P4, P5))
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    with np.errstate(over="ignore"):

        def lane(acc, value):
            return _rotl(acc + value * p2, 31) * p1

        for group in np.split(order, cuts):
            if not len(group):
                continue
            at, size = starts[group], int(lengths[group[0]])
            k = 0
            if size >= 32:
                v = [np.full(len(group), (seed + a) & (2**64 - 1), np.uint64) for a in (P1 + P2, P2, 0, -P1)]
                while k + 32 <= size:
                    v = [lane(x, u8[at + k + 8 * i]) for i, x in enumerate(v)]
                    k += 32
                h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                zero = np.zeros(len(group), np.uint64)
                for x in v:
                    h = (h ^ lane(zero, x)) * p1 + p4
                h = h + np.uint64(size)
            else:
                h = np.full(len(group), (seed + P5 + size) & (2**64 - 1), np.uint64)
            while k + 8 <= size:
                h = _rotl(h ^ (_rotl(u8[at + k] * p2, 31) * p1), 27) * p1 + p4
                k += 8
            if k + 4 <= size:
                h = _rotl(h ^ (u4[at + k].astype(np.uint64) * p1), 23) * p2 + p3
                k += 4
            while k < size:
                h = _rotl(h ^ (buf[at + k].astype(np.uint64) * p5), 11) * p1
                k += 1
            h = (h ^ (h >> np.uint64(33))) * p2
            h = (h ^ (h >> np.uint64(29))) * p3
            out[group] = h ^ (h >> np.uint64(32))
    return out


def shingle_slices(data: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, lengths, document) of all word n-grams of lower-cased texts, words joined by one space.

    ``data`` holds the texts' bytes, ``ends`` where each ends.  A text of fewer words, but not none, has one shingle of all its words.
    """
    space = _SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[0] = True
    begins[ends] = True
    word = ~space
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = space[:-1]
    first = word & (before | begins[:-1])
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = space[1:]
    last = word & (after | begins[1:])
    kept = word.copy()
    kept[:-1] |= word[1:]
    place = np.cumsum(kept) - 1
    buf = np.zeros(int(kept.sum()) + 8, np.uint8)
    buf[:-8] = _LOWER[data[kept]]
    at = np.flatnonzero(first)
    starts, stops = place[at], place[np.flatnonzero(last)] + 1
    doc = np.searchsorted(ends, at, side="right")
    full = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1]) if len(doc) >= n else np.zeros(0, np.int64)
    head = np.flatnonzero(np.diff(doc, prepend=-1))
    tail = np.append(head[1:], len(doc))
    few = tail - head < n
    s = np.concatenate([starts[full], starts[head[few]]])
    e = np.concatenate([stops[full + n - 1], stops[tail[few] - 1]])
    d = np.concatenate([doc[full], doc[head[few]]])
    order = np.argsort(d, kind="stable")
    return buf, s[order], (e - s)[order], d[order]


def majority(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """64-bit fingerprints: a bit is set where over half of a document's hashes have it.  ``doc`` is sorted."""
    out = np.zeros(n_docs, np.uint64)
    if not len(hashes):
        return out
    head = np.flatnonzero(np.diff(doc, prepend=-1))
    size = np.diff(np.append(head, len(doc)))
    # byte counters hold up to 255, so documents are summed in runs of 255 hashes
    runs = np.concatenate([np.arange(a, a + n, 255) for a, n in zip(head.tolist(), size.tolist(), strict=True)])
    of = np.searchsorted(head, runs, side="right") - 1
    heads_of_runs = np.flatnonzero(np.diff(of, prepend=-1))
    mask, bits = np.uint64(0x0101010101010101), np.zeros((len(head), 64), bool)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & mask, runs)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), heads_of_runs, axis=0)
        bits[:, shift::8] = 2 * counts > size[:, None]
    out[doc[head]] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row ends; null: empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long) of every row: SimHash over word shingles of the whole text.  Null or wordless text: zero."""
    chunk = 1 << 20  # of text at a time: the working arrays are many times its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            data, ends = _text_bytes(batch.column(1))
            found = np.zeros(len(ends), np.uint64)
            while at < len(ends):
                base = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + chunk, side="right")))
                buf, starts, lengths, doc = shingle_slices(data[base : ends[to - 1]], ends[at:to] - base, shingle)
                found[at:to] = majority(xxh64_slices(buf, starts, lengths, seed), doc, to - at)
                at = to
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class _Roots:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view("<u2").reshape(-1, 4)).astype(np.int16)


def _cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of ``x`` by the population counts of its four quarters; the counts and the start of each cell."""
    q = _quarters(x)
    key = ((q[:, 0] * 17 + q[:, 1]).astype(np.int32) * 17 + q[:, 2]) * 17 + q[:, 3]
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.diff(key[order], prepend=-1))
    return order, q[order[head]], np.append(head, len(x))


def tile_links(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints of ``a`` and ``b`` within ``radius`` bits (a against b, exactly): each linked one and its local root."""
    same = a is b
    values = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    roots, linked = _Roots(len(values)), np.zeros(len(values), bool)

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        step = max(1, BLOCK_CELLS // max(1, len(j)))
        for at in range(0, len(i), step):
            rows = i[at : at + step]
            hit = np.bitwise_count(a[rows][:, None] ^ b[j][None, :]) <= radius
            n = int(np.count_nonzero(hit))
            if same:
                n -= int(np.count_nonzero(rows[:, None] == j[None, :])) if n else 0
            if not n:
                continue
            if n > 4 * (len(rows) + len(j)):  # dense: lowest label over hits, until nothing moves
                top = np.int64(len(values))
                left = np.array([roots.find(x) for x in rows.tolist()])
                right = np.array([roots.find(x + shift) for x in j.tolist()])
                while True:
                    low = np.minimum(left, np.where(hit, right[None, :], top).min(axis=1))
                    far = np.minimum(right, np.where(hit, low[:, None], top).min(axis=0))
                    done = np.array_equal(low, left) and np.array_equal(far, right)
                    left, right = low, far
                    if done:
                        break
                for x, root in zip((*rows.tolist(), *(j + shift).tolist()), (*left.tolist(), *right.tolist()), strict=True):
                    roots.join(x, root)
            else:
                for x, y in zip(*(k.tolist() for k in np.nonzero(hit)), strict=True):
                    roots.join(int(rows[x]), int(j[y]) + shift)
            linked[rows[hit.any(axis=1)]] = True
            linked[j[hit.any(axis=0)] + shift] = True

    if len(a) * len(b) <= 1 << 22:
        compare(np.arange(len(a)), np.arange(len(b)))
    else:
        order_a, cell_a, head_a = _cells(a)
        order_b, cell_b, head_b = (order_a, cell_a, head_a) if same else _cells(b)
        for c in range(len(cell_a)):
            near = np.flatnonzero(np.abs(cell_b - cell_a[c]).sum(axis=1) <= radius)
            if same:
                near = near[near >= c]
            if len(near):
                # the cells near one are gathered, so one comparison serves all
                j = np.concatenate([order_b[head_b[k] : head_b[k + 1]] for k in near])
                compare(order_a[head_a[c] : head_a[c + 1]], j)
    at = np.flatnonzero(linked)
    root = np.array([roots.find(x) for x in at.tolist()], np.int64)
    keep = at != root
    return values[at[keep]], values[root[keep]]


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fp`` within ``radius`` bits of each other.

    Tiles hold fingerprints of one population count, dealt by hash to some ``tile``
    a tile.  The counts of the 65 classes are all that reaches the driver.
    """
    classed = fps.select("fp", F.bit_count("fp").cast("int").alias("pop"))
    found = {r["pop"]: r["n"] for r in classed.groupBy("pop").agg(F.count("*").alias("n")).collect()}
    parts = F.array(*(F.lit(-(-found.get(p, 0) // tile)) for p in range(65)))  # of each class
    salt = F.pmod(F.xxhash64("fp"), F.greatest(F.lit(1), F.element_at(parts, F.col("pop") + 1))).cast("int")
    tiles = classed.withColumn("salt", salt).groupBy("pop", "salt").agg(F.collect_list("fp").alias("fps"))
    # each tile goes to its pairs with tiles of the classes within the radius; a pair is named by the lower one, then the higher
    other = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.greatest(F.lit(0), F.col("pop") - radius), F.least(F.lit(64), F.col("pop") + radius)),
                lambda p: F.when(
                    F.element_at(parts, p + 1) > 0,
                    F.transform(F.sequence(F.lit(0), F.element_at(parts, p + 1) - 1), lambda s: F.struct(p.alias("pop"), s.cast("int").alias("salt"))),
                ).otherwise(F.array().cast("array<struct<pop:int,salt:int>>")),
            )
        )
    )
    own = F.struct("pop", "salt")
    sent = tiles.withColumn("other", other).select(
        F.least(own, F.col("other")).alias("low"), F.greatest(own, F.col("other")).alias("high"), own.alias("own"), "fps"
    )
    # a number of its own: comparing takes far longer than the few bytes of a pair let AQE expect
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = sent.repartition(n, "low", "high").groupBy("low", "high").agg(F.sort_array(F.collect_list(F.struct("own", "fps"))).alias("sides"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sides in batch.column(0):
                arrays = [s["fps"].values.to_numpy(zero_copy_only=False).view(np.uint64) for s in sides]
                x, y = tile_links(arrays[0], arrays[-1], radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return pairs.select("sides").mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable) of every row.

    Null text: fingerprint zero.  Rows with a null id are kept, never give a
    component its id, and have a null one where no row of theirs has an id.
    Repeated rows stay rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = materialize(components(near_links(distinct.select("fp"), radius)))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialize(rooted)
    smallest = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    classes = materialize(rooted.join(smallest.hint("merge"), "root").select("fp", "component_id"))
    # a hot fingerprint's rows can be split: both sides are read from files
    return prints.join(classes.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))

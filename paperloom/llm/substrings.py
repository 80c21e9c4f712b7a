"""Operator 8: removal of repeated byte substrings, exact, by longest previous factors.

A byte goes if it lies in a ``LENGTH``-byte string that also starts in a document
of smaller id.  A suffix array of the whole corpus would be sorted in one
place, so suffixes are dealt first: each window of ``LENGTH`` bytes belongs to the
gram of least hash inside it, which depends on the window's content alone, so
equal windows meet.  Three rounds over the texts, each in whole blocks:

1. (gram, content of the gram's windows) of every block is sent once, to the part of
   the gram, as 32 and 64 hash bits: naming, as in the building of a suffix array.  A content met in an
   earlier document has that name's first document as previous factor, whole; a gram that no
   earlier document has settles its windows too.
2. The first of each content whose gram an earlier document has in another content is sent in
   full.  Each part builds the suffix array of their windows with its LCP array; the previous and
   next smaller documents in suffix order give the longest previous factors, and windows with one
   of ``LENGTH`` go.  A gram with very many contents is dealt anew, window by window, so no
   group holds more than ``HOT_CONTENTS`` of one gram.
3. What is settled either way is cut from the texts.

Texts stay in a table bucketed by block and are never shuffled.  Equality of the 96 bits of a name counts as
equality of bytes: for N names one pair is taken wrongly with a chance of about N * N / 2 ** 97.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shared_dir, table

LENGTH = 50
GRAM = 20
#: Bytes of text in a block, window positions handled at once, and bytes of text for each part of the grams.
BLOCK_BYTES, SEGMENT, PART_BYTES = 8 << 20, 1 << 20, 8 << 20
#: Contents of one gram up to which their windows are compared together.
HOT_CONTENTS = 4096
_NO_ID = 2**63 - 1
#: Odd multipliers of the hashes.
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_POSITION = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the ``GRAM`` bytes at each of the first ``n`` places; ``data`` has them all and 4 bytes more."""
    u8 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    u4 = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    x = u8[:n] * _K[0]
    x ^= x >> np.uint64(32)
    x += u8[8 : n + 8]
    x *= _K[1]
    x ^= x >> np.uint64(29)
    x += u4[16 : n + 16]
    x *= _K[2]
    x ^= x >> np.uint64(32)
    return x


def anchors(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The anchors of a block: gram place, first and last window, document, hash of the gram and of the windows' bytes.

    The least hash is taken by its upper 40 bits, then the leftmost place, so the
    choice depends on a window's bytes alone.
    """
    width = LENGTH - GRAM + 1
    padded = np.concatenate([data, np.zeros(2 * LENGTH + 64, np.uint8)])
    valid = np.ones(len(data), bool)
    start = 0
    for end in ends.tolist():
        valid[max(start, end - LENGTH + 1) : end] = False
        start = end
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("c", "p1", "p2", "gram", "content")}
    for s in range(0, len(data), SEGMENT):
        at = np.flatnonzero(valid[s : s + SEGMENT])
        if not len(at):
            continue
        n = int(at[-1]) + 1 + 2 * LENGTH
        h = gram_hashes(padded[s : s + n + 32], n)
        low = (h & ~_POSITION) | np.arange(n, dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        rest = width - span
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        c = (low[at] & _POSITION).astype(np.int64)
        head = np.flatnonzero((np.diff(c, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
        tail = np.append(head[1:], len(at)) - 1
        c, p1, p2 = c[head], at[head], at[tail]
        last = p2 + LENGTH - GRAM  # grams that cover the windows' bytes: at most 2 * LENGTH - GRAM = 4 * GRAM of them
        x = h[p1] * _K[1]
        for step in (GRAM, 2 * GRAM, 3 * GRAM):
            x ^= x >> np.uint64(32)
            x = (x + h[np.minimum(p1 + step, last)]) * _K[0]
        x ^= x >> np.uint64(29)
        x = (x + (c - p1).astype(np.uint64) * _K[2] + (p2 - p1).astype(np.uint64) * _K[3]) * _K[1]
        g = h[c] * _K[3]
        for name, value in (("c", c + s), ("p1", p1 + s), ("p2", p2 + s), ("gram", g ^ (g >> np.uint64(31))), ("content", x ^ (x >> np.uint64(32)))):
            out[name].append(value)
    found = {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k in ("gram", "content") else np.int64) for k, v in out.items()}
    return found | {"doc": np.searchsorted(ends, found["p1"], side="right")}


class Block:
    """A block's anchors and its entries: each (gram, content) once, with the smallest document id that has it."""

    def __init__(self, data: bytes, ends: np.ndarray, ids: np.ndarray, parts: int):
        self.data, self.ends, self.ids = np.frombuffer(data, np.uint8), ends, ids
        a = self.anchors = anchors(self.data, ends)
        self.doc_id = ids[a["doc"]]
        both = (a["gram"] * _K[0]) ^ a["content"]
        order = np.lexsort((self.doc_id, both))
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (both, a["gram"], a["content"])], axis=0)
        head = order[new]
        part = ((a["gram"][head] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        self.entry, part = head[by_part], part[by_part]  # anchor that stands for each entry
        rank = np.empty(len(head), np.int64)
        rank[by_part] = np.arange(len(head))
        self.of = np.empty(len(order), np.int64)  # entry of each anchor
        self.of[order] = rank[np.cumsum(new) - 1]
        self.part, starts = np.unique(part, return_index=True)  # the parts that have entries, and where those are
        self.cuts = [slice(x, y) for x, y in zip(starts, [*starts[1:], len(part)], strict=True)]

    def entries(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(part, grams, contents, ids) of each part."""
        gram = (self.anchors["gram"][self.entry] & np.uint64(0xFFFFFFFF)).astype("<u4")
        content, ids = self.anchors["content"][self.entry], self.doc_id[self.entry]
        for p, cut in zip(self.part.tolist(), self.cuts, strict=True):
            yield p, gram[cut].tobytes(), content[cut].tobytes(), ids[cut].tobytes()

    def states(self, answers: list[dict]) -> np.ndarray:
        """The state of each entry, from the answers of the parts."""
        out = np.zeros(len(self.entry), np.uint8)
        for a in answers:
            cut = self.cuts[int(np.searchsorted(self.part, a["part"]))]
            bits = np.unpackbits(np.frombuffer(a["states"], np.uint8), count=2 * (cut.stop - cut.start)).reshape(-1, 2)
            out[cut] = 2 * bits[:, 0] + bits[:, 1]
        return out

    def contexts(self, state: np.ndarray, parts: int) -> Iterator[tuple]:
        """(part, entries, shifts, grams, ids, lengths, bytes) of the windows to be compared, for each part: whole contexts, or single windows of hot grams.

        ``shifts`` has the number of each context's first window among its entry's.  Windows of hot grams that an earlier
        document of this block has are settled here: part -1, and their entries and numbers.
        """
        p1, n = self.anchors["p1"][self.entry], self.anchors["p2"][self.entry] - self.anchors["p1"][self.entry] + 1
        gram = (self.anchors["gram"][self.entry] & np.uint64(0xFFFFFFFF)).astype("<u4")
        for p, cut in zip(self.part.tolist(), self.cuts, strict=True):
            which = cut.start + np.flatnonzero(state[cut] == SEND)
            if len(which):
                yield p, *self._sent(which, np.zeros(len(which), np.int64), gram[which], n[which] + LENGTH - 1)
        hot = np.flatnonzero(state == HOT)
        if not len(hot):
            return
        which = np.repeat(hot, n[hot])
        shift = np.arange(len(which)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
        lanes = window_lanes(self.data, p1[which] + shift)
        sign = np.zeros(len(which), np.uint64)
        for lane in lanes:
            sign = (sign ^ lane) * _K[0]
            sign ^= sign >> np.uint64(29)
        ids = self.doc_id[self.entry[which]]
        known = previous_factors(lanes, ids, LENGTH) >= LENGTH
        yield -1, which[known].astype("<u4").tobytes(), shift[known].astype(np.uint8).tobytes(), b"", b"", b"", b""
        which, shift, sign = which[~known], shift[~known], sign[~known]
        to = ((sign >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
            yield int(to[own[0]]), *self._sent(which[own], shift[own], (sign[own] & np.uint64(0xFFFFFFFF)).astype("<u4"), np.full(len(own), LENGTH))

    def _sent(self, which: np.ndarray, shift: np.ndarray, gram: np.ndarray, size: np.ndarray) -> tuple:
        a = self.entry[which]
        at = np.repeat(self.anchors["p1"][a] + shift - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return which.astype("<u4").tobytes(), shift.astype(np.uint8).tobytes(), gram.tobytes(), self.doc_id[a].tobytes(), size.astype(np.uint8).tobytes(), self.data[at].tobytes()

    def removed(self, state: np.ndarray, masks: list[dict]) -> np.ndarray:
        """Whether each byte goes."""
        a, change = self.anchors, np.zeros(len(self.data) + 1, np.int32)
        gone = (state[self.of] == EARLIER) | (self.doc_id > self.doc_id[self.entry][self.of])
        np.add.at(change, a["p1"][gone], 1)
        np.add.at(change, a["p2"][gone] + LENGTH, -1)
        of_entry = np.zeros(len(self.entry), np.uint32)
        for m in masks:
            np.bitwise_or.at(of_entry, np.frombuffer(m["entries"], "<u4"), np.frombuffer(m["masks"], "<u4"))
        hit = np.flatnonzero(of_entry[self.of])  # all anchors of an entry, not only the one that was sent
        bits = of_entry[self.of[hit]]
        for i in range(LENGTH - GRAM + 1):
            p = a["p1"][hit[(bits >> np.uint32(i)) & 1 == 1]] + i
            np.add.at(change, p, 1)
            np.add.at(change, p + LENGTH, -1)
        return np.cumsum(change[:-1]) > 0


#: States of an entry: nothing earlier; all its windows are in an earlier document; to be compared in full, as a whole or window by window.
NOTHING, EARLIER, SEND, HOT = 0, 1, 2, 3


def settle(gram: np.ndarray, content: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """State of each entry of a part."""
    order = np.lexsort((ids, content, gram))
    g, c, d = gram[order], content[order], ids[order]
    new_gram = np.diff(g, prepend=g[:1] + np.uint32(1)) != 0 if len(g) else np.zeros(0, bool)
    if len(g):
        new_gram[0] = True
    new_content = new_gram | (np.diff(c, prepend=c[:1]) != 0)
    of_gram, of_content = np.cumsum(new_gram) - 1, np.cumsum(new_content) - 1
    heads = np.flatnonzero(new_content)
    first = d[heads][of_content]
    low, high = (f.reduceat(d[heads], np.flatnonzero(new_gram[heads]))[of_gram] if len(g) else d for f in (np.minimum, np.maximum))
    several = low < high
    contents = np.bincount(of_gram[heads])[of_gram] if len(g) else d
    found = np.where(d > first, EARLIER, np.where(~several, NOTHING, np.where(contents > HOT_CONTENTS, HOT, SEND))).astype(np.uint8)
    out = np.empty(len(g), np.uint8)
    out[order] = found
    return out


def window_lanes(text: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The ``LENGTH`` bytes from each place as big-endian numbers, of which the last overlaps."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    u8 = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    return [u8[at + k].astype(np.uint64) for k in (*range(0, LENGTH - 8, 8), LENGTH - 8)]


def common_prefixes(lanes: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """LCP array: common bytes of each suffix and the next one in order, up to ``LENGTH``."""
    out = np.full(max(0, len(order) - 1), LENGTH)
    steps = np.array([1 << (8 * k) for k in range(1, 8)], np.uint64)
    for k in range(len(lanes) - 1, -1, -1):
        differ = lanes[k][order[1:]] ^ lanes[k][order[:-1]]
        at = np.flatnonzero(differ)
        out[at] = min(8 * k, LENGTH - 8) + 7 - np.searchsorted(steps, differ[at], side="right")
    return out


def nearest_smaller(lcp: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each suffix the common prefix with the nearest suffix before it, in order, of a smaller document; what is under ``least`` may be any value under it.

    A pointer to a suffix whose document isn't smaller jumps to where that one's own pointer leads, all at once.
    """
    to, common = np.arange(len(doc)) - 1, np.concatenate([[0], lcp])[: len(doc)]
    todo = np.flatnonzero(common >= least)
    while len(todo := todo[(common[todo] >= least) & (doc[to[todo]] >= doc[todo])]):
        via = to[todo]
        to[todo], common[todo] = to[via], np.minimum(common[todo], common[via])
    return common


def previous_factors(lanes: list[np.ndarray], doc: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factor of each suffix, up to ``LENGTH``: its longest prefix that also starts in a smaller document.

    The suffix array is sorted by the lanes; in it the longest match in smaller documents is next to a
    suffix's previous or next smaller one.  Factors under ``least`` may come out as any value under it.
    """
    order = np.lexsort(lanes[::-1])
    lcp, ranked = common_prefixes(lanes, order), doc[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(nearest_smaller(lcp, ranked, least), nearest_smaller(lcp[::-1], ranked[::-1], least)[::-1])
    return out


def earlier_windows(ids: np.ndarray, size: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each context, a bit for each of its windows that starts in an earlier document."""
    n_windows = size.astype(np.int64) - LENGTH + 1
    ctx = np.repeat(np.arange(len(size)), n_windows)
    i = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = np.repeat(np.cumsum(size.astype(np.int64)) - size, n_windows) + i
    hit = np.flatnonzero(previous_factors(window_lanes(text, at), ids[ctx], LENGTH) >= LENGTH)
    masks = np.zeros(len(size), np.uint32)
    np.bitwise_or.at(masks, ctx[hit], np.uint32(1) << i[hit].astype(np.uint32))
    return masks


def _batch(names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def write_blocks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Texts as bytes in blocks, with their rows' other columns, in a bucketed table; and the number of buckets."""
    spark = docs.sparkSession
    names = docs.columns
    at_id, at_text = names.index(id_col), names.index(text_col)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            text = batch.column(at_text).fill_null("").cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset))
            ids = batch.column(at_id).cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK_BYTES, side="right")))
                sink = pa.BufferOutputStream()
                own = batch.slice(at, to - at)
                own = own.set_column(at_text, batch.schema.field(at_text), pa.nulls(to - at, batch.column(at_text).type))
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_batch(own)
                data = b"".join(x.as_py() for x in text.slice(at, to - at))
                row = ((part << 32) | seq, len(data), ids[at:to].tobytes(), np.cumsum(sizes[at:to]).tobytes(), sink.getvalue().to_pybytes(), data)
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
                yield _batch(["block", "size", "ids", "ends", "rows", "data"], [row], kinds)
                seq, at = seq + 1, to

    blocks = docs.mapInArrow(pack, "block long, size long, ids binary, ends binary, rows binary, data binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"blocks_{uuid.uuid4().hex}"
    writer = blocks.write.bucketBy(buckets, "block").option("path", shared_dir(spark)).option("compression", "zstd")
    writer.saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry alone: files of an external table stay, and what was looked up reads them
    return found, buckets


def _load(batch: pa.RecordBatch, i: int, parts: int) -> Block:
    get = lambda c: batch.column(c)[i].as_py()
    return Block(get("data"), np.frombuffer(get("ends"), np.int64), np.frombuffer(get("ids"), np.int64), parts)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, then kept (binary) and spans (array of [start, end) byte ranges removed).

    Ids are integers.  Null text: empty.  A null id is larger than any other; rows of equal id don't take
    from each other; repeated rows stay rows.  Columns named kept or spans are replaced.
    """
    docs = docs.drop("kept", "spans")
    blocks, _ = write_blocks(docs, id_col, text_col)
    total = blocks.agg(F.sum("size")).first()[0] or 0
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, -(-total // PART_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                rows = [(p, block, g, c, d) for p, g, c, d in _load(batch, i, parts).entries()]
                yield _batch(["part", "block", "gram", "content", "ids"], rows, [pa.int32(), pa.int64(), *[pa.binary()] * 3])

    def answer(group: pa.Table) -> pa.Table:
        joined = [np.frombuffer(b"".join(x.as_py() for x in group.column(c)), k) for c, k in (("gram", "<u4"), ("content", np.uint64), ("ids", np.int64))]
        state = settle(*joined)
        bits = np.stack([state >> 1, state & 1], axis=1)
        ends = np.cumsum([len(x.as_py()) // 4 for x in group.column("gram")])
        packed = [np.packbits(bits[a:b]).tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.table([group.column("block"), group.column("part"), pa.array(packed, pa.binary())], ["block", "part", "states"])

    columns = ["block", "ids", "ends", "data"]
    sent = blocks.select(*columns).mapInArrow(send, "part int, block long, gram binary, content binary, ids binary")
    answers = sent.repartition(parts, "part").groupBy("part").applyInArrow(answer, "block long, part int, states binary")
    # one row a block: 2 bits for each of its entries
    answers = materialize(answers.groupBy("block").agg(F.collect_list(F.struct("part", "states")).alias("answers")))

    def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, block = _load(batch, i, parts), batch.column("block")[i].as_py()
                rows = [(p, block, *x) for p, *x in held.contexts(held.states(batch.column("answers")[i].as_py() or []), parts)]
                yield _batch(["part", "block", "entries", "shift", "gram", "ids", "size", "text"], rows, [pa.int32(), pa.int64(), *[pa.binary()] * 6])

    def compare(group: pa.Table) -> pa.Table:
        kinds = {"entries": "<u4", "shift": np.uint8, "gram": "<u4", "ids": np.int64, "size": np.uint8, "text": np.uint8}
        settled = group.column("part")[0].as_py() < 0
        got = {c: np.frombuffer(b"".join(x.as_py() for x in group.column(c)), k) for c, k in kinds.items()}
        ends = np.cumsum([len(x.as_py()) // 4 for x in group.column("entries")])
        masks = np.full(len(got["entries"]), int(settled), "<u4")
        # some thousand contexts at a time, whole grams together
        by_gram = np.argsort(got["gram"], kind="stable")
        at_text = np.cumsum(got["size"].astype(np.int64)) - got["size"]
        ordered = got["gram"][by_gram]
        a = 0
        while a < len(by_gram):
            b = min(len(by_gram), a + 50_000)
            b = int(np.searchsorted(ordered, ordered[b - 1], side="right"))
            which = by_gram[a:b]
            size = got["size"][which].astype(np.int64)
            at = np.repeat(at_text[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            masks[which] = earlier_windows(got["ids"][which], got["size"][which], got["text"][at])
            a = b
        masks = masks << got["shift"].astype(np.uint32)
        rows = []
        for block, x, y in zip(group.column("block").to_pylist(), [0, *ends[:-1]], ends, strict=True):
            hit = x + np.flatnonzero(masks[x:y])
            if len(hit):
                rows.append((block, got["entries"][hit].tobytes(), masks[hit].astype("<u4").tobytes()))
        return pa.Table.from_batches([_batch(["block", "entries", "masks"], rows, [pa.int64(), pa.binary(), pa.binary()])])

    answered = blocks.select(*columns).join(answers.hint("shuffle_hash"), "block", "left")
    contexts = answered.mapInArrow(send_contexts, "part int, block long, entries binary, shift binary, gram binary, ids binary, size binary, text binary")
    salted = F.when(F.col("part") < 0, -1 - F.col("block") % parts).otherwise(F.col("part"))  # what a block settles itself goes back by block
    masks = contexts.withColumn("part", salted.cast("int")).repartition(parts, "part").groupBy("part").applyInArrow(compare, "block long, entries binary, masks binary")
    masks = materialize(masks.groupBy("block").agg(F.collect_list(F.struct("entries", "masks")).alias("masks")))

    kept_columns = [c for c in docs.columns if c != text_col]
    schema = docs.select(*kept_columns).schema.add("kept", T.BinaryType()).add("spans", T.ArrayType(T.ArrayType(T.IntegerType())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = _load(batch, i, parts)
                gone = held.removed(held.states(batch.column("answers")[i].as_py() or []), batch.column("masks")[i].as_py() or [])
                rows = pa.ipc.open_stream(batch.column("rows")[i].as_py()).read_all().combine_chunks()
                kept, spans, start = [], [], 0
                for end in held.ends.tolist():
                    own = gone[start:end]
                    if own.any():
                        edges = np.flatnonzero(np.diff(own, prepend=False, append=False))
                        kept.append(held.data[start:end][~own].tobytes())
                        spans.append(edges.reshape(-1, 2).tolist())
                    else:
                        kept.append(held.data[start:end].tobytes())
                        spans.append([])
                    start = end
                for at in range(0, len(kept), 512):
                    part = rows.select(kept_columns).slice(at, 512).combine_chunks()
                    arrays = [part.column(c).chunk(0) if part.column(c).num_chunks else pa.array([], part.column(c).type) for c in kept_columns]
                    arrays += [pa.array(kept[at : at + 512], pa.binary()), pa.array(spans[at : at + 512], pa.list_(pa.list_(pa.int32())))]
                    yield pa.RecordBatch.from_arrays(arrays, [*kept_columns, "kept", "spans"])

    full = blocks.join(answers.hint("shuffle_hash"), "block", "left").join(masks.hint("shuffle_hash"), "block", "left")
    return full.select("block", "ids", "ends", "rows", "data", "answers", "masks").mapInArrow(cut, schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

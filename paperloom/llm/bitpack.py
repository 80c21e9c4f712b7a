"""Operator 4: token ids in fixed-width bit-packed segments.

A segment is one byte string: a header, the end of each document in tokens, the
byte offset of each block of ``BLOCK`` ids, then the blocks, every id in the
minimum bits of the vocabulary, most significant bit first.  Blocks start at
whole bytes, so any one is unpacked by numpy without its neighbours.  Segments
are rows of a Parquet table, which any store that Spark writes can hold and
whose commit survives lost executors and repeated tasks.
"""

from __future__ import annotations

import functools
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pieces
from .common import shared_dir, table

MAGIC = b"TBP1"
BLOCK = 4096
#: Text bytes after which a segment is closed.  A longer document has a segment to itself.
SEGMENT_BYTES = 4 << 20
SEGMENT = "part int, segment int, start_in_part long, n_tokens long, doc_ids array<bigint>, payload binary"


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_block(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width :]).tobytes()


def unpack_block(raw: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f">u{width // 8}", n).astype(np.uint32)
    bits = np.zeros((n, 32), np.uint8)
    bits[:, 32 - width :] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1).view(">u4").ravel().astype(np.uint32)


def pack(documents: list[np.ndarray], vocabulary: int, block: int = BLOCK) -> bytes:
    """One segment from the ids of whole documents, in order."""
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    return pack_ids(ids, np.cumsum([len(d) for d in documents], dtype="<u8"), vocabulary, block)


def pack_ids(ids: np.ndarray, ends: np.ndarray, vocabulary: int, block: int = BLOCK) -> bytes:
    """One segment from the ids of all its documents and each one's end among them."""
    width = width_of(vocabulary)
    if len(ids) and int(ids.max()) >= 1 << width:
        raise ValueError("an id does not fit the vocabulary's bits")
    ends = ends.astype("<u8")
    blocks = [pack_block(ids[i : i + block], width) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    head = MAGIC + struct.pack("<IIQQ", width, block, len(ends), len(ids))
    return b"".join([head, ends.tobytes(), offsets.tobytes(), *blocks])


class Segment:
    """Random access to a packed segment: ``segment[i]`` is document i, ``slice`` any range of tokens."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.width, self.block, n_docs, self.n_tokens = struct.unpack_from("<IIQQ", raw, 4)
        at = 4 + struct.calcsize("<IIQQ")
        self.ends = np.frombuffer(raw, "<u8", n_docs, at).astype(np.int64)
        n_blocks = -(-self.n_tokens // self.block)
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1, at + 8 * n_docs).astype(np.int64)
        self.raw, self.base = memoryview(raw), at + 8 * n_docs + 8 * (n_blocks + 1)

    def slice(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        out = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_tokens - b * self.block)
            out.append(unpack_block(self.raw[self.base + self.offsets[b] : self.base + self.offsets[b + 1]], n, self.width))
        return np.concatenate(out)[start - first * self.block : end - first * self.block]

    def __getitem__(self, i: int) -> np.ndarray:
        return self.slice(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def __len__(self) -> int:
        return len(self.ends)


@functools.cache
def encoder_of(path: str) -> Encoder:
    """The encoder of a tokenizer file, one for all tasks of a worker process."""
    return Encoder(path)


class Encoder:
    """Ids of whole texts by the tokenizers library; a piece met before comes from a memo, as ids of ``size`` bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.size = 2 if self.vocabulary <= 1 << 16 else 4
        self.kind = f"<u{self.size}"
        tokenize, letters, code = self.tokenizer.model.tokenize, pieces.byte_alphabet(), "H" if self.size == 2 else "I"

        def encode(piece: str) -> bytes:
            spelled = piece.encode().decode("latin-1").translate(letters)
            return array(code, [t.id for t in tokenize(spelled)]).tobytes()

        self.memo = pieces.Memo(encode, 250_000)

    def __call__(self, text: str) -> bytes:
        if not pieces.plain(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.memo.__getitem__, pieces.BYTE_LEVEL.findall(text)))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write segments in ascending id order below ``path``.

    Null text: empty, so the end id alone.  Null ids come first; equal ids are ordered by text.  An empty
    table gives no segment; other columns are left out, whatever their names.  Rows of one id are one task's,
    and a text of any length is encoded whole.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        part, seq, done = TaskContext.get().partitionId(), 0, 0
        ids, ends, held, tokens, size = [], [], [], 0, 0
        end = np.array([end_id], encoder.kind).tobytes()

        def closed() -> pa.RecordBatch:
            packed = pack_ids(np.frombuffer(b"".join(held), encoder.kind), np.array(ends), encoder.vocabulary)
            row = {"part": [part], "segment": [seq], "start_in_part": [done], "n_tokens": [tokens], "doc_ids": [ids], "payload": [packed]}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for doc_id, text, n_bytes in zip(batch.column(0).to_pylist(), batch.column(1), sizes, strict=True):
                found = encoder(text.as_py() or "") + end
                ids.append(doc_id)
                held.append(found)
                tokens += len(found) // encoder.size
                ends.append(tokens)
                size += n_bytes
                if size >= SEGMENT_BYTES:
                    yield closed()
                    seq, done = seq + 1, done + tokens
                    ids, ends, held, tokens, size = [], [], [], 0, 0
        if ids:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(segments, SEGMENT).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``, the tokens before each: a running sum over the parts, of which there are as many as tasks wrote."""
    stored = spark.read.schema(SEGMENT).parquet(path)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row for each writing task, so a bounded broadcast
    joined = stored.join(F.broadcast(bases), "part")
    return joined.select((F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "doc_ids", "payload")


def document_digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and CRC-32 of each document, from the packed ids alone."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, ids, payload in zip(batch.column("start"), batch.column("doc_ids"), batch.column("payload"), strict=True):
                segment = Segment(payload.as_py())
                whole = segment.slice(0, segment.n_tokens).astype("<u4")
                ends = segment.ends.tolist()
                starts = [0, *ends[:-1]]
                crc = [zlib.crc32(whole[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids.as_py(), pa.int64()),
                        pa.array(np.array(starts, np.int64) + start.as_py()),
                        pa.array(np.diff([0, *ends]).astype(np.int64)),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("start", "doc_ids", "payload").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return document_digests(read_tokens(spark, path))

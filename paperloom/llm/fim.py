"""Operator 12: fill-in-the-middle by memoized content-defined chunks.

A rolling hash over the bytes of a batch cuts texts into chunks whose borders depend on content alone, so
texts that share passages share chunks.  A chunk's summary (line ends, code points, marks in it
and across its borders) is taken from a memo whose keys are the chunks themselves, so a hit is verified on content.
Adding up the counts of a text's chunks gives its number of lines, and finds the chunk and the place of each cut.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pieces import Memo

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
#: Of 100 documents, those transformed, and of these those with the suffix first; seed of the document's four numbers.
RATE, SPM_RATE, SEED = 100, 50, 7
#: Bytes that the rolling hash covers (a power of two), and the mean length of a chunk as a power of two.
ROLL, CHUNK_BITS = 16, 9
#: Chunks that the memo of a worker holds, and bytes of the longest one it keeps.
MEMO_CHUNKS, MEMO_BYTES = 50_000, 1 << 14
#: Bytes of text that are hashed at once.
BATCH_BYTES = 1 << 22
_FACTOR = 0x9E3779B1


def numbers(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers of a document; one without an id has those of an empty id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the ``ROLL`` bytes that end at each place (of fewer at the start), doubled in width step by step."""
    h, width, factor = data.astype(np.uint32) + np.uint32(1), 1, _FACTOR
    while width < ROLL:
        wider = h.copy()
        wider[width:] += h[:-width] * np.uint32(factor)
        h, width, factor = wider, 2 * width, factor * factor % (1 << 32)
    return h


def borders(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk ends: where the hash's upper bits are zero."""
    h = rolling(data) * np.uint32(0x85EBCA6B)
    return np.flatnonzero(h < np.uint32(1 << (32 - CHUNK_BITS))) + 1


def code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else int(((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80).sum())


def summary(chunk: bytes) -> tuple[tuple[int, ...], int, bool]:
    """(places after its line ends, code points that begin in it, whether it holds a mark)."""
    ends = np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10) + 1
    return tuple(ends.tolist()), code_points(chunk), any(m in chunk for m in _MARKS)


_memo = Memo(summary, MEMO_CHUNKS, MEMO_BYTES)


class ChunkedText:
    """A text as its chunks, with running totals of their bytes, line ends and code points."""

    def __init__(self, raw: bytes, cuts: list[int]):
        self.raw = raw
        self.chunks = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True) if b > a]
        found = [_memo[c] for c in self.chunks]
        self.ends = [f[0] for f in found]
        self.starts = [0, *accumulate(map(len, self.chunks))]
        self.lines = [0, *accumulate(map(len, self.ends))]
        self.points = [0, *accumulate(f[1] for f in found)]
        self.marked = any(f[2] for f in found) or self._mark_across()

    def _mark_across(self) -> bool:
        tail = b""
        for chunk in self.chunks:
            if any(m in tail + chunk[:2] for m in _MARKS):
                return True
            tail = (tail + chunk)[-2:]
        return False

    def units(self) -> int:
        """Lines, a last one without its line end included."""
        return self.lines[-1] + (self.raw[-1:] not in (b"", b"\n"))

    def place(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) before the ``unit``-th unit's end."""
        if unit == 0:
            return 0, 0
        if unit > self.lines[-1]:
            return len(self.raw), self.points[-1]
        k = bisect_left(self.lines, unit) - 1
        at = self.ends[k][unit - self.lines[k] - 1]
        return self.starts[k] + at, self.points[k] + code_points(self.chunks[k][:at])


def transform(text: ChunkedText, drawn: list[int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    n = text.units()
    if not text.raw or text.marked or drawn[2] % 100 >= rate:
        return n, "plain", None, None, text.raw
    (a, a_points), (b, b_points) = sorted((text.place(drawn[0] % (n + 1)), text.place(drawn[1] % (n + 1))))
    prefix, middle, suffix = text.raw[:a], text.raw[a:b], text.raw[b:]
    p, s, m = _MARKS
    spm = drawn[3] % 100 < spm_rate
    out = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
    return n, "spm" if spm else "psm", a_points, b_points - a_points, out


MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output of each whole text.

    A null or empty text, and one that holds a mark, is plain: its own output, with null prefix_chars and middle_chars.  Rows are handled one
    by one, so repeated rows give equal results; a text of any length is held once in its batch; an empty table gives no row.
    Columns of the made names are replaced, others stay.
    """
    kept = [c for c in docs.columns if c not in MADE]
    place, id_place = kept.index(text_col), kept.index(id_col)
    schema = docs.select(*kept).schema
    for name, kind in zip(MADE, ("long", "string", "long", "long", "string"), strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place).cast(pa.binary()).fill_null(b"")
            ids, at = batch.column(id_place).to_pylist(), 0
            while at < batch.num_rows:
                raws, size, to = [], 0, at
                while to < batch.num_rows and (to == at or size < BATCH_BYTES):
                    raws.append(column[to].as_py())
                    size += len(raws[-1])
                    to += 1
                cuts, ends = borders(np.frombuffer(b"".join(raws), np.uint8)), list(accumulate(map(len, raws)))
                first = np.searchsorted(cuts, [0, *ends], side="right").tolist()
                rows = []
                for k, raw in enumerate(raws):
                    own = cuts[first[k] : first[k + 1]] - (ends[k] - len(raw))
                    rows.append(transform(ChunkedText(raw, own.tolist()), numbers(ids[at + k], seed), rate, spm_rate))
                n, form, prefix, middle, out = zip(*rows, strict=True)
                made = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns), *made], [*kept, *MADE])
                at = to

    return docs.select(*kept).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone."""
    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring(output, F.instr(output, F.lit(a)) + len(a), F.length(output)), b, 1)

    middle = F.substring(output, F.instr(output, F.lit(MIDDLE)) + len(MIDDLE), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_PLAIN = f"text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE}"
ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT doc_id, text, l, len(l) AS n, {", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM t),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN {_PLAIN} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:], '') AS suffix FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

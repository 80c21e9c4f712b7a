"""Operator 10: WARC archives with an externally merged capture index.

Archives are gzip files with a member a record, so the index's offset and length find one record
without reading others.  They are written by Spark's text sink, whose rows are the members' bytes; its
line ends are zero bytes, which gzip allows as padding between members.  Each file is
sorted by (URL key, capture time, id), so the index entries read back from a
file form a locally sorted run.  The runs are dealt by ranges of the sort key,
and each range merges its runs with a loser tree, giving capture histories in
global order.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

CRLF = "\r\n"
#: Bytes of compressed records after which a file is closed, and index entries of a range.
FILE_BYTES, RANGE_ROWS = 64 << 20, 200_000
ENTRY = (
    "url_key string, capture_ts timestamp, page_id long, file string, offset long, length long, "
    "record_type string, refers_to long, payload_bytes long, payload_digest string"
)


def base32_sha1(hex_col):
    """Upper-case base32 of a SHA-1 given in hex: five hex digits make four base32 digits."""
    quads = [
        F.translate(
            F.lpad(F.conv(F.substring(hex_col, 1 + 5 * i, 5), 16, 32), 4, "0"),
            "0123456789ABCDEFGHIJKLMNOPQRSTUV",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
        )
        for i in range(8)
    ]
    return F.concat(*quads)


def url_key(url):
    """Sort key of a URL: host labels reversed, then the rest of the URL.  Null or hostless URLs: the URL itself."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.when(host == "", url).otherwise(key)


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    ts_col: str | None = None,
    min_revisit_bytes: int = 0,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write one WARC record per row of ``pages`` below ``path``, in files of ``file_bytes`` and at most one record more.

    Of the records with equal payloads of at least ``min_revisit_bytes`` bytes the
    smallest id is the response; the others are revisits that refer to it and
    carry the HTTP headers alone.  Null payload: empty.  Null URL: ``urn:page:<id>``.
    A row with a null id has the record id ``urn:page:null``; it counts as larger than any other, and where
    all of a payload's ids are null, all are responses.  A repeated row is
    a record of its own.  Without ``ts_col`` the capture time derives from the id.  An empty table gives no
    record; other columns are left out, whatever their names.  A record of any length is one member.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    clean = F.regexp_replace(F.coalesce(F.col(url_col), F.concat(F.lit("urn:page:"), name)), r"[\x00-\x20\x7f]+", "%20")
    ts = F.col(ts_col) if ts_col else F.timestamp_seconds(F.pmod(F.col(id_col), F.lit(4_000_000_000)))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        clean.alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
        F.date_trunc("second", F.coalesce(ts, F.timestamp_seconds(F.lit(0)))).alias("ts"),  # as a record's date has it
    )
    rows = rows.withColumn("sha", F.sha1(F.encode("payload", "UTF-8")))
    # groups of one need no row here; written out, so the join knows its size and can split a hot digest
    firsts = materialize(
        rows.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("sha", "first_id")
    )
    rows = rows.join(firsts.hint("merge"), "sha", "left")
    size = F.octet_length("payload")
    revisit = (size >= min_revisit_bytes) & F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    digest = base32_sha1(F.col("sha"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), size.cast("string"), F.lit(CRLF * 2)
    )
    body = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    record = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(CRLF + "WARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
        F.lit(">" + CRLF + "WARC-Date: "),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(CRLF + "WARC-Target-URI: "),
        F.col("url"),
        F.lit(CRLF + "WARC-Payload-Digest: sha1:"),
        digest,
        F.when(
            revisit,
            F.concat(
                F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: <urn:page:"),
                F.col("first_id").cast("string"),
                F.lit(">"),
            ),
        ).otherwise(""),
        F.lit(CRLF + "Content-Type: application/http;msgtype=response" + CRLF + "Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(CRLF * 2),
        body,
        F.lit(CRLF * 2),
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, seq, size = 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for row in batch.column("record").slice(at, 256):
                    if size >= file_bytes:
                        archive, size = archive + 1, 0
                    pack = zlib.compressobj(6, wbits=31)
                    member = pack.compress(row.as_buffer()) + pack.flush()
                    out.append((archive, seq, member))
                    seq, size = seq + 1, size + len(member) + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["archive", "seq", "member"])

    ordered = rows.select(url_key(F.col("url")).alias("k"), "ts", "page_id", record.alias("record")).sortWithinPartitions("k", "ts", "page_id")
    packed = ordered.select(F.encode("record", "UTF-8").alias("record")).mapInArrow(members, "archive int, seq long, member binary")
    # in order already: the sort tells the writer so.  The bytes of a string are written as they are
    packed = packed.sortWithinPartitions("archive", "seq").select("archive", F.col("member").cast("string").alias("value"))
    packed.write.option("lineSep", "\0").partitionBy("archive").text(path)


def members_of(blob: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes of the record) of each gzip member of an archive."""
    at, view = 0, memoryview(blob)
    while at < len(blob):
        if not blob[at]:  # padding
            at += 1
            continue
        unpack = zlib.decompressobj(31)
        record, end = [unpack.decompress(view[at : at + (1 << 16)])], min(len(blob), at + (1 << 16))
        while not unpack.eof:
            if end == len(blob):
                raise ValueError(f"the member at {at} is cut off")
            record.append(unpack.decompress(view[end : end + (1 << 16)]))
            end = min(len(blob), end + (1 << 16))
        length = end - len(unpack.unused_data) - at
        yield at, length, b"".join(record)
        at += length


def parse_records(blob: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an uncompressed archive; raises on a malformed one."""
    at = 0
    while at < len(blob):
        end = blob.index(b"\r\n\r\n", at)
        lines = blob[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start, size = end + 4, int(head["Content-Length"])
        if blob[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where its length says")
        yield at, start + size + 4 - at, head, blob[start : start + size]
        at = start + size + 4


def _number(urn: str) -> int | None:
    name = urn[len("<urn:page:") : -1]
    return None if name == "null" else int(name)


def _entry(file: str, at: int, length: int, head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if head["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{file}: the payload at {at} does not match its digest")
    refers = _number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
    return head["WARC-Target-URI"], head["WARC-Date"], _number(head["WARC-Record-ID"]), file, at, length, head["WARC-Type"], refers, size, digest


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives below ``path``; those of one file, by offset, are a sorted run.  A file is read whole, its records one by one."""
    names = "url date page_id file offset length record_type refers_to payload_bytes payload_digest".split()
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for at, length, record in members_of(content.as_py()):
                    rows += [_entry(file, at, length, head, block) for _, _, head, block in parse_records(record)]
                    if len(rows) >= 5000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    schema = ENTRY.replace("url_key string, capture_ts timestamp", "url string, date string")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    found = raw.mapInArrow(parse, schema)
    return found.select(
        url_key(F.col("url")).alias("url_key"), F.to_timestamp("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("capture_ts"), *found.columns[2:]
    )


class LoserTree:
    """Tournament tree over sorted runs: inner nodes keep losers, so each step replays one leaf-to-root path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.loser = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf, first=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _replay(self, leaf: int, first: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            held = self.loser[node]
            if held < 0 and first:
                self.loser[node] = winner
                return
            if self._before(held, winner):
                self.loser[node], winner = winner, held
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        while (head := self.heads[winner := self.loser[0]]) is not None:
            yield winner, head
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Globally ordered capture index from the locally sorted runs.

    Ranges of (URL key, time, id, file, offset) of some ``RANGE_ROWS`` rows are dealt to tasks, so one hot URL spans many
    tasks; inside a range each file's entries keep their run order and a loser
    tree merges them, a row of each run at a time.  Rows come back ordered within and across partitions; a null id comes first.
    """
    key = ["url_key", "capture_ts", "page_id"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # index entries of one range only, as Arrow
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        run = whole.column("file").combine_chunks().dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero(np.diff(run, prepend=-1)).tolist()  # sorted by file, so a file's rows adjoin
        columns = [whole.column(c) for c in (key[0], key[1], key[2])]

        def rows(start: int, end: int) -> Iterator[tuple]:
            for at in range(start, end, 1024):
                url, ts, ids = (c.slice(at, min(1024, end - at)) for c in columns)
                stamps = ts.cast(pa.int64()).to_pylist()
                for i, (u, t, n) in enumerate(zip(url.to_pylist(), stamps, ids.to_pylist(), strict=True)):
                    yield (u is not None, u or ""), (t is not None, t or 0), (n is not None, n or 0), at + i

        take = []
        for _, (*_, at) in LoserTree([rows(a, b) for a, b in zip(cuts, [*cuts[1:], len(run)], strict=True)]):
            take.append(at)
            if len(take) == 10_000:
                yield from whole.take(take).combine_chunks().to_batches()
                take = []
        if take:
            yield from whole.take(take).combine_chunks().to_batches()

    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, *key, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(merge, ENTRY)


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    # materialized: dealing ranges samples its input, which would parse the archives twice
    return merge_runs(materialize(read_runs(spark, path)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    return capture_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = " || ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, {0}, 5))::BIGINT >> {1}) & 31 AS INT), 1)".format(1 + 5 * i, s)
    for i in range(8)
    for s in (15, 10, 5, 0)
)

ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
     f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, octet_length(encode(body)) AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (h)
"""

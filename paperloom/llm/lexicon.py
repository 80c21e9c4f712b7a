"""Operator 6: BPE encoding and decoding over a minimal acyclic transducer lexicon.

Frequent words of the corpus, counted over all of it, are compiled with their
ids into a minimal acyclic automaton (shared prefixes and suffixes).  Each edge
carries the number of words that come before it, so the sum along a path is a
word's index, and the index leads to its ids.  Tasks memory-map the compiled
bytes.  A word outside the lexicon is merged exactly by the tokenizer's own BPE
model.  The lexicon is only a short cut: results don't depend on its content.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces
from .common import materialize, table

#: Words in the lexicon.  Bounds what is compiled on the driver and broadcast (under 3 MB).
LEXICON_WORDS = 32_768


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The automaton of all words with their ids, as one byte string.

    States are minimized while the sorted words are added: once a word leaves a
    branch, each of its states is replaced by an equal one met before.
    """
    words = sorted((w.encode(), ids) for w, ids in entries.items())
    states: list[tuple[bool, list[list[int]]]] = [(False, [])]  # final, edges [byte, target]
    known: dict[tuple, int] = {}

    def settle(path: list[int], depth: int) -> None:
        while len(path) > depth + 1:
            s = path.pop()
            final, edges = states[s]
            same = known.setdefault((final, tuple(map(tuple, edges))), s)
            states[path[-1]][1][-1][1] = same

    path, last = [0], b""
    for word, _ in words:
        shared = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        settle(path, shared)
        for byte in word[shared:]:
            states.append((False, []))
            states[path[-1]][1].append([byte, len(states) - 1])
            path.append(len(states) - 1)
        states[path[-1]] = (True, states[path[-1]][1])
        last = word
    settle(path, 0)

    order, number, stack = [], {}, [0]
    while stack:
        s = stack.pop()
        if s not in number:
            number[s] = len(order)
            order.append(s)
            stack += [t for _, t in states[s][1]]
    below: dict[int, int] = {}
    for root in order:  # words below each state, without recursion
        todo = [root]
        while todo:
            s = todo[-1]
            missing = [t for _, t in states[s][1] if t not in below]
            if missing:
                todo += missing
            else:
                below[s] = states[s][0] + sum(below[t] for _, t in states[s][1])
                todo.pop()
    first, labels, targets, skips = [0], bytearray(), [], []
    for s in order:
        before = int(states[s][0])
        for byte, t in states[s][1]:
            labels.append(byte)
            targets.append(number[t])
            skips.append(before)
            before += below[t]
        first.append(len(labels))
    finals = bytes(states[s][0] for s in order)
    ends = np.cumsum([0, *(len(ids) for _, ids in words)], dtype="<u4")
    flat = np.array([i for _, ids in words for i in ids], "<u4")
    parts = [np.array(x, "<u4").tobytes() for x in (first, targets, skips)] + [ends.tobytes(), flat.tobytes(), bytes(labels), finals]
    return struct.pack("<7I", *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A compiled lexicon in a memory-mapped file of this process."""

    def __init__(self, raw: bytes):
        file = tempfile.TemporaryFile()
        file.write(raw)
        file.flush()
        self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        file.close()
        sizes = struct.unpack_from("<7I", self.map, 0)
        starts = np.cumsum([28, *sizes]).tolist()
        view = memoryview(self.map)
        self.first, self.targets, self.skips, self.ends, self.ids = (view[a : a + n].cast("I") for a, n in zip(starts[:5], sizes[:5], strict=True))
        self.labels, self.finals = starts[5], starts[6]

    def find(self, word: bytes) -> list[int] | None:
        """Ids of ``word``, or None if it isn't in the lexicon."""
        state = index = 0
        for i in range(len(word)):
            base = self.labels
            edge = self.map.find(word[i : i + 1], base + self.first[state], base + self.first[state + 1]) - base
            if edge < 0:
                return None
            index += self.skips[edge]
            state = self.targets[edge]
        if not self.map[self.finals + state]:
            return None
        return self.ids[self.ends[index] : self.ends[index + 1]].tolist()


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def frequent_words(docs: DataFrame, text_col: str = "text", n: int = LEXICON_WORDS) -> DataFrame:
    """At most ``n`` of the most frequent lower-case words of all texts, cut at a count, so that no tie is broken.  Counts cover every row.

    The least count comes from a histogram of counts (exact below 1024, by powers of
    two above), so neither sorting nor partial lists of words reach the driver.
    """
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word")).filter("word <> ''")
    counts = materialize(words.groupBy("word").agg(F.count("*").alias("n")))
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.pow(F.lit(2), F.floor(F.log2("n"))).cast("long"))
    histogram = {r.level: r.words for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()}
    least, taken = 2**62, 0
    for found in sorted(histogram, reverse=True):
        taken += histogram[found]
        if taken > n:
            break
        least = found
    return counts.filter(F.col("n") >= least).select("word")


def build_lexicon(docs: DataFrame, tokenizer_path: str, text_col: str = "text", n: int = LEXICON_WORDS) -> bytes:
    """Compiled lexicon of the frequent words that are one piece of the tokenizer.  At most ``n`` words reach the driver."""
    model, letters = load_tokenizer(tokenizer_path).model, pieces.byte_alphabet()
    entries = {}
    for row in frequent_words(docs, text_col, n).collect():
        if pieces.plain(row.word) and pieces.WORD_END.findall(row.word) == [row.word]:
            spelled = row.word.encode().decode("latin-1").translate(letters)
            entries[row.word] = [t.id for t in model.tokenize(spelled)]
    return compile_lexicon(entries)


class Codec:
    """Encodes and decodes whole texts as the tokenizers library does, without special tokens added."""

    def __init__(self, tokenizer_path: str, lexicon: bytes):
        self.tokenizer = load_tokenizer(tokenizer_path)
        model, letters, words = self.tokenizer.model, pieces.byte_alphabet(), Lexicon(lexicon)
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

        def encode(piece: str) -> bytes:
            raw = piece.encode()
            found = words.find(raw)
            if found is None:
                found = [t.id for t in model.tokenize(raw.decode("latin-1").translate(letters))]
            return np.array(found, "<i4").tobytes()

        self.memo = pieces.Memo(encode)

    def encode(self, text: str) -> np.ndarray:
        if pieces.plain(text):
            return np.frombuffer(b"".join(map(self.memo.__getitem__, pieces.WORD_END.findall(text.lower()))), "<i4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4")

    def decode(self, ids: np.ndarray) -> str:
        # the file names no decoder, so tokens are joined by one space
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def round_trip(docs: DataFrame, tokenizer_path: str, lexicon: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, token_ids array<int> and decoded string of every row; null text: empty.  Null and repeated ids stay rows of their own."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon if lexicon is not None else build_lexicon(docs, tokenizer_path, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer_path, shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = [codec.encode(t.as_py() or "") for t in batch.column(1)]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(map(codec.decode, ids), pa.string())], [id_col, "token_ids", "decoded"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, token_ids array<int>, decoded string")


def digests(done: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text, from ``round_trip``'s rows."""
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("token_ids").cast("array<string>"), " "), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op6_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))

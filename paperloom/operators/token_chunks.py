"""Chunks bounded in tokens of any tokenizer: counts are taken in batches by a hook, sentences and blocks are then packed row by row.

A hook is a function without arguments, called once a task, that gives ``count(texts) -> counts``.  A text's count is taken as the sum of its words' counts,
each with the space before it; that bounds it for tokenizers that start anew at white space, as byte-level and word tokenizers do.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import CHUNK, ChunkParams
from .chunking import chunk_type, markdown_blocks, sentences

Count = Callable[[list[str]], list[int]]


def word_counter() -> Count:
    """White-space words, as the native chunkers count."""
    return lambda texts: [len(t.split()) for t in texts]


def tokenizer_counter(path: str) -> Callable[[], Count]:
    """Tokens of a tokenizer file that every worker finds at ``path``."""

    def make() -> Count:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return make


class _Sizes:
    """Token bounds of texts from a memo of their words: a task counts a word once, until the memo holds ``MEMO`` characters, some 200 MB, and starts anew."""

    MEMO = 5_000_000

    def __init__(self, count: Count):
        self.count, self.alone, self.spaced, self.runs, self.held = count, {}, {}, {}, 0

    def learn(self, texts: list[str]) -> None:
        """Count the words of some texts that the memo lacks, together; only theirs are looked up."""
        if self.held > self.MEMO:
            self.alone, self.spaced, self.held = {}, {}, 0
        new = list({w for t in texts for w in t.split() if w not in self.spaced})
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            n = self.count(some + [" " + w for w in some])
            self.alone.update(zip(some, n[: len(some)], strict=True))
            self.spaced.update(zip(some, n[len(some) :], strict=True))
            self.held += sum(map(len, some))

    def _space(self, run: str) -> int:
        """White space between words; its last character may be a token apart."""
        if run not in self.runs:
            if len(self.runs) > 10_000:
                self.runs = {}
            self.runs[run] = max(self.count([run])[0], sum(self.count([run[:-1], run[-1:]])))
        return self.runs[run]

    def __call__(self, texts: list[str], before: str) -> list[int]:
        """The bound of each text, with or without the separator before it."""
        self.learn(texts)
        first = 0 if before == " " else self._space(before)
        out = []
        for t in texts:
            words = t.split()
            n = first + (max(self.alone[words[0]], self.spaced[words[0]]) if words else 0)
            if " ".join(words) == t:
                n += sum(self.spaced[w] for w in words[1:])
            else:
                runs = [r for r in re.findall(r"\s+", t) if r != " "]
                n += sum(max(self.alone[w], self.spaced[w]) for w in words[1:]) + sum(map(self._space, runs))
            out.append(n)
        return out


def _fit(sizes: _Sizes, text: str, n: int, size: int) -> list[tuple[str, int]]:
    """A sentence as parts of up to ``size`` tokens: whole, else runs of its words, and words beyond it halved; a single character stays."""
    if n <= size:
        return [(text, n)]
    words = text.split()
    if len(words) > 1:
        parts = [p for w, m in zip(words, sizes(words, " "), strict=True) for p in _fit(sizes, w, m, size)]
        return [(" ".join(t for t, _ in run), sum(m for _, m in run)) for run in _runs(parts, size)]
    word = words[0] if words else text
    if len(word) < 2:
        return [(word, n)]
    halves = [word[: len(word) // 2], word[len(word) // 2 :]]
    return [p for h, m in zip(halves, sizes(halves, " "), strict=True) for p in _fit(sizes, h, m, size)]


def _runs(parts: list[tuple[str, int]], size: int, overlap: int = 0) -> list[list[tuple[str, int]]]:
    """Greedy runs of parts within ``size``; each begins with the last parts of the one before of up to ``overlap``, if the next part fits beside them."""
    runs: list[list[tuple[str, int]]] = []
    open_: list[tuple[str, int]] = []
    n = 0
    for part in parts:
        if open_ and n + part[1] > size:
            runs.append(open_)
            kept, held = 0, len(open_)
            while held and kept + open_[held - 1][1] <= overlap:
                held -= 1
                kept += open_[held][1]
            open_, n = (open_[held:], kept) if kept + part[1] <= size else ([], 0)
        open_ = [*open_, part]
        n += part[1]
    return [*runs, open_] if open_ else runs


def _in_groups(batch: pd.Series, texts_of: Callable, sizes: _Sizes, one: Callable) -> pd.Series:
    """``one`` of each row, the words of 64 rows counted together, as a call of the tokenizer costs more than a word."""
    out = []
    for i in range(0, len(batch), 64):
        rows = batch.iloc[i : i + 64]
        sizes.learn([t for row in rows if row is not None for t in texts_of(row)])
        out += map(one, rows)
    return pd.Series(out, index=batch.index, dtype=object)


def token_sentences(docs: DataFrame, make: Callable[[], Count] = word_counter, params: ChunkParams = CHUNK, text_col: str = "text") -> DataFrame:
    """Sentences packed into chunks of up to ``size`` tokens, each beginning with the last sentences of up to ``overlap`` tokens of the one before.

    A sentence of more tokens is cut at words, and a word at characters, so no chunk has more.  Adds chunk_index, total_chunks, chunk_text and
    tokens (the bound that was packed by); empty and null texts have none.
    """

    @F.pandas_udf("array<struct<text:string,tokens:int>>")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = _Sizes(make())

        def one(row) -> list[dict]:
            texts = [] if row is None else [t for t in row if t.strip()]
            parts = [p for t, n in zip(texts, sizes(texts, " "), strict=True) for p in _fit(sizes, t, n, params.size)]
            return [{"text": " ".join(t for t, _ in run), "tokens": sum(n for _, n in run)} for run in _runs(parts, params.size, params.overlap)]

        for batch in batches:
            yield _in_groups(batch, lambda row: row, sizes, one)

    rows = docs.withColumn("_chunks", packed.asNondeterministic()(sentences(F.col(text_col))))  # else a filter of empty lists packs all a second time
    rows = rows.select("*", F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "_c"))
    return rows.withColumn("chunk_text", F.col("_c.text")).withColumn("tokens", F.col("_c.tokens")).drop("_chunks", "_c")


def token_blocks(docs: DataFrame, make: Callable[[], Count] = word_counter, size: int = CHUNK.size, text_col: str = "text") -> DataFrame:
    """Blocks under one heading as chunks of up to ``size`` tokens, the heading's included: what is larger is cut, then neighbours that fit together are merged.

    Adds chunk_index, total_chunks, parent_heading, chunk_type, chunk_text and tokens.  A heading of over half the size isn't put into its chunks' texts; one without blocks has no chunk.
    """

    @F.pandas_udf("array<struct<heading:string,kinds:array<string>,text:string,tokens:int>>")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = _Sizes(make())

        def chunks(heading: str, parts: list[tuple[str, str, int]]) -> Iterator[dict]:
            before = heading + "\n" if heading else ""
            taken = sizes.count([before])[0] if before else 0
            if taken > size // 2:
                before, taken = "", 0
            cut: list[tuple[str, int]] = []
            for kind, text, n in parts:
                whole = n <= size - taken
                texts = [text] if whole else [t for t, _ in _fit(sizes, text, n, size - taken)]
                cut += [(f"{kind}\0{t}", m) for t, m in zip(texts, [n] if whole else sizes(texts, "\n\n"), strict=True)]
            for run in _runs(cut, size - taken):
                kinds, texts = zip(*(t.split("\0", 1) for t, _ in run), strict=True)
                yield {"heading": heading or None, "kinds": list(kinds), "text": before + "\n\n".join(texts), "tokens": taken + min(size - taken, sum(n for _, n in run))}  # a part alone needs no separator

        def one(row) -> list[dict]:
            blocks = [] if row is None else [(b["kind"], b["text"]) for b in row]
            bounds = sizes([t for _, t in blocks], "\n\n")
            out: list[dict] = []
            heading, held = "", []
            for (kind, text), n in zip(blocks, bounds, strict=True):
                if kind == "heading":
                    out += chunks(heading, held)
                    heading, held = text.lstrip("#").strip(), []
                else:
                    held.append((kind, text, n))
            return out + list(chunks(heading, held))

        for batch in batches:
            yield _in_groups(batch, lambda row: [b["text"] for b in row], sizes, one)

    rows = docs.withColumn("_chunks", packed.asNondeterministic()(markdown_blocks(F.col(text_col))))
    rows = rows.select("*", F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "_c"))
    return rows.select("*", F.col("_c.heading").alias("parent_heading"), chunk_type(F.col("_c.kinds")).alias("chunk_type"), F.col("_c.text").alias("chunk_text"), F.col("_c.tokens").alias("tokens")).drop("_chunks", "_c")

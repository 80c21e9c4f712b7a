"""Operator 9: language identification by multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are summed over all labelled rows on Spark; the
log-probability matrix, of fixed size, is broadcast, and whole batches are
scored by gathering its columns in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ORDERS = (2, 3)
#: Features: n-grams are hashed to 2 ** HASH_BITS columns.
HASH_BITS = 16
ALPHA = 0.5
#: Languages whose matrix is broadcast at once (256 KB a language); a model of more scores the texts in several passes.
PASS_LANGUAGES = 256
UNDETERMINED = "und"
#: Characters handled in one numpy pass.
CHUNK = 1 << 20
#: Odd multipliers of the n-gram hash, by position.
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: whether it is a letter.  Made once in a process."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``CHUNK`` characters."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < CHUNK):
            size += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


def features(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased texts, an array for each order, each text's start in them, and its number of letters.

    Whatever isn't a letter counts as a space; two spaces come before a text, so its n-grams hold its own letters alone.
    """
    low = [(t or "").lower() for t in texts]
    starts = np.cumsum([0, *(len(t) + 2 for t in low)])
    points = np.frombuffer(("  " + "  ".join(low) + "    ").encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = letters()[points]
    chars = np.where(alpha, points, np.uint32(0x20))
    n = starts[-1]
    orders = []
    for k in ORDERS:
        h = np.zeros(n, np.uint32)
        for i in range(k):
            h += chars[i : n + i] * _MULTIPLIERS[i]
        orders.append(((h * np.uint32(0x9E3779B1) + np.uint32(k)) >> np.uint32(32 - HASH_BITS)).astype(np.int32))
    return orders, starts[:-1], np.add.reduceat(alpha[:n].astype(np.int64), starts[:-1])


def train_counts(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, feature, n) over all rows with a language; feature -1 counts the rows themselves.  Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, to in chunks(texts):
                for lang in sorted(set(langs[at:to])):
                    own = [t for t, x in zip(texts[at:to], langs[at:to], strict=True) if x == lang]
                    into = counts.setdefault(lang, np.zeros((1 << HASH_BITS) + 1, np.int64))
                    into[-1] += len(own)
                    for f in features(own)[0]:
                        into[:-1] += np.bincount(f, minlength=1 << HASH_BITS)
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            feature = np.where(at == 1 << HASH_BITS, -1, at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(feature, pa.int32()), pa.array(found[at])], ["lang", "feature", "n"]
            )

    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", alpha: float = ALPHA) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Sorted languages, log priors, and the matrix of log probabilities (language, feature)."""
    counts = train_counts(labelled, text_col, lang_col)
    # at most one row a language, of at most 2 ** HASH_BITS + 1 pairs
    rows = counts.groupBy("lang").agg(F.collect_list(F.struct("feature", "n")).alias("pairs")).toArrow()
    names = rows.column("lang").to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    matrix, rows_of = np.zeros((len(names), (1 << HASH_BITS) + 1)), np.zeros(len(names))
    for k, i in enumerate(order):
        pairs = rows.column("pairs")[i].values
        at, n = pairs.field("feature").to_numpy(), pairs.field("n").to_numpy()
        matrix[k, at] = n  # feature -1 is the last column
    rows_of, matrix = matrix[:, -1].copy(), matrix[:, :-1] + alpha
    log = np.log(matrix / matrix.sum(axis=1, keepdims=True)) if len(names) else matrix
    prior = np.log(rows_of / rows_of.sum()) if len(names) else rows_of
    return [names[i] for i in order], prior, log.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (posterior of that language, 0 to 1) from the whole text.

    ``und`` with score 0 for a null text, one without a letter, or a model without languages.  Ties go to the first language by name.
    Columns of these two names are replaced, others stay; an empty table gives no row.
    """
    names, prior, log = model
    out = docs.drop("lang_pred", "score")
    for at in range(0, max(1, len(names)), PASS_LANGUAGES):
        own = slice(at, at + PASS_LANGUAGES)
        out = _scored(out, (names[own], prior[own], log[own]), text_col)
    return out.drop("_top").withColumn("score", F.when(F.col("lang_pred") == UNDETERMINED, 0.0).otherwise(1 / F.col("score")))


def _scored(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str) -> DataFrame:
    """``docs`` with the best language so far, its log score ``_top``, and the sum of all languages' scores as a multiple of its own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "_top", "score")]
    place, again = kept.index(text_col), "_top" in docs.columns
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("_top", "double").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, log = shared.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            pred, tops, sums = [], [], []
            for at, to in chunks(texts):
                orders, starts, n_letters = features(texts[at:to])
                total = np.repeat(prior[:, None], to - at, axis=1)
                for f in orders:
                    for k in range(len(names)):
                        total[k] += np.add.reduceat(log[k][f], starts, dtype=np.float64)
                known = n_letters > 0 if names else np.zeros(to - at, bool)
                best = total.argmax(axis=0) if names else np.zeros(to - at, np.int64)
                top = total.max(axis=0, initial=-np.inf)
                sums.append(np.exp(total - top).sum(axis=0))
                tops.append(top)
                pred += [names[b] if n else UNDETERMINED for b, n in zip(best.tolist(), known.tolist(), strict=True)]
            top, total = (np.concatenate([np.zeros(0), *x]) for x in (tops, sums))
            if again:
                old, old_top, old_total = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_numpy(), batch.column(len(kept) + 2).to_numpy()
                better = top > old_top
                high = np.maximum(top, old_top)
                total = total * np.exp(top - high) + old_total * np.exp(old_top - high)
                pred = [new if b else x for new, b, x in zip(pred, better.tolist(), old, strict=True)]
                top = high
            arrays = [*batch.columns[: len(kept)], pa.array(pred, pa.string()), pa.array(top, pa.float64()), pa.array(total, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "lang_pred", "_top", "score"])

    chosen = [*kept, "lang_pred", "_top", "score"] if again else kept
    return docs.select(*chosen).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: CRC-32 of its id as text, modulo 4, is 2.  A null id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()).select("text", "lang"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

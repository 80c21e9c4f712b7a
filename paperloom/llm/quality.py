"""Operator 11: quality scores by random Fourier features of document statistics.

Statistics of every whole text are taken in numpy and written once.  Scaled by their mean and
deviation over all documents, they go through random cosines that approximate a Gaussian kernel; tasks
sum their rows into normal equations, which are added up and solved for ridge weights.  Isotonic regression
on labelled rows that the ridge did not see turns the sums into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import materialize, table
from .langid import chunks
from .passages import slice_hashes

#: Cosines, the kernel's width in deviations, ridge penalty a row, and the seed of the cosines.
FEATURES, WIDTH, PENALTY, SEED = 256, 4.0, 1e-4, 11
#: Scaled statistics are held within this many deviations.
REACH = 6.0
#: Of the labelled rows a fold of this many calibrates, the others fit the ridge.
FOLDS = 5
#: Isotonic regression takes ridge sums in steps of 1 / STEPS, from -1 to 2, so the driver holds at most 3 * STEPS + 1 pairs.
STEPS = 1024
#: Tasks that add up the equations of all others, each holding one matrix.
ADDERS = 16
NAMES = (
    "log_chars", "log_words", "log_lines", "lower", "upper", "digit", "space", "line_end", "stop", "comma", "symbol", "pipe", "high", "word_length", "word_spread",
    "upper_words", "capital_words", "symbol_words", "tailed_words", "bare_words", "repeated_words", "distinct_words", "top_word", "distinct_pairs", "line_length", "distinct_lines", "stopped_lines", "short_lines",
)


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for at, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\f\v", "\n", ".!?", ",;:'\"-()", "#$%&*+/<=>@[\\]^_`{}~", "|"), 1):
        kind[np.frombuffer(chars.encode(), np.uint8)] = at
    kind[128:] = 10
    return kind


_CLASS = _classes()
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, COMMA, SYMBOL, PIPE, HIGH = range(1, 11)


def _spans(solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of true places."""
    change = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, rows of the most frequent one) of each of ``n`` documents; values are told apart by the hash bits that the document's number leaves."""
    if not len(doc):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    bits = np.uint64(64 - max(1, n.bit_length()))
    key = np.sort((doc.astype(np.uint64) << bits) | (h >> (np.uint64(64) - bits)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    d = (key[new] >> bits).astype(np.int64)
    first = np.flatnonzero(np.diff(d, prepend=-1))
    most = np.zeros(n, np.int64)
    most[d[first]] = np.maximum.reduceat(np.diff(np.append(new, len(key))), first)
    return np.bincount(d, minlength=n), most


def statistics(raws: list[bytes]) -> np.ndarray:
    """``NAMES`` of each text: logarithms of sizes, shares of bytes by kind, of words and of lines.  An empty text has zeros alone."""
    n = len(raws)
    # a line end after each text keeps words and lines apart and isn't counted
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    sizes = np.array([len(r) for r in raws], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    kind = _CLASS[data]
    shares = np.stack([np.add.reduceat((kind == k).astype(np.int64), starts) for k in range(1, 11)])
    shares[LINE - 1] -= 1
    whole = np.maximum(sizes, 1)
    doc_of = lambda at: np.searchsorted(starts, at, side="right") - 1
    count = lambda doc, weights=None: np.bincount(doc, weights, minlength=n)
    running = lambda flag: np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])

    solid = (kind != SPACE) & (kind != LINE)
    a, b = _spans(solid)
    doc, length = doc_of(a), b - a
    words = count(doc)
    many = np.maximum(words, 1)

    def within(flag: np.ndarray) -> np.ndarray:
        total = running(flag)
        return total[b] - total[a]

    upper, odd = within(kind == UPPER), within((kind == SYMBOL) | (kind == PIPE) | (kind == STOP))
    letters = within((kind == LOWER) | (kind == UPPER) | (kind == HIGH))
    h = slice_hashes(data, a, length) if len(a) else np.zeros(0, np.uint64)
    inner = doc[1:] == doc[:-1]
    same = inner & (h[1:] == h[:-1])
    distinct, top = _distinct(doc, h, n)
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[inner]
    pairs = count(doc[1:][inner])
    mean = count(doc, length) / many
    by_word = [
        mean,
        np.sqrt(np.maximum(count(doc, length.astype(float) ** 2) / many - mean**2, 0)),
        count(doc, (upper >= 2) & (upper >= 0.8 * letters)) / many,
        count(doc, kind[a] == UPPER) / many,
        count(doc, odd >= 2) / many,
        count(doc, (kind[b - 1] == SYMBOL) | (kind[b - 1] == PIPE)) / many,
        count(doc, letters == 0) / many,
        count(doc[1:], same) / np.maximum(words - 1, 1),
        distinct / many,
        top / many,
        _distinct(doc[1:][inner], pair, n)[0] / np.maximum(pairs, 1),
    ]

    la, lb = _spans(kind != LINE)
    ldoc, llength = doc_of(la), lb - la
    lines = count(ldoc)
    some = np.maximum(lines, 1)
    lh = slice_hashes(data, la, llength) if len(la) else np.zeros(0, np.uint64)
    by_line = [np.log1p(count(ldoc, llength) / some), _distinct(ldoc, lh, n)[0] / some, count(ldoc, kind[lb - 1] == STOP) / some, count(ldoc, llength < 30) / some]
    return np.stack([np.log1p(sizes), np.log1p(words), np.log1p(lines), *(shares / whole), *by_word, *by_line], axis=1).astype(np.float32)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``stats`` in place of the text: a null text counts as empty, a text of any length is read whole.  A column ``stats`` is replaced, others stay."""
    kept = [c for c in docs.columns if c not in (text_col, "stats")]
    schema = docs.select(*kept).schema.add("stats", ArrayType(FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(len(kept)).cast(pa.binary()).fill_null(b"").to_pylist()
            rows = [statistics(raws[at:to]) for at, to in chunks(raws)]
            values = np.concatenate([np.zeros((0, len(NAMES)), np.float32), *rows])
            ends = pa.array(np.arange(len(values) + 1) * len(NAMES), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], [*kept, "stats"])

    return docs.select(*kept, text_col).mapInArrow(run, schema)


@dataclass
class Model:
    """Scaling, cosines, ridge weights, and the calibration as sorted (sum, probability) points."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    sums: np.ndarray
    chances: np.ndarray

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features, and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -REACH, REACH)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.waves + self.phases)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.sums, self.chances)


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(-1, len(NAMES)).astype(np.float64)


def normal_equations(rows: DataFrame, model: Model) -> np.ndarray:
    """Sum over ``rows`` (stats, y) of the outer products of (cosines, 1, y): one matrix a task, added up by ``ADDERS`` tasks, then by the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    size = len(model.phases) + 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            z = np.column_stack([shared.value.cosines(_values(batch)), batch.column("y").to_numpy()])
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for m in batch.column(0):
                total += np.frombuffer(m.as_py()).reshape(size, size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = rows.select("stats", "y").mapInArrow(sums, "m binary").repartition(ADDERS).mapInArrow(added, "m binary").toArrow()
    return sum((np.frombuffer(m.as_py()).reshape(size, size) for m in parts.column("m")), np.zeros((size, size)))


def isotonic(sums: np.ndarray, good: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising (sum, chance) points from sorted bins: neighbours that fall are pooled until none does."""
    pools: list[list[float]] = []  # weighted sum, good, rows
    for x, y, w in zip(sums.tolist(), good.tolist(), rows.tolist(), strict=True):
        pools.append([x * w, y, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(stats: DataFrame, labelled: DataFrame, calibrating: Column | None = None) -> Model:
    """A model of ``labelled`` rows (stats, y from 0 to 1), scaled by all of ``stats``; rows where ``calibrating`` holds fit the calibration, the others the ridge.

    Without ``calibrating``, or if it leaves either side without a row, both are fitted on all labelled rows.  Without any, every score is 0.5.
    """
    places = range(len(NAMES))
    moments = stats.agg(*(f(F.col("stats")[i]).alias(f"{f.__name__}{i}") for f in (F.avg, F.stddev_pop) for i in places)).first()
    get = lambda f: np.array([moments[f"{f.__name__}{i}"] or 0.0 for i in places])
    rng = np.random.default_rng(SEED)
    scale = get(F.stddev_pop)
    waves, phases = rng.standard_normal((len(NAMES), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    model = Model(get(F.avg), np.where(scale > 1e-9, scale, 1.0), waves, phases, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    marked = labelled.withColumn("_c", calibrating if calibrating is not None else F.lit(None).cast("boolean"))
    sides = {r[0] for r in marked.select("_c").distinct().collect()}  # two values at most
    split = sides == {True, False}
    total = normal_equations(marked.filter("NOT _c") if split else marked, model)
    rows = total[FEATURES, FEATURES]
    if not rows:
        return model
    equations, right = total[:-1, :-1], total[:-1, -1]
    model.weights = np.linalg.solve(equations + PENALTY * rows * np.diag([*[1.0] * FEATURES, 0.0]), right)
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = np.rint(np.clip(shared.value.raw(_values(batch)), -1, 2) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column("y")], ["step", "y"])

    binned = (marked.filter("_c") if split else marked).select("stats", "y").mapInArrow(bins, "step long, y double")
    found = binned.groupBy("step").agg(F.sum("y").alias("good"), F.count("*").alias("n")).orderBy("step").toArrow()
    model.sums, model.chances = isotonic(found["step"].to_numpy() / STEPS, found["good"].to_numpy(), found["n"].to_numpy())
    return model


def predict(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with score (0 to 1) and predicted in place of the statistics.  Columns of these two names are replaced, others stay."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in stats.columns if c not in ("stats", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.score(_values(batch)))], [*kept, "score"])

    scored = stats.select(*kept, "stats").mapInArrow(run, stats.select(*kept).schema.add("score", "double"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: CRC-32 of its id as text, modulo 3, is 1.  A null id isn't."""
    return F.coalesce(_crc(id_col) % 3 == 1, F.lit(False))


def _crc(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, held_out, score, predicted of every row of ``docs``, learnt from the labelled rows that aren't held out.

    A document labelled several times has the mean label; a null label is none; repeated rows have equal scores and each count as a row.
    Rows without an id are scored and not learnt from; a null text is an empty one; an empty table gives no row.
    """
    stats = materialize(with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    by_id = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(label_col).alias("y"))
    known = materialize(stats.filter(~held_out()).join(by_id.hint("merge"), "doc_id"))
    model = fit(stats, known, F.floor(_crc("doc_id") / 3) % FOLDS == 0)
    return predict(stats, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

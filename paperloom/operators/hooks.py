"""Places for outside models: a scorer of relevance and an extractor of entities, each with a native default.

A hook is a function without arguments, called once a task, that gives the model: a function from a batch of inputs to as many outputs.  Batches are cut to
``batch`` rows, whatever Spark's are, since models have limits of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as T

Scorer = Callable[[], Callable[[list[str], list[str]], list[float]]]
#: From queries to (entity, confidence, alternatives) each.
Extractor = Callable[[], Callable[[list[str]], list[tuple[str, float, list[str]]]]]
ENTITY = "struct<entity:string,confidence:double,method:string,alternatives:array<string>>"


def relevance(query: Column, text: Column, scorer: Scorer | None = None, batch: int = 256) -> Column:
    """0 to 10: the scorer's number, kept within that range, or by default the share of the query's distinct words that the text holds.

    A null text or query counts as empty, an empty query has 0; a scorer's number that isn't finite becomes 5, as a reply without a number does.
    """
    query, text = F.coalesce(query, F.lit("")), F.coalesce(text, F.lit(""))
    if scorer is None:
        words, low = F.array_distinct(T.words(F.lower(query))), F.lower(text)
        held = F.size(F.filter(words, lambda w: low.contains(w)))
        return F.when(F.size(words) > 0, held * F.lit(10.0) / F.size(words)).otherwise(0.0)

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = scorer()
        for queries, texts in batches:
            out: list[float] = []
            for i in range(0, len(queries), batch):
                out += model(queries[i : i + batch].tolist(), texts[i : i + batch].tolist())
            yield pd.Series(out, dtype="float64")

    raw = scored(query, text)
    bad = raw.isNull() | F.isnan(raw) | (F.abs(raw) == float("inf"))
    return F.when(bad, 5.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(10.0), raw)))


def extracted(query: Column, method: str, extractor: Extractor, batch: int = 256) -> Column:
    """Struct (entity, confidence, method, alternatives) of an outside extractor; a null query counts as empty."""

    @F.pandas_udf(ENTITY)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = extractor()
        for queries in batches:
            out: list[tuple[str, float, list[str]]] = []
            for i in range(0, len(queries), batch):
                out += model(queries[i : i + batch].tolist())
            frame = pd.DataFrame(out, columns=["entity", "confidence", "alternatives"])
            frame.insert(2, "method", method)
            yield frame

    return found(F.coalesce(query, F.lit("")))


def rules(query: Column) -> Column:
    """Struct of the same fields by the native rules; give it a column of its own, for it is long and read several times."""
    return F.from_json(F.to_json(Q.entity(F.trim(F.coalesce(query, F.lit(""))))), ENTITY)


def extraction(query: Column, *found: Column) -> Column:
    """Of extractors' structs, in their order, the first that is sure, else the surest; an empty query has no entity."""
    none = F.from_json(F.lit('{"entity":"","confidence":0.0,"method":"empty_query","alternatives":[]}'), ENTITY)
    return F.when(F.trim(F.coalesce(query, F.lit(""))) == "", none).otherwise(Q.best_entity(F.array(*found)))


def name_extractor() -> Callable[[list[str]], list[tuple[str, float, list[str]]]]:
    """Runs of capitalised words after the first word of a query, the longest first: a stand-in for a model, without one."""
    import re

    run = re.compile(r"(?<=\s)[A-Z][a-z]+(?:\s[A-Z][a-z]+)*")

    def one(query: str) -> tuple[str, float, list[str]]:
        names = sorted(dict.fromkeys(run.findall(query)), key=lambda n: (-len(n), n))
        return (names[0], 0.9 if " " in names[0] else 0.6, names[1:3]) if names else ("", 0.0, [])

    return lambda queries: [one(q) for q in queries]


def word_scorer() -> Callable[[list[str], list[str]], list[float]]:
    """The default score as a hook."""

    def one(query: str, text: str) -> float:
        words, low = set(query.lower().split()), text.lower()
        return sum(w in low for w in words) * 10.0 / len(words) if words else 0.0

    return lambda queries, texts: [one(q, t) for q, t in zip(queries, texts, strict=True)]

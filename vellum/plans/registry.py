"""Registries of pluggable parts: layouts, recognisers, correctors, translators, embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(order=True)
class Layout:
    """How pages of one layout are recognised and read."""

    priority: int
    name: str
    detect: Callable[[], Column] = field(compare=False)
    extract: Callable[[DataFrame], DataFrame] = field(compare=False)


class Registry(dict):
    def register(self, name: str, part):
        self[name] = part
        return part


LAYOUTS, RECOGNISERS, CORRECTORS, TRANSLATORS, EMBEDDERS = Registry(), Registry(), Registry(), Registry(), Registry()


def route(pages: DataFrame, layouts: dict[str, Layout] | None = None) -> DataFrame:
    """Pages with the layout that reads them: the first by (priority, name) whose test holds; null where none does."""
    out = None
    for x in sorted((LAYOUTS if layouts is None else layouts).values()):
        out = F.when(x.detect(), x.name) if out is None else out.when(x.detect(), x.name)
    return pages.withColumn("layout", out if out is not None else F.lit(None).cast("string"))


def batched(function: Callable[[list[str]], list[str]]) -> Callable[[Column], Column]:
    """A column function from one over lists of texts; it is made once in a worker, and texts come in Arrow batches."""

    @F.pandas_udf("string")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for c in columns:
            yield pd.Series(function(c.tolist()))

    return run


def correct(records: DataFrame, name: str) -> DataFrame:
    """Han texts through a corrector; han_raw keeps the text before; empty and equal results change nothing."""
    made = CORRECTORS[name](F.col("han"))
    x = records.withColumn("_new", F.when(F.trim("han") != "", made))
    ok = (F.coalesce("_new", F.lit("")) != "") & (F.col("_new") != F.col("han"))
    return x.withColumn("han_raw", F.when(ok, F.col("han")).otherwise(F.col("han_raw"))).withColumn("han", F.when(ok, F.col("_new")).otherwise(F.col("han"))).drop("_new")


def translate(records: DataFrame, name: str) -> DataFrame:
    """Meanings for rows that have a Han text and none; their origin is the translator's name."""
    todo = (F.trim(F.coalesce("han", F.lit(""))) != "") & (F.trim(F.coalesce("meaning", F.lit(""))) == "")
    made = F.when(todo, TRANSLATORS[name](F.when(todo, F.col("han"))))
    x = records.withColumn("_new", made)
    ok = F.coalesce("_new", F.lit("")) != ""
    return x.withColumn("source_of", F.when(ok, F.col("source_of").withField("meaning", F.lit(name))).otherwise(F.col("source_of"))).withColumn("meaning", F.when(ok, F.col("_new")).otherwise(F.col("meaning"))).drop("_new")


def retried(function: Callable, transient: tuple[str, ...] = ("429", "503", "timeout", "temporarily", "quota"), tries: int = 4, wait: float = 2.0, sleep: Callable[[float], None] | None = None) -> Callable:
    """``function`` with further tries after errors whose text has a transient mark, after wait, 2 wait, 4 wait … seconds; other errors and the
    last one are raised."""
    import time

    def run(*args):
        for k in range(tries):
            try:
                return function(*args)
            except Exception as e:  # noqa: BLE001 - raised again below
                if k == tries - 1 or not any(t in str(e).lower() for t in transient):
                    raise
                (sleep or time.sleep)(wait * 2**k)

    return run


def guarded(result: Column, error: Column) -> tuple[Column, Column]:
    """(text, error) of an answer: with an error there is no text, without one a null text is empty."""
    failed = F.coalesce(F.trim(error), F.lit("")) != ""
    return F.when(failed, "").otherwise(F.coalesce(result, F.lit(""))), F.when(failed, error)


def hash_embedding(text: Column, size: int = 384) -> Column:
    """A vector of hashed words of length 1 (0 without words): an embedder that needs no model, for tests and as a fallback."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("float"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.transform(counts, lambda v: F.when(norm > 0, v / norm).otherwise(F.lit(0.0)).cast("float"))


EMBEDDERS.register("hash", hash_embedding)
RECOGNISERS.register("blocks", lambda blocks: F.coalesce(blocks, F.array().cast("array<struct<text:string,confidence:double,box:array<array<double>>>>")))
CORRECTORS.register("skip", lambda c: c)
TRANSLATORS.register("skip", lambda c: F.lit(None).cast("string"))

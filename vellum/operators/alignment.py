"""Character and syllable alignment checked against two dictionaries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = "∅"


def similar_lists(similar: DataFrame) -> DataFrame:
    """(sn, similars): look-alike characters of each, by rank."""
    ordered = F.array_sort(F.collect_set(F.struct("rank_no", "similar_char")))
    return similar.where("sn is not null").groupBy("sn").agg(F.transform(ordered, lambda x: x["similar_char"]).alias("similars"))


def readings(translit: DataFrame) -> DataFrame:
    """(key, chars): the characters each syllable can stand for; keys in lower case without outer blanks."""
    return translit.where("qn is not null").groupBy(F.lower(F.trim("qn")).alias("key")).agg(F.array_sort(F.collect_set("sn")).alias("chars"))


def verdicts(pairs: DataFrame, similar: DataFrame, translit: DataFrame) -> DataFrame:
    """``pairs`` (sn, qn, ...) with verdict and correction.

    BLACK: the character is one of the syllable's. GREEN: else one that looks like it is, the first by rank is the correction.
    RED: else, and always where a side is empty. A character without look-alikes looks like itself only. The dictionaries are
    aggregated to a row for each key, so joins multiply nothing; AQE broadcasts them if they are small.
    """
    x = pairs.join(similar_lists(similar), "sn", "left").withColumn("key", F.lower(F.trim("qn"))).join(readings(translit), "key", "left")
    s1, s2 = F.coalesce("similars", F.array("sn")), F.coalesce("chars", F.array().cast("array<string>"))
    gap = F.coalesce(F.col("sn"), F.lit("")).isin("", GAP) | F.coalesce(F.col("qn"), F.lit("")).isin("", GAP)
    both = F.array_intersect(s1, s2)
    black, green = F.array_contains(s2, F.col("sn")), F.size(both) > 0
    verdict = F.when(gap, "RED").when(black, "BLACK").when(green, "GREEN").otherwise("RED")
    correction = F.when(~gap & ~F.coalesce(black, F.lit(False)) & green, both[0])
    return x.withColumn("verdict", verdict).withColumn("correction", correction).drop("key", "similars", "chars")


def edit_script(a: list[str], b: list[str]) -> tuple[list[tuple[str, str]], int]:
    """The pairs of a least-cost alignment of two token lists, and its cost. From the end back a diagonal step is taken where it
    explains the cell, else a deletion, else an insertion; gaps are empty texts. Where no token is in both lists each cell of the table is the
    larger of its places, so every step back is diagonal and what is left of the longer list comes first."""
    m, n = len(a), len(b)
    if set(a).isdisjoint(b):
        size = max(m, n)
        return list(zip([""] * (size - m) + a, [""] * (size - n) + b)), size
    d = [list(range(n + 1))] + [[i] + [0] * n for i in range(1, m + 1)]
    for i, x in enumerate(a, 1):
        up, now = d[i - 1], d[i]
        for j, y in enumerate(b, 1):
            now[j] = min(up[j - 1] + (x != y), up[j] + 1, now[j - 1] + 1)
    out, i, j = [], m, n
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and (not j or d[i][j] == d[i - 1][j] + 1):
            i -= 1
            out.append((a[i], ""))
        else:
            j -= 1
            out.append(("", b[j]))
    return out[::-1], d[m][n]


def aligned(df: DataFrame, a: str, b: str, id_: str) -> DataFrame:
    """(id_, pos, sn, qn, distance, score) for each pair of the edit script of two arrays; null arrays and elements are empty. Arrow
    batches in one narrow pass; gaps are ∅."""
    schema = f"id {df.schema[id_].dataType.simpleString()}, pos int, sn string, qn string, distance int, score double"

    def run(batches):
        for batch in batches:
            rows = []
            for key, x, y in zip(*(batch.column(k).to_pylist() for k in range(3))):
                x, y = [t or "" for t in x or []], [t or "" for t in y or []]
                pairs, cost = edit_script(x, y)
                score = 1 - cost / max(len(x), len(y), 1)
                rows += [(key, p, s or GAP, q or GAP, cost, score) for p, (s, q) in enumerate(pairs)]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64())
            cols = list(map(list, zip(*rows))) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["id", "pos", "sn", "qn", "distance", "score"])

    return df.select(id_, a, b).mapInArrow(run, schema).withColumnRenamed("id", id_)


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two token lists: each distinct token becomes one character, then the built-in function compares. The
    characters are those from U+10000 on, so a row may have a million distinct tokens."""
    vocabulary = F.array_distinct(F.concat(a, b))

    def coded(c: Column, v: Column) -> Column:
        return F.array_join(F.transform(c, lambda t: F.decode(F.unhex(F.lpad(F.hex(F.lit(65535) + F.array_position(v, t)), 8, "0")), "UTF-32")), "")

    return F.element_at(F.transform(F.array(vocabulary), lambda v: F.levenshtein(coded(a, v), coded(b, v))), 1)


def accuracy(verdicts_: Column) -> Column:
    """Share of BLACK and GREEN; 0 for none."""
    return F.when(F.size(verdicts_) == 0, 0.0).otherwise(F.size(F.filter(verdicts_, lambda v: v.isin("BLACK", "GREEN"))) / F.size(verdicts_))


def transliterated(chars: Column, forward: Column) -> Column:
    """Each character's reading by a map, itself where there is none."""
    return F.transform(chars, lambda c: F.coalesce(F.try_element_at(forward, c), c))


def corrected(han: Column, valid: Column, similar: Column, repair: bool = False) -> Column:
    """Text in which invalid characters become their first valid look-alike. Without ``repair`` it is the text itself, as every
    character that has look-alikes counts as valid."""
    if not repair:
        return han
    one = lambda c: F.when(F.array_contains(valid, c), c).otherwise(F.coalesce(F.try_element_at(F.array_intersect(F.coalesce(F.try_element_at(similar, c), F.array().cast("array<string>")), valid), F.lit(1)), c))
    return F.array_join(F.transform(F.split(han, ""), one), "")

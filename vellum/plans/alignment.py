"""Queries of character alignment and their SQL."""

from pyspark.sql import functions as F

from vellum.operators import alignment as A
from vellum.operators.corpus import status_histogram, versions
from vellum.tables import load

c = F.col


def rows(s, d):
    return versions(load(s, d, "aligned_sentences"))


def pairs(s, d):
    """Characters and words at the same place of a column."""
    x = rows(s, d).select("row_id", F.posexplode(F.arrays_zip("sn_chars", "qn_words")).alias("pos", "z"))
    return x.select("row_id", "pos", c("z.sn_chars").alias("sn"), c("z.qn_words").alias("qn"))


def validated(s, d):
    return A.verdicts(pairs(s, d), load(s, d, "similar_chars"), load(s, d, "translit"))


def sequence(s, d):
    """Readings aligned to words by edit script, then judged; a column without words has gaps only."""
    return A.aligned(rows(s, d), "sn_chars", "qn_words", "row_id")


def words(s, d):
    a, b = F.split(F.lower("reading"), " "), F.split(F.lower("meaning"), " ")
    return load(s, d, "glossary").where("reading is not null and meaning is not null").select("han", "reading", a.alias("a"), b.alias("b"), "meaning").distinct()


def column_box(s, d):
    return rows(s, d).groupBy("chapter", "page").agg(F.count("*").alias("n"), F.min("bbox_xmin").alias("x0"), F.min("bbox_ymin").alias("y0"), F.max("bbox_xmax").alias("x1"), F.max("bbox_ymax").alias("y1"))


QUERIES = {
    "pair_validation": lambda s, d: validated(s, d).select("row_id", "pos", "sn", "qn", "verdict", "correction"),
    "verdict_histogram": lambda s, d: status_histogram(validated(s, d), "verdict", ["BLACK", "GREEN", "RED"]),
    "sentence_accuracy": lambda s, d: validated(s, d).groupBy("row_id").agg(F.round(F.avg(c("verdict").isin("BLACK", "GREEN").cast("int")), 6).alias("share")).withColumn("label", F.when(c("share") >= 0.8, "Good").when(c("share") >= 0.5, "Partial").otherwise("Poor")),
    "accuracy_summary": lambda s, d: rows(s, d).agg(F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.median("accuracy"), 6).alias("median"), F.count("*").alias("n")),
    "similar_lists": lambda s, d: A.similar_lists(load(s, d, "similar_chars")),
    "syllable_readings": lambda s, d: A.readings(load(s, d, "translit")),
    "token_edit_distance": lambda s, d: words(s, d).select("han", "reading", "meaning", A.token_distance(c("a"), c("b")).alias("distance")),
    "sequence_alignment": lambda s, d: sequence(s, d).select("row_id", "pos", "sn", "qn", "distance", F.round("score", 6).alias("score")),
    "sequence_verdicts": lambda s, d: A.verdicts(sequence(s, d), load(s, d, "similar_chars"), load(s, d, "translit")).groupBy("verdict").agg(F.count("*").alias("n")),
    "column_bounds": column_box,
    "corpus_nested": lambda s, d: rows(s, d).groupBy("chapter", "page").agg(F.sort_array(F.collect_list("sentence_id")).alias("ids")),
}

R = "(select distinct on (row_id) * from aligned_sentences)"
P = f"(select row_id, i pos, sn_chars[i + 1] sn, qn_words[i + 1] qn from (select *, unnest(range(greatest(len(sn_chars), len(qn_words)))) i from {R} where qn_words is not null))"
S1 = "(select sn, list(similar_char order by rank_no, similar_char) s from (select distinct * from similar_chars) group by sn)"
S2 = "(select lower(trim(qn)) k, list_sort(list(distinct sn)) c from translit group by k)"
V = f"""(select row_id, pos, p.sn, p.qn, coalesce(p.sn, '') in ('', '∅') or coalesce(p.qn, '') in ('', '∅') gap, coalesce(list_contains(c, p.sn), false) black,
  [x for x in coalesce(s, [p.sn]) if list_contains(coalesce(c, []), x)] g from {P} p left join {S1} a on p.sn = a.sn left join {S2} b on lower(trim(p.qn)) = b.k)"""
W = f"(select row_id, pos, sn, qn, case when gap then 'RED' when black then 'BLACK' when len(g) > 0 then 'GREEN' else 'RED' end verdict, case when not gap and not black and len(g) > 0 then g[1] end correction from {V})"

# A reading is never a Han character, so no tokens are equal: the script is diagonal from the end and what is left of the longer side comes first.
N = f"(select row_id, coalesce([coalesce(x, '') for x in sn_chars], []) a, coalesce([coalesce(x, '') for x in qn_words], []) b from {R})"
SEQ = f"""(select row_id, i pos, coalesce(nullif(case when i >= n - len(a) then a[i - (n - len(a)) + 1] end, ''), '∅') sn, coalesce(nullif(case when i >= n - len(b) then b[i - (n - len(b)) + 1] end, ''), '∅') qn, n distance, round(1 - n / greatest(n, 1), 6) score
  from (select row_id, a, b, greatest(len(a), len(b))::int n, unnest(range(greatest(len(a), len(b))))::int i from {N}))"""
SEQ_V = V.replace(P, SEQ)

SQL = {
    "sequence_alignment": f"select * from {SEQ}",
    "sequence_verdicts": f"select verdict, count(*) n from (select case when gap then 'RED' when black then 'BLACK' when len(g) > 0 then 'GREEN' else 'RED' end verdict from {SEQ_V}) group by verdict",
    "token_edit_distance": """with w as (select distinct han, reading, meaning, string_split(lower(reading), ' ') a, string_split(lower(meaning), ' ') b from glossary where reading is not null and meaning is not null),
  k as (select *, list_distinct(list_concat(a, b)) v from w)
  select han, reading, meaning, levenshtein(array_to_string([chr((32 + list_position(v, x))::int) for x in a], ''), array_to_string([chr((32 + list_position(v, x))::int) for x in b], ''))::int distance from k""",
    "pair_validation": f"select * from {W}",
    "verdict_histogram": f"select s status, count(verdict) n, round(count(verdict) / (select greatest(count(*), 1) from {W}), 6) share from (values ('BLACK'), ('GREEN'), ('RED')) v(s) left join {W} w on verdict = s group by s",
    "sentence_accuracy": f"select *, case when share >= 0.8 then 'Good' when share >= 0.5 then 'Partial' else 'Poor' end label from (select row_id, round(avg((verdict in ('BLACK', 'GREEN'))::int), 6) share from {W} group by row_id)",
    "accuracy_summary": f"select round(avg(accuracy), 6) mean, round(median(accuracy), 6) median, count(*) n from {R}",
    "similar_lists": f"select sn, s similars from {S1} where sn is not null",
    "syllable_readings": f"select k \"key\", c chars from {S2} where k is not null",
    "column_bounds": f"select chapter, page, count(*) n, min(bbox_xmin) x0, min(bbox_ymin) y0, max(bbox_xmax) x1, max(bbox_ymax) y1 from {R} group by all",
    "corpus_nested": f"select chapter, page, list_sort(list(sentence_id)) ids from {R} group by all",
}

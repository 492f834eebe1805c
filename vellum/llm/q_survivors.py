"""Queries of problem 3 and their SQL."""

from vellum.llm import survivors as S
from vellum.tables import load


def _answers(spark, d):
    return S.answers(load(spark, d, "ocr_results"), load(spark, d, "ocr_models"))


def p3_found(spark, d):
    return S.by_precedence(_answers(spark, d))


def p3_truth(spark, d):
    return S.discover(_answers(spark, d))[0]


QUERIES = {"p3_found": p3_found, "p3_truth": p3_truth}

SQL = {
    "p3_found": """
with a as (
  select row_id, lower(trim(doc_id)) doc, page_no, coalesce(trust_rank, 2147483647) rk, try_cast(created_at as timestamptz) ts,
    case when coalesce(trim(error), '') = '' and regexp_matches(text, '\\p{L}') then text end text,
    case when coalesce(trim(error), '') = '' and confidence > 0 and confidence <= 1 then confidence end confidence
  from (select distinct on (row_id) * from ocr_results) o left join ocr_models m on lower(trim(o.model_name)) = lower(trim(m.model_name))),
b as (select *, max(length(text)) over (partition by doc, page_no) longest, count(*) over (partition by doc, page_no) n, min(row_id) over (partition by doc, page_no) group_id from a),
c as (select *,
  case when length(text) * 10 >= longest * 8 then row_number() over (partition by doc, page_no, coalesce(length(text) * 10 >= longest * 8, false) order by rk, ts desc nulls last, row_id) end tr,
  case when confidence is not null then row_number() over (partition by doc, page_no, confidence is not null order by rk, ts desc nulls last, row_id) end cr
  from b where n >= 2)
select group_id, coalesce(max(case when tr = 1 then row_id end), -1) text_from, coalesce(max(case when cr = 1 then row_id end), -1) confidence_from from c group by group_id
"""
}

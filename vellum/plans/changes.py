"""Queries of table changes, chunks and vectors, and their SQL."""

from pyspark.sql import functions as F

from vellum.operators import index as X
from vellum.operators import mutations as M
from vellum.operators.corpus import current_records, versions
from vellum.operators.queue import latest
from vellum.tables import load

c = F.col


def cur(s, d):
    return current_records(load(s, d, "records"))


def ocr(s, d):
    return versions(load(s, d, "ocr_results"))


def edits(s, d):
    x = cur(s, d).where("row_id % 11 = 0")
    return x.select("job_id", "human_id", F.lit("verified").alias("review_status"), F.lit(1).alias("reviewed_by"), F.lit(1.0).alias("reviewed_at"))


def links(s, d):
    x = cur(s, d).where("row_id % 13 = 0")
    heads = cur(s, d).groupBy("job_id").agg(F.min("human_id").alias("part_of"))
    return x.select("job_id", "human_id").join(heads, "job_id")


KEYS = ["job_id", "human_id"]

QUERIES = {
    "insert_if_absent": lambda s, d: M.insert_absent(cur(s, d).where("row_id % 2 = 0").select("row_id", *KEYS), versions(load(s, d, "records")).where("human_id is not null").select("row_id", *KEYS), KEYS, "row_id"),
    "upsert_latest": lambda s, d: M.upsert(latest(load(s, d, "jobs")).where("id % 2 = 0").select("id", "status", "updated_at"), load(s, d, "jobs").select("id", "status", "updated_at").distinct(), ["id"], "updated_at"),
    "replace_page_pending": lambda s, d: M.replace_page(cur(s, d).select("row_id", "job_id", "page", "review_status"), cur(s, d).where("job_id = 1 and page = 57").select((c("row_id") + 1000000).alias("row_id"), "job_id", "page", F.lit("pending").alias("review_status")), 1, 57),
    "cascade_status": lambda s, d: M.cascade_review(cur(s, d), edits(s, d)).select("row_id", "review_status", "reviewed_by", "reviewed_at"),
    "link_inherit": lambda s, d: M.link(cur(s, d), links(s, d)).select("row_id", "part_of", "entry_no", "review_status", "reviewed_by"),
    "unlink_tails": lambda s, d: M.unlink(cur(s, d), links(s, d)).select("row_id", "part_of"),
    "delete_cascade": lambda s, d: M.cascade_delete(latest(load(s, d, "jobs")), {"records": cur(s, d)}, load(s, d, "jobs").where("status = 'failed'"))["records"].select("row_id", "job_id"),
    "edit_rows": lambda s, d: M.edit(cur(s, d), edits(s, d).select(*KEYS, F.lit("新").alias("han"), F.lit(None).cast("string").alias("phonetic"), F.lit(None).cast("string").alias("meaning"), F.lit(None).cast("string").alias("review_status"), F.lit(2).alias("user"), F.lit(5.0).alias("at"))).select("row_id", "han", "review_status", "reviewed_by"),
    "page_chunks": lambda s, d: X.page_chunks(ocr(s, d)).select("doc_id", "page_no", "model_name", "text", "confidence"),
    "block_chunks": lambda s, d: X.block_chunks(ocr(s, d)).select("doc_id", "page_no", "model_name", "block_index", "text", "confidence"),
    "chunk_ids": lambda s, d: X.block_chunks(ocr(s, d)).select("point_id", "doc_id", "block_index"),
    "index_counters": lambda s, d: X.counters(ocr(s, d)),
    "cosine_topk": lambda s, d: X.nearest(load(s, d, "embeddings"), load(s, d, "embeddings").where("vec_id % 100 = 0"), 10),
    "label_centroids": lambda s, d: load(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.round(F.avg(c("v").cast("double")), 6).alias("mean")),
}

R = "(select distinct on (row_id) * from records)"
CUR = f"(select * from {R} where row_id in (select min(row_id) from records where human_id is not null group by job_id, human_id))"
LAST = "(select id, last(struct_pack(status := status, updated_at := updated_at) order by updated_at, status) r from jobs group by id)"
O = "(select distinct on (row_id) * from ocr_results where coalesce(trim(error), '') = '')"  # noqa: E741
_B = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ST = f"regexp_replace(%s, '^{_B}+|{_B}+$', '', 'g')"
LINKS = f"(select job_id, human_id, h from {CUR} join (select job_id, min(human_id) h from {CUR} group by all) using (job_id) where row_id % 13 = 0 and human_id <> h)"
BLK = f"(select doc_id, page_no, model_name, confidence pc, unnest(range(len(blocks)))::int block_index, unnest(blocks) b from {O})"

SQL = {
    "insert_if_absent": f"select row_id, job_id, human_id from {CUR}",
    "upsert_latest": f"select id, r.status status, r.updated_at updated_at from {LAST}",
    "replace_page_pending": f"select row_id, job_id, page, review_status from {CUR} where not coalesce(job_id = 1 and page = 57 and coalesce(review_status, '') <> 'verified', false) union all select row_id + 1000000, job_id, page, 'pending' from {CUR} where job_id = 1 and page = 57",
    "cascade_status": f"""select r.row_id, case when e.job_id is not null then 'verified' else review_status end review_status, case when e.job_id is not null then 1 else reviewed_by end reviewed_by,
  case when e.job_id is not null then 1.0 else reviewed_at end reviewed_at from {CUR} r left join (select job_id, human_id h from {CUR} where row_id % 11 = 0) e on r.job_id = e.job_id and coalesce(nullif(r.part_of, ''), r.human_id) = e.h""",
    "link_inherit": f"select r.row_id, coalesce(h, r.part_of) part_of, case when h is not null then q.entry_no else r.entry_no end entry_no, case when h is not null then q.review_status else r.review_status end review_status, case when h is not null then q.reviewed_by else r.reviewed_by end reviewed_by from {CUR} r left join {LINKS} l on r.job_id = l.job_id and r.human_id = l.human_id left join {CUR} q on q.job_id = r.job_id and q.human_id = h",
    "unlink_tails": f"select row_id, case when row_id % 13 = 0 then null else part_of end part_of from {CUR}",
    "delete_cascade": f"select row_id, job_id from {CUR} where job_id not in (select id from jobs where status = 'failed') or job_id is null",
    "edit_rows": f"""select r.row_id, case when row_id % 11 = 0 then '新' else han end han, case when e.job_id is not null then 'verified' else review_status end review_status, case when e.job_id is not null then 2 else reviewed_by end reviewed_by
  from {CUR} r left join (select job_id, human_id h from {CUR} where row_id % 11 = 0) e on r.job_id = e.job_id and coalesce(nullif(r.part_of, ''), r.human_id) = e.h""",
    "page_chunks": f"select doc_id, page_no, model_name, {ST % 'text'} text, confidence from {O} where {ST % 'text'} <> ''",
    "block_chunks": f"select doc_id, page_no, model_name, block_index, {ST % 'b.text'} text, coalesce(b.confidence, pc) confidence from {BLK} where {ST % 'b.text'} <> ''",
    "index_counters": f"select count(*) filter (where n > 0) pages, coalesce(sum(n), 0)::bigint points from (select len([x for x in coalesce(blocks, []) if {ST % 'x.text'} <> '']) n from {O})",
    "cosine_topk": """with v as (select vec_id, cast(embedding as double[64]) e from embeddings),
k as (select a.vec_id query_id, b.vec_id, array_cosine_similarity(a.e, b.e) s from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by s desc, vec_id) rank from k)
select query_id, vec_id, round(s, 6) score, rank::int rank from r where rank <= 10""",
    "label_centroids": "select label, i::int i, round(avg(v::double), 6) mean from (select label, unnest(range(len(embedding))) i, unnest(embedding) v from embeddings) group by all",
}

from vellum.plans.text import uuid5_sql  # noqa: E402

SQL["chunk_ids"] = f"select {uuid5_sql("concat_ws('|', doc_id, model_name, page_no::varchar, 'block', block_index::varchar)")} point_id, doc_id, block_index from {BLK} where {ST % 'b.text'} <> ''"

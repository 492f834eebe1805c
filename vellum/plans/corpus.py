"""Corpus queries and their SQL."""

from pyspark.sql import functions as F

from vellum.operators import corpus as C
from vellum.operators import queue as Q
from vellum.tables import load


def assignments(spark, d):
    """Page ranges of jobs for users, made from suppliers."""
    s = load(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.cast("int").alias("assignment_id"), (F.col("s_nationkey") + 1).alias("user_id"), (k % 109 + 1).alias("job_id"), (k % 50).cast("int").alias("page_start"), (k % 50 + 40).cast("int").alias("page_end"))


def r(spark, d):
    return C.versions(load(spark, d, "records"))


def flag():
    return (F.col("row_id") % 7) == 0

QUERIES = {
    "corpus_page_index": lambda s, d: C.page_index(r(s, d), load(s, d, "users")),
    "corpus_pages": lambda s, d: C.all_pages(r(s, d), load(s, d, "users")),
    "corpus_summary": lambda s, d: C.summary(r(s, d)),
    "corpus_member_filter": lambda s, d: C.all_pages(r(s, d), load(s, d, "users"), 4),
    "assignment_progress": lambda s, d: C.progress(assignments(s, d), load(s, d, "users"), r(s, d)),
    "editable_flags": lambda s, d: C.editable(r(s, d), assignments(s, d), 4),
    "visible_jobs": lambda s, d: C.visible_jobs(Q.latest(load(s, d, "jobs")), assignments(s, d), 4).select("id", "status"),
    "merged_entries": lambda s, d: C.folded(load(s, d, "records")).select("job_id", "human_id", "page", "han", "meaning", "parts"),
    "export_entries": lambda s, d: C.folded(load(s, d, "records"), True, C.FAR).select("job_id", "human_id", "han", "meaning", "parts"),
    "page_entries": lambda s, d: C.page_entries(load(s, d, "records")),
    "previous_entry_head": lambda s, d: C.previous_entry(load(s, d, "records")),
    "link_continuations": lambda s, d: C.linked(load(s, d, "records"), flag()),
    "next_line_no": lambda s, d: C.next_line(r(s, d)),
    "id_prefix": lambda s, d: C.work_prefix(r(s, d)),
    "unverified_pages": lambda s, d: C.unverified_pages(r(s, d), 1, 500),
    "page_images": lambda s, d: C.page_images(r(s, d)),
    "verified_page_exists": lambda s, d: r(s, d).groupBy("job_id", "page").agg(F.bool_or(F.col("review_status") == "verified").alias("verified")),
    "sheet_rows": lambda s, d: C.export_table(r(s, d).select("row_id", "page", "entry_no", "han", "meaning", F.col("entry_meta.ngay").alias("ngay"), F.col("entry_meta.loai").alias("loai"), "job_id"), ["row_id", "page", "entry_no", "han", "meaning", "ngay", "loai", "job_id"]),
    "status_histogram": lambda s, d: C.status_histogram(r(s, d), "review_status", ["pending", "verified", "rejected", "flagged"]),
    "queue_state_latest": lambda s, d: Q.latest(load(s, d, "jobs")).select("id", "status", "updated_at"),
    "queue_claim": lambda s, d: Q.claim(load(s, d, "jobs"), 3).select("id", "kind"),
    "queue_requeue": lambda s, d: Q.requeued(load(s, d, "jobs")).select("id", "status"),
    "queue_newest": lambda s, d: Q.newest(load(s, d, "jobs"), 20).select("id", "status"),
    "queue_state_counts": lambda s, d: Q.state_counts(load(s, d, "jobs")),
}

R = "(select distinct on (row_id) * from records)"
CUR = f"(select * from {R} where row_id in (select min(row_id) from records where human_id is not null group by job_id, human_id))"
U = "(select distinct on (id) * from users)"
A = "(select cast(s_suppkey as integer) assignment_id, s_nationkey + 1 user_id, s_suppkey % 109 + 1 job_id, cast(s_suppkey % 50 as integer) page_start, cast(s_suppkey % 50 + 40 as integer) page_end from supplier)"
J = "(select id, last(struct_pack(status := status, updated_at := updated_at, kind := kind) order by updated_at, status) r from jobs group by id)"
PAGES = f"""select page, count(*) entries, count(*) filter (where review_status = 'verified') verified, list_sort(list(distinct job_id)) jobs,
  coalesce(list_sort(list(distinct username) filter (where username is not null)), []) reviewers, max(reviewed_at) last_review
from {R} r left join (select id reviewed_by, username from {U}) using (reviewed_by) where_ group by page having count(*) filter (where review_status = 'verified') > 0"""
BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIP = rf"regexp_replace(coalesce(meaning, ''), '^{BLANK}+|{BLANK}+$', '', 'g')"


def fold(head_where: str, single: str, far: int) -> str:
    return f"""with x as (select *, coalesce(nullif(part_of, ''), human_id) head, (nullif(part_of, '') is not null) tail from {CUR}),
g as (select job_id, head human_id, first(page order by tail, coalesce(page, {far}), coalesce(line_no, {far}), row_id) page, string_agg(coalesce(han, ''), '' order by tail, coalesce(page, {far}), coalesce(line_no, {far}), row_id) han,
  string_agg(nullif({STRIP}, ''), ' ' order by tail, coalesce(page, {far}), coalesce(line_no, {far}), row_id) joined, first(coalesce(meaning, '') order by tail, coalesce(page, {far}), coalesce(line_no, {far}), row_id) own,
  count(*) parts, bool_or(not tail {head_where}) ok from x group by job_id, head)
"""


SQL = {
    "corpus_page_index": PAGES.replace("where_", "") + " order by page nulls last limit 100",
    "corpus_pages": PAGES.replace("where_", ""),
    "corpus_summary": f"select count(*) filter (where v > 0) page_count, coalesce(sum(n), 0)::bigint entry_count, coalesce(sum(v), 0)::bigint verified_count from (select page, count(*) n, count(*) filter (where review_status = 'verified') v from {R} group by page)",
    "corpus_member_filter": PAGES.replace("where_", "where reviewed_by = 4"),
    "assignment_progress": f"""select a.job_id, a.user_id, assignment_id, username, page_start, page_end,
  (select count(*) from {R} r where r.job_id = a.job_id and r.page between page_start and page_end) total,
  (select count(*) from {R} r where r.job_id = a.job_id and r.page between page_start and page_end and review_status = 'verified') verified,
  (select min(page) from {R} r where r.job_id = a.job_id and r.page between page_start and page_end and coalesce(review_status, '') <> 'verified') next_page,
  (select max(reviewed_at) from {R} r where r.job_id = a.job_id and r.reviewed_by = a.user_id) last_active
from {A} a join {U} u on u.id = a.user_id""",
    "editable_flags": f"select row_id, exists (select 1 from {A} a where a.user_id = 4 and a.job_id = r.job_id and r.page between page_start and page_end) editable from {R} r",
    "visible_jobs": f"select id, r.status status from {J} where id in (select job_id from {A} where user_id = 4)",
    "merged_entries": fold("", "", 0) + "select job_id, human_id, page, han, case when parts = 1 then own else coalesce(joined, '') end meaning, parts from g where ok",
    "export_entries": fold("and review_status = 'verified'", "", 1 << 30) + "select job_id, human_id, han, coalesce(joined, '') meaning, parts from g where ok",
    "page_entries": f"""with x as (select *, coalesce(nullif(part_of, ''), human_id) head, (nullif(part_of, '') is not null) tail from {CUR}),
h as (select job_id, human_id head, page head_page, review_status head_status from x where not tail),
j as (select x.*, head_status, (not tail or (x.page is not distinct from head_page and head_status is not null)) here from x left join h using (job_id, head)),
o as (select *, case when here then head else human_id end owner, case when tail and head_status is not null then head_status else review_status end st from j)
select job_id, page, owner human_id, string_agg(coalesce(han, ''), '' order by tail, coalesce(line_no, 0), row_id) han, first(st order by tail, coalesce(line_no, 0), row_id) status,
  first((not here) and head_status is not null order by tail, coalesce(line_no, 0), row_id) spans, count(*) parts from o group by all""",
    "previous_entry_head": f"select row_id, lag(coalesce(nullif(part_of, ''), human_id)) over (partition by job_id order by page nulls first, line_no nulls last, row_id) previous from {CUR}",
    "link_continuations": f"""with x as (select *, coalesce(nullif(part_of, ''), human_id) head, row_number() over (partition by job_id order by page nulls first, line_no nulls last, row_id) n from {CUR}),
y as (select *, row_id % 7 = 0 and n > 1 f, case when row_id % 7 = 0 and n > 1 then null else head end own from x)
select row_id, case when f then last_value(own ignore nulls) over (partition by job_id order by n rows between unbounded preceding and 1 preceding) else nullif(part_of, '') end link from y""",
    "next_line_no": f"select job_id, page, coalesce(max(line_no), 0) + 1 next_line from {R} group by all",
    "id_prefix": f"select job_id, coalesce(regexp_replace(arg_min(human_id, row_id), '\\.[^.]*\\.[^.]*$', ''), 'HVB_001') prefix from {R} group by job_id",
    "unverified_pages": f"select job_id, page from {R} where page between 1 and 500 group by all having not bool_or(coalesce(review_status = 'verified', false))",
    "page_images": f"with a as (select job_id, arg_min(image_path, row_id) o from {R} group by all), p as (select job_id, page, arg_min(nullif(image_path, ''), row_id) i from {R} group by all) select job_id, page, coalesce(i, o) image from p join a using (job_id)",
    "verified_page_exists": f"select job_id, page, bool_or(review_status = 'verified') verified from {R} group by all",
    "sheet_rows": f"select row_id::varchar row_id, coalesce(page::varchar, '') page, coalesce(entry_no::varchar, '') entry_no, coalesce(han, '') han, coalesce(meaning, '') meaning, coalesce(entry_meta.ngay, '') ngay, coalesce(entry_meta.loai, '') loai, coalesce(job_id::varchar, '') job_id from {R}",
    "status_histogram": f"select s status, count(review_status) n, round(count(review_status) / (select greatest(count(*), 1) from {R}), 6) share from (values ('pending'), ('verified'), ('rejected'), ('flagged')) v(s) left join {R} r on review_status = s group by s",
    "queue_state_latest": f"select id, r.status status, r.updated_at updated_at from {J}",
    "queue_claim": f"select id, r.kind kind from {J} where r.status = 'pending' order by id limit 3",
    "queue_requeue": f"select id, case when r.status = 'running' then 'pending' else r.status end status from {J}",
    "queue_newest": f"select id, r.status status from {J} order by id desc limit 20",
    "queue_state_counts": f"select r.status status, count(*) n from {J} group by all",
}

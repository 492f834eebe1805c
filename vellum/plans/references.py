"""Queries of problem 4."""

from vellum.operators import references as R
from vellum.tables import load


def p4_found(spark, d):
    return R.record_references(*(load(spark, d, t) for t in ("records", "jobs", "users", "removals")))


def p4_report(spark, d):
    return R.report(p4_found(spark, d))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}

FOUND = """
with k as (
  select 'job_id' kind, '' scope, cast(id as varchar) k, created_at ts from jobs
  union all select 'part_of', coalesce(cast(job_id as varchar), ''), human_id, created_at from records where human_id <> ''
  union all select 'reviewed_by', '', cast(id as varchar), created_at from users),
v as (select kind, scope, k, min(ts) born, max(ts) last_up from k group by all),
g as (
  select case table_name when 'jobs' then 'job_id' when 'records' then 'part_of' when 'users' then 'reviewed_by' end kind,
         case when table_name = 'records' then coalesce(cast(job_id as varchar), '') else '' end scope, key_text k, max(removed_at) gone
  from removals group by all),
f as (
  select row_id, created_at, 'job_id' kind, '' scope, cast(job_id as varchar) k, created_at ts from records where job_id is not null
  union all select row_id, created_at, 'part_of', coalesce(cast(job_id as varchar), ''), part_of, created_at from records where part_of <> ''
  union all select row_id, created_at, 'reviewed_by', '', cast(reviewed_by as varchar), coalesce(reviewed_at, created_at) from records where reviewed_by is not null),
r as (
  select row_id, f.kind field_name,
    case when gone is not null and (last_up is null or last_up < gone) then 'deleted' when born is null then 'missing' when born > ts then 'later' end reason,
    strftime(make_timestamp(cast(floor(f.created_at) * 1000000 as bigint)), '%Y-%m') period
  from f left join v using (kind, scope, k) left join g using (kind, scope, k))
select distinct row_id, field_name, reason, period from r where reason is not null
"""

SQL = {"p4_found": FOUND, "p4_report": f"select field_name, reason, period, count(*) n from ({FOUND}) group by all"}

"""Corpus questions over records: page indexes, progress, continued entries, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import strip

FAR = 1 << 30


def versions(df: DataFrame, key: str = "row_id") -> DataFrame:
    """One row for each key; a repeated key is the same row delivered again."""
    return df.dropDuplicates([key])


def current_records(records: DataFrame) -> DataFrame:
    """One row for each (job_id, human_id), the smallest row_id: what an insert that ignores known keys keeps."""
    best = records.where("human_id is not null").groupBy("job_id", "human_id").agg(F.min("row_id").alias("row_id"))
    return versions(records).join(best.select("row_id"), "row_id", "left_semi")


def page_index(records: DataFrame, users: DataFrame, limit: int = 100, offset: int = 0, reviewer: int | None = None) -> DataFrame:
    """Pages that have a verified row: counts, jobs, reviewers and last review, by page; limit is clamped to 1 to 200."""
    limit, offset = max(1, min(limit, 200)), max(0, offset)
    return all_pages(records, users, reviewer).orderBy(F.col("page").asc_nulls_last()).offset(offset).limit(limit)


def all_pages(records: DataFrame, users: DataFrame, reviewer: int | None = None) -> DataFrame:
    r = records if reviewer is None else records.where(F.col("reviewed_by") == reviewer)
    u = versions(users, "id").select(F.col("id").alias("reviewed_by"), "username")
    verified = F.col("review_status") == "verified"
    g = r.join(u, "reviewed_by", "left").groupBy("page").agg(
        F.count("*").alias("entries"), F.count_if(verified).alias("verified"), F.array_sort(F.collect_set("job_id")).alias("jobs"), F.array_sort(F.collect_set("username")).alias("reviewers"), F.max("reviewed_at").alias("last_review")
    )
    return g.where("verified > 0")


def summary(records: DataFrame) -> DataFrame:
    """One row: pages with a verified row, entries, verified entries."""
    verified = F.col("review_status") == "verified"
    pages = records.groupBy("page").agg(F.count_if(verified).alias("v"), F.count("*").alias("n"))
    return pages.agg(F.count_if(F.col("v") > 0).alias("page_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("entry_count"), F.coalesce(F.sum("v"), F.lit(0)).alias("verified_count"))


def progress(assignments: DataFrame, users: DataFrame, records: DataFrame) -> DataFrame:
    """For each assignment: rows in its range, verified ones, first page pending, and the reviewer's last review of the job.

    One equi-join by job with the range as its residual, instead of a scalar query for each figure. Records are first
    counted by (job, page), so the join's right side has a row for each page.
    """
    verified = F.col("review_status") == "verified"
    pages = records.groupBy("job_id", "page").agg(F.count("*").alias("n"), F.count_if(verified).alias("v"))
    u = versions(users, "id").select(F.col("id").alias("user_id"), "username")
    a = assignments.join(u, "user_id")
    j = a.join(pages, (a.job_id == pages.job_id) & pages.page.between(a.page_start, a.page_end), "left").drop(pages.job_id)
    keys = ["assignment_id", "user_id", "username", "job_id", "page_start", "page_end"]
    done = j.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("v"), F.lit(0)).alias("verified"), F.min(F.when(F.col("n") > F.col("v"), F.col("page"))).alias("next_page"))
    last = records.where("reviewed_by is not null").groupBy("job_id", F.col("reviewed_by").alias("user_id")).agg(F.max("reviewed_at").alias("last_active"))
    return done.join(last, ["job_id", "user_id"], "left")


def editable(records: DataFrame, assignments: DataFrame, user: int, admin: bool = False) -> DataFrame:
    """(row_id, editable): whether a row's page is in a range of the user; false for null pages, true for an admin."""
    mine = assignments.where(F.col("user_id") == user).groupBy("job_id").agg(F.collect_list(F.struct("page_start", "page_end")).alias("ranges"))
    x = records.join(mine, "job_id", "left")
    inside = F.coalesce(F.exists("ranges", lambda r: F.col("page").between(r["page_start"], r["page_end"])), F.lit(False))
    return x.select("row_id", (F.lit(True) if admin else inside).alias("editable"))


def visible_jobs(jobs: DataFrame, assignments: DataFrame, user: int) -> DataFrame:
    return jobs.join(assignments.where(F.col("user_id") == user).select(F.col("job_id").alias("id")), "id", "left_semi")


def _head_key(records: DataFrame) -> DataFrame:
    part = F.nullif(F.col("part_of"), F.lit(""))
    return records.withColumn("head", F.coalesce(part, "human_id")).withColumn("is_tail", part.isNotNull().cast("int"))


def folded(records: DataFrame, verified_only: bool = False, far_pages: int = 0) -> DataFrame:
    """Entries with their continuations: (job_id, human_id, page, han, meaning, parts, pages).

    Tails attach to the head of the same job; the head comes first, tails by page, line and row_id. Han texts are
    joined by nothing, meanings stripped and joined by blanks; an entry with no tail keeps its meaning as it is (with
    verified_only it is stripped too). Tails with no head are left out. Grouping by the head's key takes one shuffle
    and no self-join; a group is an entry's parts.
    """
    x = _head_key(current_records(records))
    part = F.struct("is_tail", F.coalesce("page", F.lit(far_pages)).alias("p"), F.coalesce("line_no", F.lit(far_pages)).alias("l"), "row_id", "human_id", "page", F.coalesce("han", F.lit("")).alias("han"), F.coalesce("meaning", F.lit("")).alias("meaning"), "review_status")
    g = x.groupBy("job_id", "head").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    first = F.col("parts")[0]
    g = g.where(first["is_tail"] == 0)
    if verified_only:
        g = g.where(first["review_status"] == "verified")
    texts = F.filter(F.transform("parts", lambda p: strip(p["meaning"])), lambda t: t != "")
    meaning = F.array_join(texts, " ")
    if not verified_only:
        meaning = F.when(F.size("parts") == 1, first["meaning"]).otherwise(meaning)
    return g.select(
        "job_id", F.col("head").alias("human_id"), first["page"].alias("page"), F.array_join(F.transform("parts", lambda p: p["han"]), "").alias("han"), meaning.alias("meaning"),
        F.size("parts").alias("parts"), F.when(F.size("parts") > 1, F.transform("parts", lambda p: p["page"])).alias("pages"),
    )


def page_entries(records: DataFrame) -> DataFrame:
    """Entries as each page shows them: a tail folds into a head on its page; a tail whose head is on another page is a row of
    its own with the head's status and ``spans`` true; a tail with no head is its own row with its own status."""
    x = _head_key(current_records(records))
    heads = x.where("is_tail = 0").select("job_id", F.col("human_id").alias("head"), F.col("page").alias("head_page"), F.col("review_status").alias("head_status"))
    j = x.join(heads, ["job_id", "head"], "left")
    here = (F.col("is_tail") == 0) | F.equal_null("page", "head_page") & F.col("head_status").isNotNull()
    j = j.withColumn("owner", F.when(here, F.col("head")).otherwise(F.col("human_id")))
    status = F.when((F.col("is_tail") == 1) & F.col("head_status").isNotNull(), F.col("head_status")).otherwise(F.col("review_status"))
    part = F.struct("is_tail", F.coalesce("line_no", F.lit(0)).alias("l"), "row_id", F.coalesce("han", F.lit("")).alias("han"), status.alias("status"), (~here).alias("out"), F.col("head_status").isNotNull().alias("known"))
    g = j.groupBy("job_id", "page", "owner").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    first = F.col("parts")[0]
    return g.select("job_id", "page", F.col("owner").alias("human_id"), F.array_join(F.transform("parts", lambda p: p["han"]), "").alias("han"), first["status"].alias("status"), (first["out"] & first["known"]).alias("spans"), F.size("parts").alias("parts"))


def reading_order(page: str = "page", line: str = "line_no", row: str = "row_id") -> list[Column]:
    return [F.col(page).asc_nulls_first(), F.col(line).asc_nulls_last(), F.col(row).asc()]


def previous_entry(records: DataFrame) -> DataFrame:
    """(row_id, previous): the entry before each row of its job in reading order, its head where it continues one.

    Rows are ordered within their page; what a page takes over from the pages before it is looked up among a row for each page, so a job
    with most of the rows is not ordered by one task.
    """
    x = _head_key(current_records(records))
    w, before = _by_page("head", x)
    x = x.withColumn("_in", F.lag("head").over(w)).join(before, *_same_page(x, before), "left")
    return x.select("row_id", F.coalesce("_in", "_carried").alias("previous"))


def _by_page(value: str, x: DataFrame):
    """(window of a page's rows in reading order, (job_id, page, value's last that is there on an earlier page, whether there is an earlier page))."""
    w = Window.partitionBy("job_id", "page").orderBy(F.col("line_no").asc_nulls_last(), F.col("row_id").asc())
    place = F.when(F.col(value).isNotNull(), F.struct(F.col("line_no").isNull().alias("a"), "line_no", "row_id"))
    pages = x.groupBy("job_id", "page").agg(F.max_by(value, place).alias("_last"))
    over = Window.partitionBy("job_id").orderBy(F.col("page").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return w, pages.select(F.col("job_id").alias("_job"), F.col("page").alias("_page"), F.last_value("_last", True).over(over).alias("_carried"), (F.count("*").over(over) > 0).alias("_later"))


def _same_page(x: DataFrame, pages: DataFrame):
    return (F.equal_null(x["job_id"], pages["_job"]) & F.equal_null(x["page"], pages["_page"]),)


def linked(records: DataFrame, flagged: Column) -> DataFrame:
    """(row_id, link): flagged rows attached to the nearest head before them; a job's first row stays a head."""
    x = _head_key(current_records(records)).withColumn("flag", F.coalesce(flagged, F.lit(False)))
    w, pages = _by_page("head", x)
    x = x.withColumn("n", F.row_number().over(w)).join(pages.select("_job", "_page", "_later"), *_same_page(x, pages), "left").drop("_job", "_page")
    moved = F.col("flag") & (F.col("_later") | (F.col("n") > 1))
    x = x.withColumn("own", F.when(~moved, F.col("head"))).withColumn("moved", moved)
    w, before = _by_page("own", x)
    x = x.withColumn("_in", F.last_value("own", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.join(before.select("_job", "_page", "_carried"), *_same_page(x, before), "left")
    return x.select("row_id", F.when(F.col("moved"), F.coalesce("_in", "_carried")).otherwise(F.nullif(F.col("part_of"), F.lit(""))).alias("link"))


def next_line(records: DataFrame) -> DataFrame:
    return records.groupBy("job_id", "page").agg((F.coalesce(F.max("line_no"), F.lit(0)) + 1).alias("next_line"))


def work_prefix(records: DataFrame, default: str = "HVB_001") -> DataFrame:
    """(job_id, prefix): the first row's id without its last two dotted parts."""
    g = records.groupBy("job_id").agg(F.min_by("human_id", "row_id").alias("first"))
    return g.select("job_id", F.coalesce(F.regexp_replace("first", r"\.[^.]*\.[^.]*$", ""), F.lit(default)).alias("prefix"))


def unverified_pages(records: DataFrame, first: int, last: int) -> DataFrame:
    """Pages in a range on which no row is verified."""
    g = records.where(F.col("page").between(first, last)).groupBy("job_id", "page").agg(F.bool_or(F.coalesce(F.col("review_status") == "verified", F.lit(False))).alias("done"))
    return g.where(~F.col("done")).select("job_id", "page")


def page_images(records: DataFrame) -> DataFrame:
    """(job_id, page, image): the first row's image of the page, else of the job."""
    image = F.nullif(F.col("image_path"), F.lit(""))
    any_ = records.groupBy("job_id").agg(F.min_by("image_path", F.when(F.col("image_path").isNotNull(), F.col("row_id"))).alias("any"))
    own = records.groupBy("job_id", "page").agg(F.min_by(image, F.when(image.isNotNull(), F.col("row_id"))).alias("own"))
    return own.join(any_, "job_id").select("job_id", "page", F.coalesce("own", "any").alias("image"))


def export_table(entries: DataFrame, columns: list[str]) -> DataFrame:
    """All columns as texts, nulls as empty texts."""
    return entries.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))


def status_histogram(df: DataFrame, status: str, known: list[str]) -> DataFrame:
    """(status, n, share): counts with zeros for statuses that do not occur."""
    spark = df.sparkSession
    all_ = spark.createDataFrame([(k,) for k in known], "status string")
    n = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    j = all_.join(n, "status", "left")
    return j.crossJoin(F.broadcast(total)).select("status", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce(F.col("n"), F.lit(0)) / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1)), 6).alias("share"))

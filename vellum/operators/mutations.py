"""Changes to keyed tables as rewrites: each takes tables and returns the changed table.

Plain Parquet has no update, so a caller writes the result to a new place and swaps (``sources.store.swap``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDITABLE = ("han", "phonetic", "meaning")


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order`` (ties by all columns), with partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("r"))
    return g.select(*keys, *(F.col("r")[c].alias(c) for c in rest)).select(*df.columns)


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``existing`` and those first rows of ``new`` whose key it does not have."""
    return existing.unionByName(first_of(new, keys, order).join(existing.select(*keys), keys, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key: that of the highest version, of ``new`` where both are equal."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys]
    g = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("r"))
    return g.select(*keys, *(F.col("r")[c].alias(c) for c in rest)).select(*existing.columns)


def replace_page(existing: DataFrame, new: DataFrame, job: int, page: int) -> DataFrame:
    """A page's rows that are not verified give way to ``new``; verified rows stay. There is no conflict rule."""
    gone = (F.col("job_id") == job) & (F.col("page") == page) & (F.coalesce("review_status", F.lit("")) != "verified")
    return existing.where(~F.coalesce(gone, F.lit(False))).unionByName(new)


def insert_counts(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row, (inserted, known): how many keys of ``new`` an insert adds and how many it finds."""
    n = new.select(*keys).distinct().join(existing.select(*keys, F.lit(1).alias("_there")).distinct(), keys, "left")
    return n.agg(F.count_if(F.col("_there").isNull()).alias("inserted"), F.count("_there").alias("known"))


def update_rows(existing: DataFrame, edits: DataFrame, keys: list[str], nulls: bool = False) -> DataFrame:
    """Rows with the values of ``edits`` that are not null, or with ``nulls`` all values; edits hold a row for each key."""
    if nulls:
        set_ = [c for c in edits.columns if c not in keys]
        j = existing.join(edits.select(*keys, F.lit(True).alias("_set"), *(F.col(c).alias(f"_e_{c}") for c in set_)), keys, "left")
        return j.select(*(F.when(F.col("_set"), F.col(f"_e_{c}")).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in existing.columns))
    names = [c for c in edits.columns if c not in keys]
    j = existing.join(edits.select(*keys, *(F.col(c).alias(f"_e_{c}") for c in names)), keys, "left")
    return j.select(*(F.coalesce(f"_e_{c}", c).alias(c) if c in names else F.col(c) for c in existing.columns))


def delete_rows(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade_delete(jobs: DataFrame, children: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Jobs without ``gone`` (id) and each child table without their rows (job_id)."""
    ids = gone.select("id").distinct()
    out = {name: t.join(ids.select(F.col("id").alias("job_id")), "job_id", "left_anti") for name, t in children.items()}
    return {"jobs": jobs.join(ids, "id", "left_anti"), **out}


def link(records: DataFrame, links: DataFrame) -> DataFrame:
    """Tails (job_id, human_id) linked to ``part_of``: they inherit the head's number, metadata, status and reviewer; a link to a head that
    is not there is a plain link; a link to itself is left out."""
    l = links.where("human_id <> part_of").select("job_id", "human_id", F.col("part_of").alias("_head"))  # noqa: E741
    inherited = ("entry_no", "entry_meta", "review_status", "reviewed_by", "reviewed_at")
    heads = records.select("job_id", F.col("human_id").alias("_head"), F.lit(True).alias("_there"), *(F.col(c).alias(f"_h_{c}") for c in inherited))
    j = records.join(l, ["job_id", "human_id"], "left").join(heads, ["job_id", "_head"], "left")
    cols = [F.when(F.col("_there"), F.col(f"_h_{c}")).otherwise(F.col(c)).alias(c) if c in inherited else F.coalesce("_head", c).alias(c) if c == "part_of" else F.col(c) for c in records.columns]
    return j.select(*cols)


def unlink(records: DataFrame, tails: DataFrame) -> DataFrame:
    j = records.join(tails.select("job_id", "human_id", F.lit(True).alias("_cut")).distinct(), ["job_id", "human_id"], "left")
    return j.select(*(F.when(F.col("_cut"), F.lit(None)).otherwise(F.col(c)).alias(c) if c == "part_of" else F.col(c) for c in records.columns))


def cascade_review(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (job_id, human_id, review_status, reviewed_by, reviewed_at) on heads, copied to all rows that continue them. A reviewer and
    a time stand only with verified."""
    names = ("review_status", "reviewed_by", "reviewed_at")
    done = F.col("review_status") == "verified"
    d = decisions.select("job_id", F.col("human_id").alias("_head"), "review_status", F.when(done, F.col("reviewed_by")).alias("reviewed_by"), F.when(done, F.col("reviewed_at")).alias("reviewed_at"))
    d = d.select("job_id", "_head", F.lit(True).alias("_set"), *(F.col(c).alias(f"_d_{c}") for c in names))
    r = records.withColumn("_head", F.coalesce(F.nullif(F.col("part_of"), F.lit("")), "human_id"))
    j = r.join(d, ["job_id", "_head"], "left")
    return j.select(*(F.when(F.col("_set"), F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in records.columns))


def edit(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (job_id, human_id, han, phonetic, meaning, review_status, user, at): given texts change, the status is the given one or verified,
    and the decision goes on to the continuations."""
    texts = update_rows(records, edits.select("job_id", "human_id", *EDITABLE), ["job_id", "human_id"])
    d = edits.select("job_id", "human_id", F.coalesce("review_status", F.lit("verified")).alias("review_status"), F.col("user").alias("reviewed_by"), F.col("at").alias("reviewed_at"))
    return cascade_review(texts, d)


def merged_meta(meta: Column, edit_: Column, names: tuple[str, ...] = ("ngay", "to_tap", "loai", "xuat_xu", "de_tai")) -> Column:
    """Metadata with the edit's values where they are not null."""
    return F.struct(*(F.coalesce(edit_[n], meta[n]).alias(n) for n in names))


def bounded(assignments: DataFrame) -> DataFrame:
    """Assignments with their page bounds in order."""
    return assignments.withColumns({"page_start": F.least("page_start", "page_end"), "page_end": F.greatest("page_start", "page_end")})


def resolve_links(records: DataFrame, links: DataFrame) -> DataFrame:
    """(job_id, human_id, part_of, problem) of links (job_id, human_id, part_of): the entry each tail continues.

    A given head that continues an entry itself stands for that entry, one level up; where none is given it is the entry before the tail in
    reading order. problem names what makes a link void: no record, no head, no entry before, or itself; part_of is null then.
    """
    from vellum.operators.corpus import previous_entry

    named = F.nullif(F.col("part_of"), F.lit(""))
    before = records.select("row_id", "job_id", "human_id").join(previous_entry(records), "row_id").select("job_id", "human_id", "previous", F.lit(True).alias("_known"))
    heads = records.select("job_id", F.col("human_id").alias("_named"), F.coalesce(F.nullif(F.col("part_of"), F.lit("")), "human_id").alias("_head"))
    j = links.select("job_id", "human_id", named.alias("_named")).join(before, ["job_id", "human_id"], "left").join(heads, ["job_id", "_named"], "left")
    head = F.when(F.col("_named").isNull(), F.col("previous")).otherwise(F.col("_head"))
    problem = F.when(F.col("_known").isNull(), "no record").when(F.col("_named").isNotNull() & F.col("_head").isNull(), "no head").when(head.isNull(), "no entry before").when(head == F.col("human_id"), "itself")
    return j.select("job_id", "human_id", F.when(problem.isNull(), head).alias("part_of"), problem.alias("problem"))


def new_records(records: DataFrame, boxes: DataFrame) -> DataFrame:
    """Records for boxes (job_id, page, box_no, han, meaning, han_bbox, meaning_bbox, image_path) that a user drew.

    A record's id is the work's prefix with the page and the next free line; boxes of a page take lines in the order of box_no. The
    image is the given one, else the page's, else the job's; the meaning's box is the Han box where it is not given.
    """
    from vellum.operators.corpus import next_line, page_images, work_prefix

    docs = records.groupBy("job_id").agg(F.min_by("source_doc", "row_id").alias("source_doc"), F.min_by("image_path", F.when(F.col("image_path").isNotNull(), F.col("row_id"))).alias("_any"))
    j = boxes.join(work_prefix(records), "job_id", "left").join(next_line(records), ["job_id", "page"], "left").join(page_images(records).withColumnRenamed("image", "_own"), ["job_id", "page"], "left").join(docs, "job_id", "left")
    at = F.row_number().over(Window.partitionBy("job_id", "page").orderBy("box_no"))
    line = (F.coalesce("next_line", F.lit(1)) + at - 1).cast("int")
    text = lambda c: F.coalesce(c, F.lit(""))
    return j.select(
        F.format_string("%s.%03d.%02d", F.coalesce("prefix", F.lit("HVB_001")), "page", line).alias("human_id"), "job_id", text("source_doc").alias("source_doc"), "page", line.alias("line_no"), text("han").alias("han"), text("han").alias("han_raw"),
        text("meaning").alias("meaning"), F.lit("two_column").alias("layout_type"), F.coalesce(F.nullif(F.col("image_path"), F.lit("")), "_own", "_any", F.lit("")).alias("image_path"), F.lit("pending").alias("review_status"), "han_bbox", F.coalesce("meaning_bbox", "han_bbox").alias("meaning_bbox"),
    )


def followed(states: DataFrame, polls: DataFrame) -> DataFrame:
    """(id, state, applied_at) of batches (id, state) after polls (id, at, state) of a service.

    The first poll that succeeded applies the batch, once; nothing that comes later changes it, so polls may repeat. Else the last poll
    counts: failed, cancelled and expired end a batch, an unknown state is running. A batch without polls stays as it is.
    """
    ended = F.min(F.when(F.col("state") == "succeeded", F.col("at")))
    last = F.max_by("state", F.struct("at", "state"))
    p = polls.groupBy("id").agg(ended.alias("applied_at"), last.alias("last"))
    j = states.select("id", F.col("state").alias("before")).join(p, "id", "left")
    now = F.when((F.col("before") == "applied") | F.col("applied_at").isNotNull(), "applied").when(F.col("last") == "unknown", "running").otherwise(F.coalesce("last", "before"))
    return j.select("id", now.alias("state"), F.when(F.col("before") != "applied", F.col("applied_at")).alias("applied_at"))

"""Model replies as records: lenient parsing, shaping, and applying to pages that nobody has verified since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.geometry import to_pixels
from vellum.functions.ids import json_part
from vellum.functions.text import strip

# Names under which replies give the two texts, in the order they count, and the fields of an entry's metadata.
HAN_KEYS = ("han", "han_text", "hán", "hanvan", "han_van", "chinese", "classical_chinese")
VI_KEYS = ("vietnamese", "vietnamese_text", "meaning", "quoc_ngu", "quocngu", "viet", "translation", "quoc_ngu_text")
META_KEYS = ("ngay", "to_tap", "loai", "xuat_xu", "de_tai")


def _first(fields: Column, keys: tuple[str, ...]) -> Column:
    """The text of the first key that has one, bare or wrapped as {text} or {value}; keys without regard to case."""

    def text(k: str) -> Column:
        v = F.try_element_at(fields, F.lit(k))
        bare = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
        wrapped = F.coalesce(F.nullif(F.try_variant_get(v, "$.text", "string"), F.lit("")), F.try_variant_get(v, "$.value", "string"))
        return F.coalesce(bare, F.when(F.schema_of_variant(v).startswith("OBJECT"), F.coalesce(wrapped, F.lit(""))))

    return strip(F.coalesce(*map(text, keys), F.lit("")))


def enhanced(reply: Column) -> Column:
    """STRUCT<han, meaning> of a reply: from its JSON, else the whole reply is the Han text."""
    plain = strip(F.regexp_replace(F.coalesce(reply, F.lit("")), "```(?:json)?", ""))
    fields = F.try_variant_get(F.try_parse_json(F.regexp_extract(plain, r"(?s)\{.*\}", 0)), "$", "map<string,variant>")
    low = F.map_from_entries(F.transform(F.map_entries(fields), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    han, meaning = _first(low, HAN_KEYS), _first(low, VI_KEYS)
    return F.when((han != "") | (meaning != ""), F.struct(han.alias("han"), meaning.alias("meaning"))).otherwise(F.struct(plain.alias("han"), F.lit("").alias("meaning")))


def entries(reply: Column) -> Column:
    """ARRAY<VARIANT> of a reply's entries: its list, or the list under entries; empty where the JSON is broken. What is no object is kept as
    it is and has no fields."""
    v = F.try_parse_json(json_part(reply))
    return F.coalesce(F.try_variant_get(v, "$.entries", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def page_records(replies: DataFrame, *keys: str) -> DataFrame:
    """Records of replies (keys, prefix, page, width, height, reply): one for each entry with a text or a box, in order.

    line_no counts the records that are kept; entry_no is the entry's own number, else the line. ``continues`` is the reply's flag. Boxes
    are in pixels, null where they have no area.
    """
    x = replies.select(*keys, "prefix", "page", "width", "height", F.posexplode(entries(F.col("reply"))).alias("at", "e"))
    get = lambda n, kind="string": F.try_variant_get("e", f"$.{n}", kind)
    first = lambda *names: strip(F.coalesce(*(F.nullif(get(n), F.lit("")) for n in names), F.lit("")))
    boxed = lambda *names: to_pixels(F.coalesce(*(F.filter(get(n, "array<double>"), lambda v: v.isNotNull()) for n in names)), F.col("width"), F.col("height"))
    x = x.select(
        *keys, "prefix", "page", "at", first("han").alias("han"), first("vietnamese", "viet", "meaning").alias("meaning"), boxed("han_box").alias("han_bbox"), boxed("viet_box", "vi_box").alias("meaning_bbox"),
        F.trim(get("entry_no")).try_cast("int").alias("number"), F.coalesce(get("is_continuation", "boolean"), F.lit(False)).alias("continues"), F.struct(*(strip(F.coalesce(get(f"meta.{n}"), F.lit(""))).alias(n) for n in META_KEYS)).alias("entry_meta"),
    )
    none = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    kept = x.where((F.col("han") != "") | (F.col("meaning") != "") | (F.size("han_bbox") > 0) | (F.size("meaning_bbox") > 0))
    line = F.row_number().over(Window.partitionBy(*keys, "page").orderBy("at"))
    kept = kept.withColumn("line_no", line)
    return kept.select(
        *keys, "page", F.format_string("%s.%03d.%02d", "prefix", "page", "line_no").alias("human_id"), "line_no", F.coalesce("number", "line_no").alias("entry_no"), "han", F.col("han").alias("han_raw"), "meaning",
        F.lit("two_column").alias("layout_type"), F.lit("pending").alias("review_status"), none("han_bbox"), none("meaning_bbox"), "entry_meta", "continues",
    )


def numbered(results: DataFrame) -> DataFrame:
    """Results (key, …) whose key is a page number, with the page; others belong to no page."""
    return results.where(F.col("key").rlike(r"^\d+$")).withColumn("page", F.col("key").try_cast("int")).where("page is not null")


def open_pages(replies: DataFrame, records: DataFrame) -> DataFrame:
    """Replies for pages (job_id, page) on which no record is verified now, whatever was the case when they were asked for."""
    done = records.where("review_status = 'verified' and page is not null").select("job_id", "page").distinct()
    return replies.join(done, ["job_id", "page"], "left_anti")


def applied(records: DataFrame, replies: DataFrame) -> DataFrame:
    """The records (row_id, job_id, human_id, page, line_no, han, meaning, review_status, part_of) after replies (job_id, prefix, page, width, height,
    reply): a page's records give way to those of its reply, unless one is verified; then the page is left as it is. Replied records
    have no row_id yet; one that continues names the last head before it in its job."""
    names = ("row_id", "job_id", "human_id", "page", "line_no", "han", "meaning", "review_status", "part_of")
    todo = open_pages(replies, records)
    new = page_records(todo, "job_id")
    old = records.join(todo.select("job_id", "page").distinct(), ["job_id", "page"], "left_anti")
    both = old.select(*names, F.lit(False).alias("continues")).unionByName(new.select(F.lit(None).cast("long").alias("row_id"), *names[1:8], F.lit(None).cast("string").alias("part_of"), "continues"))
    w = Window.partitionBy("job_id").orderBy(F.col("page").asc_nulls_first(), F.col("line_no").asc_nulls_last(), F.col("row_id").asc_nulls_last(), "human_id")
    own = F.coalesce(F.nullif(F.col("part_of"), F.lit("")), F.when(~F.col("continues"), F.col("human_id")))
    head = F.last_value(own, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("part_of", F.when(F.col("continues"), head).otherwise(F.col("part_of"))).select(*names)

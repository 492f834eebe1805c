"""Records from pages: two-column catalogue pages, pages of three bands, pages of Han columns; selection, placeholders, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import layout as L

#: Words from which a page's text layer can be used.
LEAST_SPANS = 5
EMPTY_BOX = ("#", 50.0, 50.0, 100.0, 100.0, 0.0)


def fingerprinted(spans: DataFrame) -> DataFrame:
    """(page_key, two_column): whether a page has a text layer and two of the catalogue's labels in it."""
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda v: v["text"]), " ")
    g = spans.groupBy("page_key").agg(F.count("*").alias("n"), words.alias("words"))
    return g.select("page_key", ((F.col("n") >= LEAST_SPANS) & T.has_fingerprint(F.col("words"))).alias("two_column"))


def layer(mock: Column, pdf: Column, error: Column) -> Column:
    """A page's spans: the given ones where there are any, else the text layer's where it has enough words and was read without an error, else none."""
    usable = (F.size(pdf) >= LEAST_SPANS) & (F.coalesce(error, F.lit("")) == "")
    return F.when(F.size(mock) > 0, mock).when(usable, pdf).otherwise(F.slice(F.coalesce(mock, pdf), 1, 0))


def han_side(mock: Column, cropped: Column, whole: Column, error: Column) -> Column:
    """A page's Han detections: the given ones, else those of the crop, else those of the whole page; none where reading failed."""
    found = F.coalesce(mock, F.when(F.coalesce(error, F.lit("")) == "", F.coalesce(cropped, whole)))
    return F.coalesce(found, F.slice(F.coalesce(mock, cropped, whole), 1, 0))


def right_side(spans: DataFrame, splits: DataFrame) -> DataFrame:
    """Spans whose centre is right of the page's split, without mangled Han text and noise."""
    x = spans.join(splits, "page_key").where((F.col("x0") + F.col("x1")) / 2 >= F.col("split")).drop("split")
    return x.where(~T.is_garbage(F.col("text")) & ~T.is_noise(F.col("text")))


def left_side(detections: DataFrame, edges: DataFrame) -> DataFrame:
    """Detections whose centre is left of the page's edge; all of a page whose edge is not positive."""
    x = detections.join(edges, "page_key")
    return x.where((F.col("crop_x") <= 0) | ((F.col("x0") + F.col("x1")) / 2 < F.col("crop_x"))).drop("crop_x")


def bands(detections: DataFrame) -> DataFrame:
    """(page_key, dets): a page's Han detections in reading order of rows: by centre, then from the left."""
    x = detections.withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
    return x.groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("cy", "x0", "ord", "text"))).alias("dets"))


def in_band(dets: Column, y0: Column, y1: Column) -> Column:
    """The texts of the detections whose centre lies within a band, put together."""
    return F.coalesce(F.array_join(F.transform(F.filter(dets, lambda d: (d["cy"] >= y0) & (d["cy"] <= y1)), lambda d: d["text"]), ""), F.lit(""))


def two_column(spans: DataFrame, detections: DataFrame) -> DataFrame:
    """Records of catalogue pages: (page_key, line_no, entry_no, ngay, to_tap, loai, xuat_xu, de_tai, han, meaning, han_bbox, meaning_bbox).

    The text layer (page_key, ord, text, x0, y0, x1, y1) right of the gutter gives lines, entries and their fields; an entry's Han text
    is what stands left of the Vietnamese text (detections with conf), in the entry's band below its heading, else in its whole
    band. A page without entries gives no record. All steps but the reading of patterns are groups of one page.
    """
    splits = L.gutter(spans)
    edges = L.crop_edge(spans, splits)
    e = L.entries(L.lines(right_side(spans, splits)))
    bounds = e.groupBy("page_key", "entry").agg(F.min_by("y0", "line_no").alias("y0"), F.max_by("y1", "line_no").alias("y1"), F.max_by("heading_y1", F.when(F.col("heading_y1").isNotNull(), F.col("line_no"))).alias("below"), F.max("hint").alias("hint"))
    han = left_side(L.without_noise(detections), edges).where(T.cjk_ratio(F.col("text")) >= 0.34)
    width = spans.groupBy("page_key").agg(F.max("x1").alias("width"))
    j = bounds.join(L.entry_fields(e), ["page_key", "entry"], "left").join(bands(han), "page_key", "left").join(edges, "page_key").join(width, "page_key")
    top = F.when(F.coalesce("below", F.lit(0.0)) != 0, F.col("below")).otherwise(F.col("y0"))
    j = j.withColumn("top", top).withColumn("inner", in_band(F.col("dets"), F.col("top"), F.col("y1")))
    whole = (F.col("inner") == "") & (F.col("top") > F.col("y0"))
    j = j.withColumn("han", F.when(whole, in_band(F.col("dets"), F.col("y0"), F.col("y1"))).otherwise(F.col("inner"))).withColumn("top", F.when(whole, F.col("y0")).otherwise(F.col("top")))
    return j.select(
        "page_key", F.col("entry").cast("int").alias("line_no"), F.coalesce("entry_no", "hint").alias("entry_no"), "ngay", "to_tap", "loai", "xuat_xu", "de_tai", "han", F.coalesce("meaning", F.lit("")).alias("meaning"),
        F.array(F.lit(0.0), "top", "crop_x", "y1").alias("han_bbox"), F.array("crop_x", "y0", "width", "y1").alias("meaning_bbox"),
    )


def record_id(prefix: Column, page: Column, line: Column) -> Column:
    return F.format_string("%s.%03d.%02d", prefix, page, line)


def column_records(boxes: DataFrame, noise: bool = False) -> DataFrame:
    """Records of pages of Han columns: (page_key, line_no, han, han_bbox), a row for each column from the right; noise is left out unless wanted."""
    x = boxes if noise else L.without_noise(boxes)
    p = x.join(L.columns(x), ["page_key", "ord"])
    box = F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("han_bbox")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_idx", "text"))), lambda v: v["text"]), "")
    return p.groupBy("page_key", "column_id").agg(text.alias("han"), box).select("page_key", (F.col("column_id") + 1).alias("line_no"), "han", "han_bbox")


def band_records(boxes: DataFrame) -> DataFrame:
    """Records of pages of three bands: (page_key, line_no, han, phonetic, meaning); noise stays."""
    x = boxes.join(L.columns(boxes), ["page_key", "ord"])
    return L.three_blocks(x).select("page_key", (F.col("column_id") + 1).alias("line_no"), "han", "phonetic", "meaning")


def selected(pages: DataFrame, spec: Column, targets: Column | None = None) -> DataFrame:
    """Pages that a list names (all where it names none), with the page their records belong to: its target, else the page itself."""
    x = pages.withColumn("_pages", T.page_filter(spec))
    x = x.where(F.col("_pages").isNull() | F.array_contains("_pages", F.col("page"))).drop("_pages")
    map_ = F.lit(None).cast("map<int,int>") if targets is None else T.page_targets(spec, targets)
    return x.withColumn("target", F.coalesce(F.try_element_at(map_, F.col("page")), F.col("page")))


def with_placeholders(pages: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """``records`` and, for each page that has none, a blank one on line 1; ``placeholder`` marks those."""
    have = records.select(*keys).distinct()
    blank = pages.select(*keys).distinct().join(have, keys, "left_anti").withColumn("line_no", F.lit(1))
    rest = [c for c in records.columns if c not in (*keys, "line_no")]
    blank = blank.select(*keys, "line_no", *(F.lit(None).cast(records.schema[c].dataType).alias(c) for c in rest), F.lit(True).alias("placeholder"))
    return records.select(*keys, "line_no", *rest, F.lit(False).alias("placeholder")).unionByName(blank)


def with_empty_box(pages: DataFrame, blocks: Column) -> DataFrame:
    """(keys, i, text, x0, y0, x1, y1, conf): a page's boxes; a page without boxes has one that stands for none."""
    from vellum.functions.geometry import polygon_bounds

    made = F.transform(blocks, lambda b: F.struct(b["text"].alias("text"), polygon_bounds(b["box"]).alias("p"), b["confidence"].alias("conf")))
    x = pages.select(*pages.columns, F.posexplode_outer(made).alias("i", "b"))
    text, *box, conf = EMPTY_BOX
    none = F.col("b").isNull()
    names = ("x0", "y0", "x1", "y1")
    cols = [F.when(none, F.lit(v)).otherwise(F.col(f"b.p.{n}")).alias(n) for n, v in zip(names, box)]
    return x.select(*pages.columns, F.coalesce("i", F.lit(0)).alias("i"), F.when(none, text).otherwise(F.col("b.text")).alias("text"), *cols, F.when(none, conf).otherwise(F.col("b.conf")).alias("conf"))


def payload_blocks(payload: Column) -> Column:
    """ARRAY<STRUCT<text, confidence, box>> of a recogniser's JSON, in the form of arrays side by side or of a list of rows; no text, no block."""
    v = F.try_parse_json(payload)
    res = lambda n, kind: F.coalesce(F.try_variant_get(v, f"$.res.{n}", kind), F.try_variant_get(v, f"$.{n}", kind))
    texts, scores = res("rec_texts", "array<string>"), res("rec_scores", "array<double>")
    polys = F.coalesce(res("rec_polys", "array<array<array<double>>>"), res("dt_polys", "array<array<array<double>>>"))
    at = lambda a, i: F.try_element_at(a, i + 1)
    new = F.transform(texts, lambda t, i: F.struct(t.alias("text"), F.coalesce(at(scores, i), F.lit(0.0)).alias("confidence"), at(polys, i).alias("box")))
    rows = F.try_variant_get(v, "$", "array<variant>")
    old = F.transform(rows, lambda r: F.struct(F.try_variant_get(r, "$[1][0]", "string").alias("text"), F.try_variant_get(r, "$[1][1]", "double").alias("confidence"), F.try_variant_get(r, "$[0]", "array<array<double>>").alias("box")))
    return F.filter(F.coalesce(new, old, F.array().cast("array<struct<text:string,confidence:double,box:array<array<double>>>>")), lambda b: F.coalesce(b["text"], F.lit("")) != "")


def matrix(pages: DataFrame, models: list[str], recognise: dict) -> DataFrame:
    """Answers of several models for the same pages, one after the other: each recogniser turns ``blocks`` into blocks."""
    out = None
    for name in models:
        x = pages.withColumn("model_name", F.lit(name)).withColumn("blocks", recognise[name](F.col("blocks")))
        out = x if out is None else out.unionByName(x)
    return out

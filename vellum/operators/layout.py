"""Reading order of scanned pages: columns, lines, gutters, entries, merged passes."""

from __future__ import annotations

from collections.abc import Callable
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

BOX = ("x0", "y0", "x1", "y1")
KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def by_page(df: DataFrame, columns_: list[str], run: Callable[[str, list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``run`` makes of each page's rows, for what depends on a page's order. Pages are gathered in the JVM and go to Python many to
    an Arrow batch; a page holds as many boxes as paper has room for."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")))

    def work(batches):
        for b in batches:
            out = [row for key, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for row in run(key, rows)]
            cols = list(map(list, zip(*out))) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(cols, kinds)], list(names))

    return df.groupBy("page_key").agg(F.collect_list(F.struct(*columns_)).alias("rows")).mapInArrow(work, schema)


def column_clusters(cx: list[float], width: list[float], alpha: float = 0.5, least: int = 1, merge: bool = True) -> list[tuple[float, list[int]]]:
    """Columns of boxes by greedy first fit on centres from right to left: (centre, members). A column's centre is the running mean
    of its members; neighbours within twice the threshold of the merged centre so far join it."""
    positive = [w for w in width if w > 0]
    limit = alpha * (median(positive) if positive else 40.0)
    columns: list[list] = []  # [sum, members]
    for i in sorted(range(len(cx)), key=lambda k: (-cx[k], k)):
        home = next((c for c in columns if abs(cx[i] - c[0] / len(c[1])) <= limit), None)
        if home is None:
            columns.append(home := [0.0, []])
        home[0] += cx[i]
        home[1].append(i)
    if merge and len(columns) > 1:
        columns.sort(key=lambda c: -c[0] / len(c[1]))
        joined = [columns[0]]
        for c in columns[1:]:
            last = joined[-1]
            if abs(c[0] / len(c[1]) - last[0] / len(last[1])) <= 2 * limit:
                last[0] += c[0]
                last[1] += c[1]
            else:
                joined.append(c)
        columns = joined
    kept = [(s / len(m), m) for s, m in columns if len(m) >= least]
    return sorted(kept, key=lambda c: -c[0])


def columns(boxes: DataFrame, alpha: float = 0.5, least: int = 1, merge: bool = True) -> DataFrame:
    """(page_key, ord, column_id, reading_idx, x_center) of boxes (page_key, ord, cx, cy, w). Boxes without a centre are left out; no boxes, no
    rows."""

    def run(key, rows):
        rows.sort(key=lambda r: r["ord"])
        out = []
        for column, (centre, members) in enumerate(column_clusters([r["cx"] for r in rows], [r["w"] or 0.0 for r in rows], alpha, least, merge)):
            for i in sorted(members, key=lambda k: rows[k]["cy"]):
                out.append((key, rows[i]["ord"], column, len(out), centre))
        return out

    return by_page(boxes.where("cx is not null and cy is not null"), ["ord", "cx", "cy", "w"], run, "page_key string, ord long, column_id int, reading_idx int, x_center double")


def lines(spans: DataFrame) -> DataFrame:
    """(page_key, line_no, text, y0, y1, first) of spans (page_key, ord, text, x0, y0, x1, y1): anchored line clustering.

    A span joins a line if its centre is within max(0.6 * upper median height, 3) of the line's first span. Spans come by centre, so only
    the latest line can match: a fold over the page's sorted array, all in SQL expressions.
    """
    x = spans.withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
    g = x.groupBy("page_key").agg(
        F.array_sort(F.collect_list(F.struct("cy", "x0", "ord", "text", "y0", "y1"))).alias("spans"), F.array_sort(F.collect_list(F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0")))).alias("heights")
    )
    height = F.coalesce(F.try_element_at("heights", (F.size("heights") / 2).cast("int") + 1), F.lit(10.0))
    g = g.withColumn("tolerance", F.greatest(height * 0.6, F.lit(3.0)))
    start = F.struct(F.lit(-1e18).alias("anchor"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("of"))

    def step(a, s):
        new = F.abs(s["cy"] - a["anchor"]) > F.col("tolerance")
        n = a["n"] + new.cast("int")
        return F.struct(F.when(new, s["cy"]).otherwise(a["anchor"]).alias("anchor"), n.alias("n"), F.concat(a["of"], F.array(n)).alias("of"))

    g = g.withColumn("of", F.aggregate("spans", start, step, lambda a: a["of"]))
    e = g.select("page_key", F.explode(F.arrays_zip("spans", "of")).alias("z")).select("page_key", "z.spans.*", F.col("z.of").alias("line"))
    made = e.groupBy("page_key", "line").agg(F.array_sort(F.collect_list(F.struct("x0", "cy", "ord", "text"))).alias("s"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    order = Window.partitionBy("page_key").orderBy("y0", "line")
    return made.select("page_key", F.row_number().over(order).alias("line_no"), F.array_join(F.transform("s", lambda v: v["text"]), " ").alias("text"), "y0", "y1", F.col("s")[0]["text"].alias("first"))


def gutter(spans: DataFrame) -> DataFrame:
    """(page_key, split): where a page's left column ends: the middle of the widest gap between sorted left edges that is over twice
    the upper median height and has 6 to 45 % of the spans before it; else 0.35 of the width, else the least edge less the height."""
    w = Window.partitionBy("page_key").orderBy("x0", "ord")
    x = spans.withColumn("i", F.row_number().over(w) - 1).withColumn("before", F.lag("x0").over(w))
    page = spans.groupBy("page_key").agg(
        F.count("*").alias("n"), F.max("x1").alias("width"), F.min("x0").alias("least"), F.array_sort(F.collect_list(F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0")))).alias("h")
    )
    page = page.withColumn("margin", F.coalesce(F.try_element_at("h", (F.size("h") / 2).cast("int") + 1), F.lit(10.0)))
    g = x.join(page, "page_key").withColumn("gap", F.col("x0") - F.col("before"))
    ok = (F.col("gap") > 2 * F.col("margin")) & (F.col("i") >= 6) & (F.col("i") <= 0.45 * F.col("n"))
    best = g.groupBy("page_key").agg(F.max(F.when(ok, F.struct("gap", (-F.col("i")).alias("k"), ((F.col("x0") + F.col("before")) / 2).alias("mid")))).alias("b"))
    j = page.join(best, "page_key")
    back = F.when(F.coalesce(F.col("width"), F.lit(0.0)) > 0, 0.35 * F.col("width")).otherwise(F.greatest(F.col("least") - F.col("margin"), F.lit(0.0)))
    return j.select("page_key", F.coalesce(F.col("b.mid"), back).alias("split"))


def entries(page_lines: DataFrame) -> DataFrame:
    """Lines with their entry (from 1): an entry starts at a date line on pages that have one, else at a bare number that no month or
    year follows. Lines before the first start are dropped."""
    page = Window.partitionBy("page_key")
    x = page_lines.withColumn("dated", F.max(F.col("text").rlike(T.DATE_LINE).cast("int")).over(page))
    number = F.col("first").rlike(T.ENTRY_NUMBER) & ~F.col("text").rlike(T.DATE_AFTER_NUMBER)
    start = F.when(F.col("dated") == 1, F.col("text").rlike(T.DATE_ANCHOR)).otherwise(number)
    x = x.withColumn("start", start.cast("int")).withColumn("entry", F.sum("start").over(page.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    hint = F.when((F.col("dated") == 0) & (F.col("start") == 1), F.regexp_extract("first", T.ENTRY_NUMBER, 1).try_cast("int"))
    rest = F.when(hint.isNotNull(), T.strip(F.regexp_replace("text", r"^\s*\d{1,4}\.?\s*", ""))).otherwise(F.col("text"))
    below = F.when(T.strip(F.col("text")).startswith("TRÍCH"), F.col("y1"))
    return x.where("entry > 0").select("page_key", "entry", "line_no", rest.alias("text"), hint.alias("hint"), "y0", "y1", below.alias("heading_y1"))


def entry_fields(lines_: DataFrame, *keys: str) -> DataFrame:
    """Metadata, meaning and number of each entry from its lines (keys, line_no, text, hint).

    A line is a date, a kind, a label's value or a heading, by the first rule that holds; the rest is kept. Kept lines before the first
    lead-in are positional (origin, then subject), from it on they are the meaning. The first value of a field wins.
    """
    keys = keys or ("page_key", "entry")
    t = F.col("text")
    rule = F.when(t.rlike(T.DATE_ANCHOR), "ngay").when(t.contains("Loại:"), "loai").when(T.label_of(t).isNotNull(), T.label_of(t)).when(T.is_heading(t), "heading").otherwise("body")
    value = F.when(rule == "ngay", T.strip(F.regexp_replace(t, T.DAY_PREFIX, ""))).when(rule == "loai", T.kind_of_entry(t)).when(rule == "body", t).otherwise(T.label_value(t))
    x = lines_.where(T.strip(t) != "").select(*keys, "line_no", "hint", "text", rule.alias("rule"), value.alias("value"))
    g = x.groupBy(*keys).agg(
        *(F.try_element_at(F.transform(F.array_sort(F.collect_list(F.when((F.col("rule") == n) & (F.col("value") != ""), F.struct("line_no", "value")))), lambda v: v["value"]), F.lit(1)).alias(n) for n in ("ngay", "to_tap", "loai", "xuat_xu", "de_tai")),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rule") == "body", F.struct("line_no", "text")))), lambda v: v["text"]).alias("body"),
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda v: v["text"]).alias("all_lines"),
        F.max("hint").alias("hint"),
    )
    at = F.array_position(F.transform("body", lambda b: b.rlike(T.LEAD_IN)), True)
    g = g.withColumn("at", at.cast("int"))
    before = F.when(F.col("at") > 1, F.slice("body", 1, F.col("at") - 1)).otherwise(F.array().cast("array<string>"))
    rest = F.when(F.col("at") > 0, F.slice("body", F.col("at"), F.size("body"))).otherwise(F.col("body"))
    g = g.withColumn("before", before).withColumn("rest", rest)
    origin = F.coalesce("xuat_xu", F.try_element_at("before", F.lit(1)))
    subject = F.coalesce("de_tai", F.when(F.size("before") > 1, F.array_join(F.slice("before", 2, F.greatest(F.size("before") - 1, F.lit(1))), " ")))
    meaning = T.strip(F.regexp_replace(F.array_join("rest", " "), r"(?U)\s{2,}", " "))
    return g.select(*keys, T.entry_number(F.col("all_lines"), F.col("hint")).alias("entry_no"), "ngay", "to_tap", "loai", origin.alias("xuat_xu"), subject.alias("de_tai"), meaning.alias("meaning"))


def crop_edge(spans: DataFrame, splits: DataFrame) -> DataFrame:
    """(page_key, crop_x): the least left edge of a Vietnamese word right of the split, less the upper median height; else the split."""
    x = spans.join(splits, "page_key")
    g = x.groupBy("page_key").agg(
        F.min(F.when(T.is_vietnamese_word(F.col("text")) & (F.col("x0") > F.col("split")), F.col("x0"))).alias("edge"), F.first("split").alias("split"), F.array_sort(F.collect_list(F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0")))).alias("h")
    )
    h = F.coalesce(F.try_element_at("h", (F.size("h") / 2).cast("int") + 1), F.lit(10.0))
    return g.select("page_key", F.when(F.col("edge").isNotNull(), F.greatest(F.col("edge") - h, F.lit(0.0))).otherwise(F.col("split")).alias("crop_x"))


def without_noise(detections: DataFrame) -> DataFrame:
    """Detections but those of low confidence that are mostly not Han; a null confidence is low."""
    return detections.where(~((F.coalesce("conf", F.lit(0.0)) < 0.5) & (T.cjk_ratio(F.col("text")) < 0.5)))


def three_blocks(boxes: DataFrame) -> DataFrame:
    """(page_key, column_id, han, phonetic, meaning) of boxes (page_key, ord, column_id, cy, text): thirds of a column by centre."""
    w = Window.partitionBy("page_key", "column_id")
    lo, hi = F.min("cy").over(w), F.max("cy").over(w)
    x = boxes.withColumn("rel", F.when(hi > lo, (F.col("cy") - lo) / (hi - lo)).otherwise(F.lit(0.0)))
    x = x.withColumn("band", F.when(F.col("rel") < 1 / 3, "han").when(F.col("rel") < 2 / 3, "phonetic").otherwise("meaning"))
    part = lambda b: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("band") == b, F.struct("cy", "ord", "text")))), lambda v: v["text"]), "").alias(b)
    return x.groupBy("page_key", "column_id").agg(part("han"), part("phonetic"), part("meaning"))


def column_texts(boxes: DataFrame) -> DataFrame:
    """(page_key, column_id, text): the texts of each column from top to bottom."""
    ordered = F.array_sort(F.collect_list(F.struct("reading_idx", "text")))
    return boxes.groupBy("page_key", "column_id").agg(F.array_join(F.transform(ordered, lambda v: v["text"]), "").alias("text"))


def overlaps(a: DataFrame, b: DataFrame, least: float = 0.25, cell: float = 200.0) -> DataFrame:
    """(page_key, a_ord, b_ord, iou) of boxes (page_key, ord, x0, y0, x1, y1) that overlap by ``least``.

    Boxes are put into the cells of a grid they touch and joined by page and cell, so only neighbours meet; a pair counts in the first cell
    both touch. No pairs of a whole page are made.
    """
    from vellum.functions.geometry import iou

    def cells(df: DataFrame, name: str) -> DataFrame:
        g = lambda c: F.floor(F.col(c) / cell).cast("int")
        box = F.struct("x0", "y0", "x1", "y1")
        x = df.where("x1 >= x0 and y1 >= y0").select("page_key", F.col("ord").alias(f"{name}_ord"), box.alias(name), F.explode(F.sequence(g("x0"), g("x1"))).alias("gx"), "y0", "y1")
        return x.select("page_key", f"{name}_ord", name, "gx", F.explode(F.sequence(g("y0"), g("y1"))).alias("gy"))

    j = cells(a, "a").join(cells(b, "b"), ["page_key", "gx", "gy"])
    first = (F.col("gx") == F.floor(F.greatest("a.x0", "b.x0") / cell)) & (F.col("gy") == F.floor(F.greatest("a.y0", "b.y0") / cell))
    return j.where(first).withColumn("iou", iou(F.col("a"), F.col("b"))).where(F.col("iou") >= least).select("page_key", "a_ord", "b_ord", "iou")


def matched(candidates: DataFrame) -> DataFrame:
    """(page_key, a_ord, b_ord, iou): one-to-one matches, each a in order takes its best b that is free. Greedy, so a page is one group."""

    def run(key, rows):
        rows.sort(key=lambda r: (r["a_ord"], -r["iou"], r["b_ord"]))
        used, done, out = set(), set(), []
        for r in rows:
            if r["a_ord"] not in done and r["b_ord"] not in used:
                done.add(r["a_ord"])
                used.add(r["b_ord"])
                out.append((key, r["a_ord"], r["b_ord"], r["iou"]))
        return out

    return by_page(candidates, ["a_ord", "b_ord", "iou"], run, "page_key string, a_ord long, b_ord long, iou double")


def unmatched(b: DataFrame, candidates: DataFrame) -> DataFrame:
    """Boxes of ``b`` that overlap no box of the other pass, taken or not."""
    return b.join(candidates.select("page_key", F.col("b_ord").alias("ord")).distinct(), ["page_key", "ord"], "left_anti")


def merged_passes(ch: DataFrame, latin: DataFrame) -> DataFrame:
    """(page_key, ord, text, conf, x0, y0, x1, y1, origin): Han and Latin passes over the same pages merged block by block; ord counts a page's
    blocks from top to bottom, then from the left; a block without a box stands at the top left."""
    from vellum.functions.geometry import script_choice

    c = overlaps(ch, latin)
    m = matched(c).select("page_key", F.col("a_ord").alias("ord"), "b_ord")
    l2 = latin.select("page_key", F.col("ord").alias("b_ord"), F.col("text").alias("l_text"), F.col("conf").alias("l_conf"), *(F.col(n).alias(f"l_{n}") for n in BOX))
    j = ch.join(m, ["page_key", "ord"], "left").join(l2, ["page_key", "b_ord"], "left")
    a, b = T.script_ratios(F.col("text")), T.script_ratios(F.coalesce("l_text", F.lit("")))
    pick = script_choice(a["cjk"], a["latin"], F.coalesce("conf", F.lit(0.0)), b["cjk"], b["latin"], F.col("l_conf"))
    kept = j.withColumn("origin", pick).select("page_key", *(F.when(F.col("origin") == "latin", F.col(f"l_{n}")).otherwise(F.col(n)).alias(n) for n in ("text", "conf", *BOX)), "origin")
    rest = unmatched(latin, c).select("page_key", "text", "conf", *BOX, F.lit("latin").alias("origin"))
    order = Window.partitionBy("page_key").orderBy(F.coalesce("y0", F.lit(0.0)), F.coalesce("x0", F.lit(0.0)), "origin", "text")
    return kept.unionByName(rest).withColumn("ord", F.row_number().over(order).cast("long")).select("page_key", "ord", "text", "conf", *BOX, "origin")


def page_text(items: DataFrame) -> DataFrame:
    """(page_key, text): items (page_key, ord, text, x0, y0, x1, y1) as lines from top to bottom. Horizontal lines cluster by running mean,
    vertical Han items stand alone; a wide gap within a line becomes a blank."""
    x = items.where(T.strip(F.coalesce("text", F.lit(""))) != "").where("x0 is not null and x1 is not null")
    x = x.select("page_key", "ord", T.strip(F.col("text")).alias("text"), "x0", "y0", "x1", F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)).alias("w"), F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)).alias("h"))
    share = T.script_ratios(F.col("text"))["cjk"]
    x = x.withColumn("cy", F.col("y0") + F.col("h") / 2).withColumn("vertical", (F.col("h") > 1.4 * F.col("w")) & (share >= 0.4))

    def run(key, rows):
        rows.sort(key=lambda r: (r["cy"], r["x0"], r["ord"]))
        out: list[tuple[float, int, str]] = []
        flat, upright = [r for r in rows if not r["vertical"]], [r for r in rows if r["vertical"]]
        limit = max(0.6 * sorted(r["h"] for r in flat)[len(flat) // 2], 4.0) if flat else 0.0
        groups: list[list] = []
        for r in flat:
            if groups and abs(r["cy"] - sum(q["cy"] for q in groups[-1]) / len(groups[-1])) <= limit:
                groups[-1].append(r)
            else:
                groups.append([r])
        for g in groups:
            at = sum(q["cy"] for q in g) / len(g)
            g.sort(key=lambda q: q["x0"])
            made = g[0]["text"]
            for p, q in zip(g, g[1:]):
                made += (" " if q["x0"] - p["x1"] > 0.35 * p["h"] else "") + q["text"]
            out.append((at, len(out), made))
        upright.sort(key=lambda r: ((r["x0"] + r["x1"]) / 2, r["y0"]))
        near = max(0.75 * sorted(r["x1"] - r["x0"] for r in upright)[len(upright) // 2], 24.0) if upright else 0.0
        standing: list[list] = []  # columns by running mean, from the left
        for r in upright:
            cx = (r["x0"] + r["x1"]) / 2
            if standing and abs(cx - sum((q["x0"] + q["x1"]) / 2 for q in standing[-1]) / len(standing[-1])) <= near:
                standing[-1].append(r)
            else:
                standing.append([r])
        for g in standing:
            for r in sorted(g, key=lambda q: q["y0"]):
                out.append((r["cy"], len(out), r["text"]))
        out.sort(key=lambda v: v[:2])
        return [(key, "\n".join(t for _, _, t in out if t))]

    return by_page(x, ["ord", "text", "x0", "y0", "x1", "h", "cy", "vertical"], run, "page_key string, text string")

"""Queries of page layout and their SQL."""

from pyspark.sql import functions as F

from vellum.operators import extraction as X
from vellum.operators import layout as L
from vellum.operators.corpus import versions
from vellum.tables import load

c = F.col


def key():
    return F.concat(c("source_doc"), F.lit("#"), c("page").cast("string"))


def spans(s, d):
    """Boxes of pages; a box without a document or page is on no page."""
    x = versions(load(s, d, "detections")).where("text is not null and bbox is not null and size(bbox) >= 4 and source_doc is not null and page is not null")
    return x.select(key().alias("page_key"), c("row_id").alias("ord"), "text", "conf", c("bbox")[0].alias("x0"), c("bbox")[1].alias("y0"), c("bbox")[2].alias("x1"), c("bbox")[3].alias("y1"))


def numbered(s, d):
    """Boxes of pages as those of catalogue pages: each page has its number as an entry's number above its right side."""
    x = spans(s, d)
    n = x.select("page_key").distinct().select("page_key", F.lit(-1).cast("long").alias("ord"), F.element_at(F.split("page_key", "#"), -1).alias("text"), F.lit(None).cast("double").alias("conf"), F.lit(300.0).alias("x0"), F.lit(-30.0).alias("y0"), F.lit(320.0).alias("x1"), F.lit(-20.0).alias("y1"))
    return x.unionByName(n)


def boxes(s, d):
    return spans(s, d).select("*", ((c("x0") + c("x1")) / 2).alias("cx"), ((c("y0") + c("y1")) / 2).alias("cy"), (c("x1") - c("x0")).alias("w"))


def placed(s, d):
    return boxes(s, d).join(L.columns(boxes(s, d)), ["page_key", "ord"])


def han(s, d):
    from vellum.functions.text import cjk_ratio

    return spans(s, d).where(cjk_ratio(c("text")) >= 0.34)


def latin(s, d):
    from vellum.functions.text import cjk_ratio

    return spans(s, d).where(cjk_ratio(c("text")) < 0.34)


def ocr_lines(s, d):
    x = versions(load(s, d, "ocr_results")).where("text is not null")
    x = x.select(c("row_id").cast("string").alias("page_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return x.select("page_key", "line_no", "text", F.element_at(F.split(F.trim("text"), " "), 1).alias("first"), c("line_no").cast("double").alias("y0"), (c("line_no") + 1).cast("double").alias("y1"))


QUERIES = {
    "column_clusters": lambda s, d: L.columns(boxes(s, d)).select("page_key", "ord", "column_id", "reading_idx", F.round("x_center", 6).alias("x_center")),
    "column_texts": lambda s, d: L.column_texts(placed(s, d)),
    "three_blocks": lambda s, d: L.three_blocks(placed(s, d)),
    "line_clustering": lambda s, d: L.lines(spans(s, d)).select("page_key", "line_no", "text", "y0", "y1"),
    "gutter_gap": lambda s, d: L.gutter(spans(s, d)).select("page_key", F.round("split", 6).alias("split")),
    "crop_edges": lambda s, d: L.crop_edge(spans(s, d), L.gutter(spans(s, d))).select("page_key", F.round("crop_x", 6).alias("crop_x")),
    "line_segmentation": lambda s, d: L.entries(ocr_lines(s, d)).select("page_key", "entry", "line_no"),
    "entry_fields": lambda s, d: L.entry_fields(L.entries(ocr_lines(s, d))),
    "noise_free_detections": lambda s, d: L.without_noise(spans(s, d)).select("page_key", "ord"),
    "iou_pairs": lambda s, d: L.overlaps(han(s, d), latin(s, d), 0.05).select("page_key", "a_ord", "b_ord", F.round("iou", 6).alias("iou")),
    "unmatched_anti": lambda s, d: L.unmatched(latin(s, d), L.overlaps(han(s, d), latin(s, d), 0.05)).select("page_key", "ord"),
    "dual_pass_merge": lambda s, d: L.merged_passes(han(s, d), latin(s, d)).select("page_key", "text", "conf", "x0", "y0", "x1", "y1", "origin"),
    "dual_pass_texts": lambda s, d: L.page_text(L.merged_passes(han(s, d), latin(s, d))),
    "page_texts": lambda s, d: L.page_text(spans(s, d)),
}

S = "(select source_doc || '#' || page page_key, row_id ord, text, conf, bbox[1] x0, bbox[2] y0, bbox[3] x1, bbox[4] y1 from (select distinct on (row_id) * from detections) where text is not null and bbox is not null and len(bbox) >= 4 and source_doc is not null and page is not null)"
_B = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_C = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}"
RATIO = f"case when length(regexp_replace(text, '{_B}', '', 'g')) = 0 then 0.0 else length(regexp_replace(text, '[^{_C}]', '', 'g')) / length(regexp_replace(text, '{_B}', '', 'g'))::double end"
PAIRS = f"""(select a.page_key, a.ord a_ord, b.ord b_ord,
  (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) /
  (greatest((a.x1 - a.x0) * (a.y1 - a.y0), 1) + greatest((b.x1 - b.x0) * (b.y1 - b.y0), 1) - (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) iou
  from {S} a join {S} b on a.page_key = b.page_key and least(a.x1, b.x1) > greatest(a.x0, b.x0) and least(a.y1, b.y1) > greatest(a.y0, b.y0)
  where {RATIO.replace('text', 'a.text')} >= 0.34 and {RATIO.replace('text', 'b.text')} < 0.34)"""
GAPS = f"""with h as (select page_key, coalesce(list_sort(list(y1 - y0) filter (where y1 > y0))[len(list(y1 - y0) filter (where y1 > y0)) // 2 + 1], 10.0) m, count(*) n, max(x1) w, min(x0) l from {S} group by 1),
g as (select page_key, x0, lag(x0) over w b, row_number() over w - 1 i from {S} window w as (partition by page_key order by x0, ord)),
k as (select g.page_key, (x0 + b) / 2 mid, row_number() over (partition by g.page_key order by x0 - b desc, i) r from g join h using (page_key) where x0 - b > 2 * m and i >= 6 and i <= 0.45 * n)"""

SQL = {
    "gutter_gap": GAPS + " select page_key, round(coalesce(mid, case when w > 0 then 0.35 * w else greatest(l - m, 0) end), 6) split from h left join (select * from k where r = 1) using (page_key)",
    "noise_free_detections": f"select page_key, ord from {S} where not (coalesce(conf, 0) < 0.5 and {RATIO} < 0.5)",
    "iou_pairs": f"select page_key, a_ord, b_ord, round(iou, 6) iou from {PAIRS} where iou >= 0.05",
    "unmatched_anti": f"select page_key, ord from {S} where {RATIO} < 0.34 and not exists (select 1 from {PAIRS} p where p.page_key = page_key and p.b_ord = ord and iou >= 0.05)",
}
SQL["unmatched_anti"] = f"select s.page_key, s.ord from {S} s left join (select distinct page_key, b_ord ord, 1 hit from {PAIRS} where iou >= 0.05) p on p.page_key = s.page_key and p.ord = s.ord where {RATIO.replace('text', 's.text')} < 0.34 and hit is null"

# Lines, entries, fields and records of pages in SQL, as parts of one query each: lines are a fold, in SQL a recursion from span to span.
HEIGHT = "coalesce(list_sort(list(y1 - y0) filter (where y1 > y0))[len(list(y1 - y0) filter (where y1 > y0)) // 2 + 1], 10.0)"
WB = r"(?:[^\p{L}\p{N}_]|$)"
ANCHOR = rf"(?i)^{_B}*(?:Ngày{_B}*[:：]?{_B}*)?[0-9]{{1,3}}{_B}+tháng(?:[^\p{{L}}\p{{N}}_].*)?[^\p{{L}}\p{{N}}_]năm{WB}"
DATED = ANCHOR.replace(f"(?:Ngày{_B}*[:：]?{_B}*)?", "")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"


def lines_sql(spans_: str) -> str:
    return f"""o as (select *, (y0 + y1) / 2 cy, row_number() over (partition by page_key order by (y0 + y1) / 2, x0, ord) n from {spans_}),
t as (select page_key, greatest({HEIGHT} * 0.6, 3.0) tol from {spans_} group by 1),
f as (select page_key, n, cy anchor, 1 line from o where n = 1 union all
  select o.page_key, o.n, case when abs(o.cy - f.anchor) > tol then o.cy else f.anchor end, f.line + (abs(o.cy - f.anchor) > tol)::int from f join o on o.page_key = f.page_key and o.n = f.n + 1 join t on t.page_key = f.page_key),
l as (select page_key, line, string_agg(text, ' ' order by x0, cy, ord) text, min(y0) y0, max(y1) y1, first(text order by x0, cy, ord) first from o join f using (page_key, n) group by 1, 2),
li as (select page_key, row_number() over (partition by page_key order by y0, line)::int line_no, text, y0, y1, first from l)"""


ENTRIES = f"""d as (select *, max(regexp_matches(text, '{DATED}')::int) over (partition by page_key) dated from li),
st as (select *, case when dated = 1 then regexp_matches(text, '{ANCHOR}') else regexp_matches(first, '^[0-9]{{1,4}}[.]?$') and not regexp_matches(text, '(?i)^[0-9]{{1,4}}{_B}+(tháng|năm|nhuận){WB}') end s from d),
en as (select *, (sum(s::int) over (partition by page_key order by line_no))::bigint entry, case when dated = 0 and s then regexp_extract(first, '^([0-9]{{1,4}})', 1)::int end hint from st),
e as (select page_key, entry, line_no, case when hint is not null then {strip(f"regexp_replace(text, '^{_B}*[0-9]{{1,4}}[.]?{_B}*', '')")} else text end text, hint, y0, y1, case when starts_with({strip("text")}, 'TRÍCH') then y1 end heading from en where entry > 0)"""

from vellum.functions import text as T  # noqa: E402

_LABEL = "case " + " ".join(f"when starts_with(text, '{a}') then '{b}'" for a, b in T.LABELS) + " end"
_VALUE = "case " + " ".join(f"when starts_with(text, '{a}') then {strip(f'substr(text, {len(a) + 1})')}" for a, b in T.LABELS) + " end"
KIND = rf"(?i)Loại{_B}*[:：]{_B}*(.+?)(?:{_B}+(?:Xuất|Xuấtxứ|Đề|Để|Tờ|TờI|Công|Ngày){WB}|$)"
HEAD = rf"(?i)^TRÍCH YẾU|^Công{_B}*[đĐ]ồng{WB}[^:：]*[:：]{_B}*$|^Công{_B}*[đĐ]ồng[:：]{_B}*$"
LEAD = rf"(?i)^(Chiếu|Chỉ{_B}*[Dd]ụ|Dụ|Sử|Tư|Truyền|Sai|Tấu|Phụng|Phê|Tư{_B}*di|Công{_B}*[đĐ]ồng{_B}+[^[:space:]]+){_B}*[:：]"
LOAI = "Lo[aạáàảãăắằ]i"
FIELDS = f"""r as (select *, case when regexp_matches(text, '{ANCHOR}') then 'ngay' when contains(text, 'Loại:') then 'loai' when {_LABEL} is not null then {_LABEL} when regexp_matches(text, '{HEAD}') then 'heading' else 'body' end rule from e where {strip("text")} <> ''),
v as (select *, case rule when 'ngay' then {strip(f"regexp_replace(text, '(?i)^{_B}*Ngày{_B}*[:：]?{_B}*', '')")} when 'loai' then nullif({strip(f"regexp_extract(text, '{KIND}', 1)")}, '') when 'body' then text else {_VALUE} end val from r),
g as (select page_key, entry, {", ".join(f"first(val order by line_no) filter (where rule = '{n}' and val <> '') f_{n}" for n in ("ngay", "to_tap", "loai", "xuat_xu", "de_tai"))},
  coalesce(list(text order by line_no) filter (where rule = 'body'), []) body, list(text order by line_no) al, max(hint) hint from v group by all),
b as (select *, list_position([regexp_matches(x, '{LEAD}') for x in body], true) lead from g),
fi as (select page_key, entry, hint, f_ngay ngay, f_to_tap to_tap, f_loai loai, coalesce(f_xuat_xu, case when lead > 1 then body[1] end) xuat_xu,
  coalesce(f_de_tai, case when lead > 2 then array_to_string(body[2:lead - 1], ' ') end) de_tai, {strip(rf"regexp_replace(array_to_string(case when lead > 0 then body[lead:] else body end, ' '), '{_B}{{2,}}', ' ', 'g')")} meaning,
  [x for x in al if regexp_matches(x, '{LOAI}')][1] wk, array_to_string(al, ' ') whole from b),
fe as (select *, coalesce(hint, case when wk is null then try_cast(nullif(regexp_extract(whole, '(?i)([0-9]{{1,4}}){_B}+Loại{_B}*[:：]', 1), '') as integer)
  when not regexp_matches(regexp_extract(wk, '^(.*?){LOAI}', 1), 'Tờ|Tập|/{_B}*[0-9]') then try_cast(nullif(regexp_extract(regexp_extract(wk, '^(.*?){LOAI}', 1), '([0-9]{{1,4}})', 1), '') as integer) end) entry_no from fi)"""
NUM = f"(select * from {S} union all select distinct page_key, -1, string_split(page_key, '#')[-1], null::double, 300.0, -30.0, 320.0, -20.0 from {S})"
OCR = "(select row_id::varchar page_key, i::int line_no, x text, string_split(trim(x), ' ')[1] first, i::double y0, i::double + 1 y1 from (select row_id, unnest(range(len(l))) i, unnest(l) x from (select row_id, string_split(text, chr(10)) l from (select distinct on (row_id) * from ocr_results) where text is not null)))"
SPLIT = "split as (" + GAPS + " select page_key, coalesce(mid, case when w > 0 then 0.35 * w else greatest(l - m, 0) end) split from h left join (select * from k where r = 1) using (page_key))"
VN = f"(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 2 and regexp_matches(lower(text), '[{T.VOWELS}]'))"
EDGE = f"edge as (select page_key, case when min(x0) filter (where {VN} and x0 > split) is not null then greatest(min(x0) filter (where {VN} and x0 > split) - {HEIGHT}, 0) else min(split) end crop_x from {S} join split using (page_key) group by 1)"
RIGHT = rf"""(select s.* from {S} s join split using (page_key) where (x0 + x1) / 2 >= split and {strip("text")} <> '' and not regexp_matches(text, '[#{{}}\[\]*&%~^<>|\\@=+]')
  and not (regexp_full_match({strip("text")}, '[0-9A-Za-zÀ-ỹ]{{1,3}}') and regexp_matches({strip("text")}, '[0-9]') and regexp_matches({strip("text")}, '[A-Za-zÀ-ỹ]')))"""
BAND = "coalesce(array_to_string([x.text for x in dets if x.cy >= {0} and x.cy <= y1], ''), '')"

QUERIES["two_column_records"] = lambda s, d: X.two_column(numbered(s, d), spans(s, d)).select("page_key", "line_no", "entry_no", "ngay", "to_tap", "loai", "xuat_xu", "de_tai", "han", "meaning", *(F.round(F.element_at(n, i + 1), 4).alias(f"{n[:1]}{i}") for n in ("han_bbox", "meaning_bbox") for i in range(4)))
QUERIES["fingerprint_layouts"] = lambda s, d: X.fingerprinted(spans(s, d))
QUERIES["han_column_records"] = lambda s, d: X.column_records(boxes(s, d)).select("page_key", "line_no", "han")
QUERIES["three_band_records"] = lambda s, d: X.band_records(boxes(s, d))

SQL["line_clustering"] = "with recursive " + lines_sql(S) + " select page_key, line_no, text, y0, y1 from li"
SQL["crop_edges"] = f"with {SPLIT}, {EDGE} select page_key, round(crop_x, 6) crop_x from edge"
SQL["line_segmentation"] = f"with li as {OCR}, {ENTRIES} select page_key, entry, line_no from e"
SQL["entry_fields"] = f"with li as {OCR}, {ENTRIES}, {FIELDS} select page_key, entry, entry_no, ngay, to_tap, loai, xuat_xu, de_tai, meaning from fe"
SQL["two_column_records"] = f"""with recursive num as {NUM}, {SPLIT.replace(S, "num")}, {EDGE.replace(S, "num")}, rs as {RIGHT.replace(S, "num")}, {lines_sql("rs")}, {ENTRIES}, {FIELDS},
bo as (select page_key, entry, arg_min(y0, line_no) y0, arg_max(y1, line_no) y1, arg_max(heading, line_no) filter (where heading is not null) below, max(hint) hint from e group by all),
han as (select page_key, list(struct_pack(cy := (y0 + y1) / 2, x0 := x0, ord := ord, text := text) order by (y0 + y1) / 2, x0, ord) dets from {S} join edge using (page_key)
  where not (coalesce(conf, 0) < 0.5 and {RATIO} < 0.5) and {RATIO} >= 0.34 and (crop_x <= 0 or (x0 + x1) / 2 < crop_x) group by 1),
w as (select page_key, max(x1) width from num group by 1),
j as (select bo.*, dets, crop_x, width, case when coalesce(below, 0) <> 0 then below else y0 end top, fe.* exclude (page_key, entry, hint) from bo left join fe using (page_key, entry) left join han using (page_key) join edge using (page_key) join w using (page_key)),
q as (select *, {BAND.format("top")} a, {BAND.format("y0")} c from j)
select page_key, entry::int line_no, coalesce(entry_no, hint) entry_no, ngay, to_tap, loai, xuat_xu, de_tai, case when a = '' and top > y0 then c else a end han, coalesce(meaning, '') meaning,
  0.0::double h0, round(case when a = '' and top > y0 then y0 else top end, 4) h1, round(crop_x, 4) h2, round(y1, 4) h3, round(crop_x, 4) m0, round(y0, 4) m1, round(width, 4) m2, round(y1, 4) m3 from q"""
SQL["fingerprint_layouts"] = f"select page_key, count(*) >= 5 and ({' + '.join(f'contains(lower(w), lower($${k}$$))::int' for k in T.FINGERPRINT)}) >= 2 two_column from (select page_key, string_agg(text, ' ' order by ord) w, unnest(range(1)) from {S} group by 1) join {S} using (page_key) group by page_key, w"

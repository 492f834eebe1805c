"""Queries of the text, geometry and id functions, and their SQL."""

from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import ids as I
from vellum.functions import text as T
from vellum.operators.corpus import versions
from vellum.tables import load

c = F.col


def rec(s, d):
    return versions(load(s, d, "records"))


def det(s, d):
    return versions(load(s, d, "detections")).where("text is not null")


def ocr(s, d):
    return versions(load(s, d, "ocr_results"))


def lines(s, d):
    return ocr(s, d).where("text is not null").select("row_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))


def page_list(s, d):
    """Page lists such as 3,5-8 made from order keys."""
    k = c("o_orderkey")
    return load(s, d, "orders").select(k, F.concat_ws(",", (k % 9 + 1).cast("string"), F.concat((k % 5 + 10).cast("string"), F.lit("-"), (k % 5 + 12).cast("string"))).alias("spec"))


def reply(s, d):
    """Model replies made from event properties: fenced, and broken for every third."""
    made = F.when(c("event_id") % 3 == 0, F.concat(F.lit("x "), F.substring("props", 1, 3))).otherwise(F.concat(F.lit("```json\n"), c("props"), F.lit("\n```")))
    return load(s, d, "events").select("event_id", made.alias("reply"))


def box_rows(s, d):
    return det(s, d).where("bbox is not null").select("row_id", G.box(c("bbox")).alias("b"), "bbox")


def boxes6(df):
    r = lambda v: F.round(v, 6)
    return df.select("row_id", r(c("b.cx")).alias("cx"), r(c("b.cy")).alias("cy"), r(c("b.w")).alias("w"), r(c("b.h")).alias("h"))


def landing(s, d):
    n = c("id")
    html = F.concat(F.lit("<html><h2>NLVNPF-0"), F.lpad((n % 900 + 100).cast("string"), 3, "0"), F.lit("</h2><dl><dt>Pages</dt><dd>"), (n % 7 + 2).cast("string"), F.lit("</dd></dl></html>"))
    return load(s, d, "jobs").select("id").distinct().select(n, html.alias("html"))


QUERIES = {
    "cjk_ratio": lambda s, d: det(s, d).select("row_id", F.round(T.cjk_ratio(c("text")), 6).alias("ratio")),
    "script_ratios": lambda s, d: det(s, d).select("row_id", F.round(T.script_ratios(c("text"))["cjk"], 6).alias("cjk"), F.round(T.script_ratios(c("text"))["latin"], 6).alias("latin")),
    "looks_latin": lambda s, d: det(s, d).select("row_id", T.looks_latin(c("text")).alias("latin")),
    "noise_filter": lambda s, d: det(s, d).where(~((F.coalesce("conf", F.lit(0.0)) < 0.5) & (T.cjk_ratio(c("text")) < 0.5))).select("row_id"),
    "han_majority": lambda s, d: det(s, d).where(T.cjk_ratio(c("text")) >= 0.34).select("row_id"),
    "garbage_tokens": lambda s, d: det(s, d).select("row_id", T.is_garbage(c("text")).alias("garbage"), T.is_noise(c("text")).alias("noise")),
    "vietnamese_words": lambda s, d: det(s, d).select("row_id", T.is_vietnamese_word(c("text")).alias("word")),
    "fingerprint_pages": lambda s, d: ocr(s, d).where("text is not null").select("row_id", T.has_fingerprint(c("text")).alias("two_column")),
    "entry_lines": lambda s, d: lines(s, d).select("row_id", "at", T.kind_of_entry(c("line")).alias("kind"), F.regexp_extract("line", T.NUMBER_KIND, 1).try_cast("int").alias("number")).where("kind is not null"),
    "date_lines": lambda s, d: lines(s, d).unionByName(rec(s, d).select("row_id", F.lit(-1).alias("at"), c("entry_meta.ngay").alias("line"))).where(c("line").rlike(T.DATE_ANCHOR)).select("row_id", "at"),
    "line_labels": lambda s, d: det(s, d).select("row_id", T.label_of(c("text")).alias("field"), T.label_value(c("text")).alias("value")).where("field is not null"),
    "metadata_fix": lambda s, d: ocr(s, d).where("text is not null").select("row_id", T.fix_page(c("text")).alias("fixed")),
    "safe_stems": lambda s, d: ocr(s, d).select("row_id", T.safe_stem(c("source_pdf")).alias("stem"), T.source_of_file(c("source_pdf")).alias("source")),
    "sentence_ids": lambda s, d: versions(load(s, d, "aligned_sentences")).select("row_id", T.parse_sentence_id(c("sentence_id")).alias("p")).select("row_id", "p.*"),
    "sentence_id_roundtrip": lambda s, d: versions(load(s, d, "aligned_sentences")).select("row_id", "sentence_id", T.parse_sentence_id(c("sentence_id")).alias("p")).select("row_id", "sentence_id", T.sentence_id(c("p.chapter"), c("p.page"), c("p.sentence")).alias("again")),
    "page_filter": lambda s, d: page_list(s, d).select("o_orderkey", T.page_filter(c("spec")).alias("pages")),
    "page_suffix": lambda s, d: page_list(s, d).select("o_orderkey", T.page_suffix(T.page_filter(F.element_at(F.split("spec", ","), -1))).alias("run"), T.page_suffix(T.page_filter(c("spec"))).alias("listed")),
    "retry_delay": lambda s, d: ocr(s, d).select("row_id", T.retry_delay(F.concat(F.lit("quota, retry in "), (c("row_id") % 40).cast("string"), F.lit(".5s"))).alias("seconds")),
    "batch_states": lambda s, d: load(s, d, "jobs").select("id", "updated_at", T.batch_state(F.concat(F.lit("JOB_STATE_"), F.when(c("status") == "done", "SUCCEEDED").otherwise(F.upper("status")))).alias("state")).distinct(),
    "passages": lambda s, d: rec(s, d).select("row_id", T.passage(F.coalesce("meaning", F.lit(""))).alias("passage")),
    "characters": lambda s, d: rec(s, d).where("han is not null").select("row_id", F.explode(T.characters(c("han"))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n")),
    "json_lenient_parse": lambda s, d: reply(s, d).select("event_id", I.json_field(c("reply"), "k", kind="int").alias("k")),
    "landing_volumes": lambda s, d: landing(s, d).select("id", T.volume_id(c("html")).alias("volume"), T.page_count(c("html")).alias("pages")),
    "landing_urls": lambda s, d: landing(s, d).select(T.volume_id(c("html")).alias("v"), F.explode(F.sequence(F.lit(1), T.page_count(c("html")))).alias("page")).select("v", "page", T.page_address(F.lit("https://example.org"), c("v"), c("page")).alias("url")).distinct(),
    "box_geometry": lambda s, d: boxes6(box_rows(s, d)),
    "box_to_pixels": lambda s, d: box_rows(s, d).select("row_id", G.to_pixels(F.transform("bbox", lambda v: v), F.lit(1000.0), F.lit(2000.0)).alias("px")),
    "page_scale": lambda s, d: box_rows(s, d).select("row_id", F.round(G.scaled(c("b.x0"), F.lit(144.0)), 6).alias("x0"), F.round(G.scaled(c("b.y1"), F.lit(144.0)), 6).alias("y1")),
    "block_bounds": lambda s, d: ocr(s, d).select("row_id", F.posexplode("blocks").alias("i", "b")).select("row_id", "i", G.polygon_bounds(c("b.box")).alias("p")).select("row_id", "i", "p.*"),
    "vertical_boxes": lambda s, d: det(s, d).where("bbox is not null").select("row_id", G.is_vertical(c("bbox")[2] - c("bbox")[0], c("bbox")[3] - c("bbox")[1], T.cjk_ratio(c("text"))).alias("vertical")),
    "upper_median": lambda s, d: box_rows(s, d).join(det(s, d).select("row_id", "source_doc", "page"), "row_id").groupBy("source_doc", "page").agg(F.collect_list("b.h").alias("h")).select("source_doc", "page", G.upper_median(c("h")).alias("h")),
    "interpolated_median": lambda s, d: box_rows(s, d).join(det(s, d).select("row_id", "source_doc", "page"), "row_id").groupBy("source_doc", "page").agg(F.round(F.median(F.when(c("b.w") > 0, c("b.w"))), 6).alias("w")),
    "point_ids": lambda s, d: ocr(s, d).select("row_id", I.point_id(c("doc_id"), c("model_name"), c("page_no"), "page").alias("point_id")),
}

D = "(select distinct on (row_id) * from detections where text is not null)"
O = "(select distinct on (row_id) * from ocr_results)"  # noqa: E741
L = f"(select row_id, unnest(range(len(l)))::int \"at\", unnest(l) line from (select row_id, string_split(text, chr(10)) l from {O} where text is not null))"
S = "(select distinct on (row_id) * from aligned_sentences)"
B = T.BLANK
CMP = f"regexp_replace(text, '{B}', '', 'g')"


def share(pattern: str) -> str:
    return f"case when length({CMP}) = 0 then 0.0 else length(regexp_replace({CMP}, '[^{pattern}]', '', 'g')) / length({CMP})::double end"


BOXES = f"(select row_id, source_doc, page, bbox, bbox[1] x0, bbox[2] y0, bbox[3] x1, bbox[4] y1 from {D} where bbox is not null and len(bbox) >= 4)"
SPEC = "(select o_orderkey, o_orderkey % 9 + 1 a, o_orderkey % 5 + 10 lo, o_orderkey % 5 + 12 hi from orders)"
ST = f"regexp_replace(text, '^{B}+|{B}+$', '', 'g')"
FIX = "line"
for _p, _by in T.PHRASES:
    FIX = f"regexp_replace({FIX}, '(?i){_p}', '{_by}', 'g')"
_h = "(select distinct id, id % 900 + 100 v, id % 7 + 2 n from jobs)"
LABEL = " ".join(f"when starts_with(text, '{a}') then '{b}'" for a, b in T.LABELS)
VALUE = " ".join(f"when starts_with(text, '{a}') then regexp_replace(substr(text, {len(a) + 1}), '^{B}+|{B}+$', '', 'g')" for a, b in T.LABELS)
GARB = r"[#{}\[\]*&%~^<>|\\@=+]"

SQL = {
    "cjk_ratio": f"select row_id, round({share(T.CJK)}, 6) ratio from {D}",
    "script_ratios": f"select row_id, round({share(T.CJK_BASIC)}, 6) cjk, round({share(T.LATIN)}, 6) latin from {D}",
    "looks_latin": f"select row_id, length({CMP}) > 0 and {share('A-Za-z0-9')} >= 0.6 latin from {D}",
    "noise_filter": f"select row_id from {D} where not (coalesce(conf, 0) < 0.5 and {share(T.CJK)} < 0.5)",
    "han_majority": f"select row_id from {D} where {share(T.CJK)} >= 0.34",
    "garbage_tokens": f"select row_id, {ST} = '' or regexp_matches(text, '{GARB}') garbage, {ST} = '' or (regexp_full_match({ST}, '[0-9A-Za-zÀ-ỹ]{{1,3}}') and regexp_matches(text, '[0-9]') and regexp_matches(text, '[A-Za-zÀ-ỹ]')) noise from {D}",
    "vietnamese_words": f"select row_id, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 2 and regexp_matches(lower(text), '[{T.VOWELS}]') word from {D}",
    "fingerprint_pages": f"select row_id, ({' + '.join(f'contains(lower(text), lower($${k}$$))::int' for k in T.FINGERPRINT)}) >= 2 two_column from {O} where text is not null",
    "date_lines": f"select row_id, \"at\" from (select * from {L} union all select row_id, -1, entry_meta.ngay from (select distinct on (row_id) * from records)) where regexp_matches(line, '(?i)^[[:space:]]*(?:Ngày[[:space:]]*[:：]?[[:space:]]*)?[0-9]{{1,3}}[[:space:]]+tháng([^\\p{{L}}\\p{{N}}_].*)?[^\\p{{L}}\\p{{N}}_]năm($|[^\\p{{L}}\\p{{N}}_])')",
    "line_labels": f"select row_id, case {LABEL} end field, case {VALUE} end \"value\" from {D} where case {LABEL} end is not null",
    "sentence_ids": f"select row_id, sentence_id[1:7] prefix, sentence_id[9:11]::int chapter, sentence_id[13:15]::int page, sentence_id[17:18]::int sentence from {S}",
    "sentence_id_roundtrip": f"select row_id, sentence_id, sentence_id again from {S}",
    "page_filter": f"select o_orderkey, [a::int, lo::int, (lo + 1)::int, hi::int] pages from {SPEC}",
    "page_suffix": f"select o_orderkey, '_p' || lo || '-' || hi run, case when a = lo - 1 then '_p' || a || '-' || hi else '_p' || a || '-' || lo || '-' || (lo + 1) || '-' || hi end listed from {SPEC}",
    "retry_delay": f"select row_id, (row_id % 40) + 0.5 \"seconds\" from {O}",
    "batch_states": "select distinct id, updated_at, case status when 'done' then 'succeeded' when 'failed' then 'failed' when 'running' then 'running' when 'pending' then 'pending' else 'unknown' end state from jobs",
    "passages": f"select row_id, case when t <> '' and not starts_with(t, 'passage:') and not starts_with(t, 'query:') then 'passage: ' || t else t end passage from (select row_id, regexp_replace(coalesce(meaning, ''), '^{B}+|{B}+$', '', 'g') t from (select distinct on (row_id) * from records))",
    "characters": "select ch, count(*) n from (select unnest(regexp_extract_all(han, '(?s).')) ch from (select distinct on (row_id) * from records) where han is not null) group by ch",
    "json_lenient_parse": "select event_id, case when event_id % 3 = 0 then null else cast(props->>'$.k' as integer) end k from events",
    "landing_volumes": f"select id, 'nlvnpf-0' || lpad(v::varchar, 3, '0') volume, n::int pages from {_h}",
    "landing_urls": f"select distinct 'nlvnpf-0' || v v, p::int page, 'https://example.org/site_media/nom/nlvnpf-0' || v || '/jpeg/nlvnpf-0' || v || '-' || lpad(p::varchar, 3, '0') || '.jpg' url from (select v, unnest(range(1, n + 1)) p from {_h})",
    "box_geometry": f"select row_id, round((x0 + x1) / 2, 6) cx, round((y0 + y1) / 2, 6) cy, round(x1 - x0, 6) w, round(y1 - y0, 6) h from {BOXES}",
    "page_scale": f"select row_id, round(x0 * 2, 6) x0, round(y1 * 2, 6) y1 from {BOXES}",
    "block_bounds": f"select row_id, i::int i, list_min([p[1] for p in b.box]) x0, list_min([p[2] for p in b.box]) y0, list_max([p[1] for p in b.box]) x1, list_max([p[2] for p in b.box]) y1 from (select row_id, unnest(range(len(blocks))) i, unnest(blocks) b from {O})",
    "vertical_boxes": f"select row_id, (bbox[4] - bbox[2]) > 1.4 * (bbox[3] - bbox[1]) and {share(T.CJK)} >= 0.4 vertical from {D} where bbox is not null",
    "upper_median": f"select source_doc, page, list_sort(list(y1 - y0))[len(list(y1 - y0)) // 2 + 1] h from {BOXES} group by all",
    "interpolated_median": f"select source_doc, page, round(quantile_cont(case when x1 > x0 then x1 - x0 end, 0.5), 6) w from {BOXES} group by all",
}

KIND = rf"(?i)Loại{B}*[:：]{B}*(.+?)(?:{B}+(?:Xuất|Xuấtxứ|Đề|Để|Tờ|TờI|Công|Ngày)(?:[^\p{{L}}\p{{N}}_]|$)|$)"
BASE = "regexp_replace(list_last(string_split(source_pdf, '/')), '(.)\\.[^.]*$', '\\1')"
#: The sum's error decides on ties, as in ``geometry.round_tenth``.
TENTH = "(case when {0} * 8 + {0} * 2 - floor({0} * 8 + {0} * 2) = 0.5 and ({0} * 8 - (({0} * 8 + {0} * 2) - (({0} * 8 + {0} * 2) - {0} * 8))) + ({0} * 2 - (({0} * 8 + {0} * 2) - {0} * 8)) <> 0 then floor({0} * 8 + {0} * 2) + (({0} * 8 - (({0} * 8 + {0} * 2) - (({0} * 8 + {0} * 2) - {0} * 8))) + ({0} * 2 - (({0} * 8 + {0} * 2) - {0} * 8)) > 0)::int else round_even({0} * 8 + {0} * 2, 0) end / 10)"


def uuid5_sql(name: str) -> str:
    """The name-based UUID of a text."""
    h = f"sha1(from_hex('{I.URL_NAMESPACE}') || encode({name}))"
    return f"(select h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[(ascii(h[17]) - case when h[17] >= 'a' then 87 else 48 end) % 4 + 1] || h[18:20] || '-' || h[21:32] from (select {h} h))"


SQL |= {
    "entry_lines": f"select row_id, \"at\", kind, number from (select row_id, \"at\", nullif(regexp_replace(regexp_extract(line, '{KIND}', 1), '^{B}+|{B}+$', '', 'g'), '') kind, try_cast(nullif(regexp_extract(line, '(?i)([0-9]{{1,4}}){B}+Loại{B}*[:：]', 1), '') as integer) number from {L}) where kind is not null",
    "metadata_fix": f"select row_id, coalesce(string_agg(t, chr(10) order by \"at\") filter (where t <> ''), '') fixed from (select row_id, \"at\", trim(regexp_replace({FIX}, ' {{2,}}', ' ', 'g')) t from {L}) group by row_id",
    "safe_stems": f"select row_id, coalesce(nullif(left(regexp_replace({BASE}, '[^A-Za-z0-9_.-]', '_', 'g'), 80), ''), 'page') stem, case when lower({BASE}) like '%chau%' or lower({BASE}) like '%châu%' then 'ChauBan' when lower({BASE}) like '%uctrai%' or lower({BASE}) like '%uc_trai%' then 'UcTraiTap' when {BASE} = '' then 'Unknown' else {BASE} end source from {O}",
    "box_to_pixels": f"""select row_id, case when x1 > x0 and y1 > y0 then [{", ".join(TENTH.format(v) for v in ("x0", "y0", "x1", "y1"))}] else [] end px from (select row_id, greatest(0.0, least(least(bbox[2], bbox[4]) / 1000 * 1000, 1000.0)) x0, greatest(0.0, least(greatest(bbox[2], bbox[4]) / 1000 * 1000, 1000.0)) x1,
  greatest(0.0, least(least(bbox[1], bbox[3]) / 1000 * 2000, 2000.0)) y0, greatest(0.0, least(greatest(bbox[1], bbox[3]) / 1000 * 2000, 2000.0)) y1 from {BOXES})""",
    "point_ids": f"select row_id, {uuid5_sql("concat_ws('|', doc_id, model_name, page_no::varchar, 'page', 'page')")} point_id from {O}",
}

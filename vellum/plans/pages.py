"""Queries of page selection, replies, batches and new records, and their SQL."""

from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import extraction as X
from vellum.operators import mutations as M
from vellum.operators import replies as P
from vellum.operators.corpus import current_records, versions
from vellum.operators.queue import latest
from vellum.plans import registry as R
from vellum.tables import load

c = F.col


def cur(s, d):
    return current_records(load(s, d, "records"))


def ocr(s, d):
    return versions(load(s, d, "ocr_results"))


def replies(s, d):
    """A page's records as a model would give them: fenced JSON with boxes in thousandths, an entry of no kind, and every third entry continuing the one before."""
    x = cur(s, d).where("job_id is not null and page between 1 and 999")
    box = F.when(F.size("han_bbox") == 4, F.array(c("han_bbox")[1], c("han_bbox")[0], c("han_bbox")[3], c("han_bbox")[2]))
    number = F.when(c("row_id") % 2 == 0, c("entry_no").cast("string"))
    e = F.struct("row_id", F.struct("han", c("meaning").alias("vietnamese"), box.alias("han_box"), number.alias("entry_no"), (c("row_id") % 3 == 0).alias("is_continuation"), F.struct(c("entry_meta.loai").alias("loai")).alias("meta")).alias("e"))
    g = x.groupBy("job_id", "page").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(e)), lambda v: v["e"]).alias("entries"))).alias("j"))
    text = F.concat(F.lit("```json\n"), F.regexp_replace("j", r"\]\}$", ",7,{}]}"), F.lit("\n```"))
    return g.select("job_id", F.lit("HVB_001").alias("prefix"), "page", F.lit(1000.0).alias("width"), F.lit(2000.0).alias("height"), text.alias("reply"))


def drawn(s, d):
    """Two boxes that a user draws on every page of a job."""
    x = cur(s, d).where("job_id is not null and page between 1 and 999").select("job_id", "page").distinct()
    x = x.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("box_no"))
    return x.select("job_id", "page", "box_no", F.when(c("box_no") == 1, "新").alias("han"), F.lit("").alias("meaning"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("han_bbox"), F.lit(None).cast("array<double>").alias("meaning_bbox"), F.lit(None).cast("string").alias("image_path"))


def links(s, d):
    """Links to a job's first record, to none, and to a record that is not there."""
    x = cur(s, d).where("row_id % 13 = 0")
    heads = cur(s, d).groupBy("job_id").agg(F.max("human_id").alias("last"))
    named = F.when(c("row_id") % 3 == 0, c("last")).when(c("row_id") % 3 == 1, F.lit(None)).otherwise(F.lit("none.001.01"))
    return x.select("job_id", "human_id", "row_id").join(heads, "job_id").select("job_id", "human_id", named.alias("part_of"))


def polls(s, d):
    """What a service says of batches: jobs' states."""
    x = load(s, d, "jobs").select("id", c("updated_at").alias("at"), T.batch_state(F.concat(F.lit("STATE_"), F.when(c("status") == "done", "SUCCEEDED").otherwise(F.upper("status")))).alias("state"))
    return x.distinct()


def bounds(s, d):
    k = c("s_suppkey")
    return M.bounded(load(s, d, "supplier").select(k.cast("int").alias("id"), (k % 7 + 1).cast("int").alias("job_id"), (k % 50).cast("int").alias("page_start"), (k * 7 % 50).cast("int").alias("page_end")))


def wrapped(s, d):
    """Replies of several shapes: bare, wrapped, with other names, broken."""
    x = versions(load(s, d, "records")).select("row_id", F.coalesce("han", F.lit("")).alias("h"), F.coalesce("meaning", F.lit("")).alias("m"))
    k = c("row_id") % 4
    json = F.when(k == 0, F.to_json(F.struct(c("h").alias("han"), c("m").alias("vietnamese")))).when(k == 1, F.to_json(F.struct(F.struct(c("h").alias("text")).alias("Han_Text"), F.struct(c("m").alias("value")).alias("meaning")))).when(k == 2, F.to_json(F.struct(c("m").alias("viet")))).otherwise(c("h"))
    return x.select("row_id", F.concat(F.lit("```json\n"), json, F.lit("\n```")).alias("reply"))


QUERIES = {
    "autoscan_records": lambda s, d: P.page_records(replies(s, d), "job_id").select("job_id", "page", "human_id", "line_no", "entry_no", "han", "meaning", F.round(c("han_bbox")[0], 1).alias("x0"), F.round(c("han_bbox")[1], 1).alias("y0"), c("entry_meta.loai").alias("loai"), "continues"),
    "autoscan_apply": lambda s, d: P.applied(cur(s, d), replies(s, d).where("page % 2 = 0")).select("row_id", "job_id", "human_id", "page", "line_no", "review_status"),
    "open_pages": lambda s, d: P.open_pages(replies(s, d), cur(s, d)).select("job_id", "page"),
    "numeric_keys": lambda s, d: P.numbered(load(s, d, "jobs").select("id", F.when(c("id") % 3 == 0, F.concat(F.lit("x"), c("id"))).otherwise(c("id").cast("string")).alias("key")).distinct()).select("id", "page"),
    "enhanced_replies": lambda s, d: wrapped(s, d).select("row_id", P.enhanced(c("reply")).alias("r")).select("row_id", "r.han", "r.meaning"),
    "create_boxes": lambda s, d: M.new_records(cur(s, d), drawn(s, d)).select("job_id", "page", "human_id", "line_no", "han", "image_path", "source_doc", F.size("meaning_bbox").alias("n")),
    "link_resolution": lambda s, d: M.resolve_links(cur(s, d), links(s, d)),
    "insert_counts": lambda s, d: M.insert_counts(cur(s, d).where("row_id % 2 = 0"), cur(s, d), ["job_id", "human_id"]),
    "update_nulls": lambda s, d: M.update_rows(cur(s, d).select("row_id", "han", "phonetic"), cur(s, d).where("row_id % 11 = 0").select("row_id", F.lit("新").alias("han"), F.lit(None).cast("string").alias("phonetic")), ["row_id"], nulls=True),
    "batch_lifecycle": lambda s, d: M.followed(polls(s, d).select("id").distinct().select("id", F.when(c("id") % 5 == 0, "applied").otherwise("submitted").alias("state")), polls(s, d)).select("id", "state", "applied_at"),
    "assignment_bounds": bounds,
    "assignment_list": lambda s, d: bounds(s, d).orderBy("job_id", "page_start", "id").limit(200),
    "selected_pages": lambda s, d: X.selected(ocr(s, d).select("row_id", c("page_no").alias("page")), F.lit("3,1,20-40"), None).select("row_id", "page", "target"),
    "remapped_pages": lambda s, d: X.selected(ocr(s, d).select("row_id", c("page_no").alias("page")), F.lit("7,3,3,5"), F.lit("706,707,708")).select("row_id", "page", "target"),
    "placeholder_records": lambda s, d: X.with_placeholders(ocr(s, d).select("doc_id", "page_no").distinct(), ocr(s, d).where("coalesce(text, '') <> '' and coalesce(trim(error), '') = ''").select("doc_id", "page_no", F.lit(1).alias("line_no"), c("row_id").alias("made")), ["doc_id", "page_no"]).groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.bool_or("placeholder").alias("placeholder")),
    "placeholder_boxes": lambda s, d: X.with_empty_box(ocr(s, d).select("row_id", "blocks"), c("blocks")).select("row_id", "i", "text", "x0", "y1", "conf"),
    "error_envelope": lambda s, d: ocr(s, d).select("row_id", *(v.alias(n) for v, n in zip(R.guarded(c("text"), c("error")), ("text", "error")))),
    "mean_confidences": lambda s, d: ocr(s, d).select("row_id", F.round(G.mean_confidence(F.transform("blocks", lambda b: b["confidence"])), 4).alias("confidence")),
    "refine_gate": lambda s, d: ocr(s, d).where(T.refinable(True, c("error"), c("page_no"))).select("row_id"),
    "input_kinds": lambda s, d: ocr(s, d).select("row_id", T.kind_of_input(c("source_pdf")).alias("kind")),
    "three_block_sources": lambda s, d: ocr(s, d).select("row_id", T.is_three_block(F.concat(c("doc_id"), F.when(c("row_id") % 5 == 0, " Ức Trai").otherwise(""))).alias("three")),
    "metadata_blocks": lambda s, d: ocr(s, d).select("row_id", F.posexplode(T.fix_blocks(F.transform("blocks", lambda b: b.withField("source", F.lit("latin"))))).alias("i", "b")).select("row_id", "i", c("b.text").alias("text")),
    "payload_blocks": lambda s, d: ocr(s, d).where("size(blocks) > 0").select("row_id", F.posexplode(X.payload_blocks(payload())).alias("i", "b")).select("row_id", "i", c("b.text").alias("text"), F.round(c("b.confidence"), 6).alias("confidence"), F.size("b.box").alias("points")),
    "manifest_answers": lambda s, d: manifest_answers(s, d),
    "model_matrix": lambda s, d: X.matrix(ocr(s, d).select("row_id", "blocks"), ["a", "b"], {k: R.RECOGNISERS["blocks"] for k in "ab"}).groupBy("model_name").agg(F.count("*").alias("pages"), F.sum(F.size("blocks")).alias("blocks")),
    "sheet_formats": lambda s, d: versions(load(s, d, "aligned_sentences")).select("row_id", F.when(c("accuracy").isNotNull(), F.format_string("%.4f", "accuracy")).alias("share"), F.when(c("bbox_xmin").isNotNull(), F.format_string("%.1f", "bbox_xmin")).alias("x"), (F.row_number().over(_by_row()) % 2).alias("band")),
    "alignment_run": lambda s, d: alignment_run(s, d),
    "box_tenths": lambda s, d: load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", G.round_tenth(c("l_extendedprice") * c("l_discount")).alias("v")),
}


def _by_row():
    from pyspark.sql import Window

    return Window.partitionBy("chapter", "page").orderBy(c("row_id").asc_nulls_last())


def payload():
    """A recogniser's answer in one of its two forms."""
    new = F.to_json(F.struct(F.struct(F.transform("blocks", lambda b: b["text"]).alias("rec_texts"), F.transform("blocks", lambda b: b["confidence"]).alias("rec_scores"), F.transform("blocks", lambda b: b["box"]).alias("dt_polys")).alias("res")))
    old = F.concat(F.lit("["), F.array_join(F.transform("blocks", lambda b: F.concat(F.lit("["), F.to_json(b["box"]), F.lit(", ["), F.to_json(F.array(b["text"])).substr(F.lit(2), F.length(F.to_json(F.array(b["text"]))) - 2), F.lit(","), b["confidence"].cast("string"), F.lit("]]"))), ","), F.lit("]"))
    return F.when(c("row_id") % 2 == 0, new).otherwise(old)


def manifest_answers(s, d):
    """Pages of the manifests, whether or not a model has answered for them: a page's answers and its best confidence."""
    from vellum.sources.files import manifest

    m = manifest(ocr(s, d).select("doc_id", "source_pdf", "page_no", c("source_pdf").alias("object_key")).distinct())
    pages = m.select("doc_id", F.explode("pages").alias("p")).select("doc_id", c("p.page_no").alias("page_no")).distinct()
    good = ocr(s, d).where("coalesce(trim(error), '') = ''").groupBy("doc_id", "page_no").agg(F.count("*").alias("answers"), F.max("confidence").alias("best"))
    return pages.join(good, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("answers", F.lit(0)).alias("answers"), "best")


def alignment_run(s, d):
    """Columns of a page in order, each with the words that the reference sequence has at the same place, judged as a whole. A corpus may have more
    chapters than an id has room for: as in the SQL, numbers keep the digits that fit (so ids repeat from chapter 1000 on, row_id does not)."""
    from vellum.operators import alignment as A

    x = versions(load(s, d, "aligned_sentences"))
    at = F.row_number().over(_by_row()).alias("at")
    layout = x.select("row_id", "chapter", "page", "sn_chars", at)
    reference = x.select(c("chapter").alias("chapter_"), c("page").alias("page_"), "qn_words", at.alias("at_"))
    z = layout.join(reference, c("chapter").eqNullSafe(c("chapter_")) & c("page").eqNullSafe(c("page_")) & (c("at") == c("at_")))
    v = A.verdicts(A.aligned(z, "sn_chars", "qn_words", "row_id"), load(s, d, "similar_chars"), load(s, d, "translit"))
    g = v.groupBy("row_id").agg(F.count("*").alias("pairs"), F.round(F.avg(c("verdict").isin("BLACK", "GREEN").cast("int")), 6).alias("share"), F.max("distance").alias("distance"))
    part = lambda n, width: F.lpad(c(n).cast("string"), width, "0")
    id_ = F.concat(F.lit("HVH_004."), part("chapter", 3), F.lit("."), part("page", 3), F.lit("."), part("at", 2))
    return z.join(g, "row_id").select("row_id", id_.alias("sentence_id"), "pairs", "share", "distance")


R_ = "(select distinct on (row_id) * from records)"
CUR = f"(select * from {R_} where row_id in (select min(row_id) from records where human_id is not null group by job_id, human_id))"
O = "(select distinct on (row_id) * from ocr_results)"  # noqa: E741
_B = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ST = f"regexp_replace(coalesce(%s, ''), '^{_B}+|{_B}+$', '', 'g')"
BOXED = "(len(han_bbox) = 4 and least(greatest(han_bbox[1], 0), 1000) < least(greatest(han_bbox[3], 0), 1000) and han_bbox[2] < han_bbox[4] and han_bbox[2] < 1000)"
KEPT = f"""(select *, row_number() over (partition by job_id, page order by row_id) ln from {CUR} where job_id is not null and page between 1 and 999 and ({ST % 'han'} <> '' or {ST % 'meaning'} <> '' or coalesce({BOXED}, false)))"""
DONE = f"(select distinct job_id, page from {CUR} where review_status = 'verified' and page is not null)"
BND = "(select s_suppkey::int id, (s_suppkey % 7 + 1)::int job_id, least(s_suppkey % 50, s_suppkey * 7 % 50)::int page_start, greatest(s_suppkey % 50, s_suppkey * 7 % 50)::int page_end from supplier)"
PREV = f"(select row_id, job_id, human_id, lag(coalesce(nullif(part_of, ''), human_id)) over (partition by job_id order by page nulls first, line_no nulls last, row_id) previous from {CUR})"
POLL = "(select distinct id, updated_at \"at\", case status when 'done' then 'succeeded' when 'failed' then 'failed' when 'running' then 'running' when 'pending' then 'pending' else 'unknown' end state from jobs)"
DRAWN = f"(select job_id, page, unnest([1, 2]) box_no from (select distinct job_id, page from {CUR} where job_id is not null and page between 1 and 999))"
SRC = "(select distinct on (row_id) * from aligned_sentences)"
FIX = "text"
for _p, _by in T.PHRASES:
    FIX = f"regexp_replace({FIX}, '(?i){_p}', '{_by}', 'g')"

SQL = {
    "autoscan_records": f"""select job_id, page, 'HVB_001.' || lpad(page::varchar, 3, '0') || '.' || case when ln < 10 then '0' || ln else ln::varchar end human_id, ln::int line_no, coalesce(case when row_id % 2 = 0 then entry_no end, ln)::int entry_no, {ST % 'han'} han, {ST % 'meaning'} meaning,
  case when {BOXED} then round(han_bbox[1], 1) end x0, case when {BOXED} then round(least(han_bbox[2] * 2, 2000), 1) end y0, {ST % 'entry_meta.loai'} loai, row_id % 3 = 0 continues from {KEPT}""",
    "autoscan_apply": f"""select row_id, job_id, human_id, page, line_no, review_status from {CUR} r where not (coalesce(job_id is not null and page between 1 and 999 and page % 2 = 0, false) and not exists (select 1 from {DONE} v where v.job_id = r.job_id and v.page = r.page))
  union all select null, k.job_id, 'HVB_001.' || lpad(page::varchar, 3, '0') || '.' || case when ln < 10 then '0' || ln else ln::varchar end, page, ln::int, 'pending' from {KEPT} k where page % 2 = 0 and not exists (select 1 from {DONE} v where v.job_id = k.job_id and v.page = k.page)""",
    "open_pages": f"select job_id, page from (select distinct job_id, page from {CUR} where job_id is not null and page between 1 and 999) r where not exists (select 1 from {DONE} v where v.job_id = r.job_id and v.page = r.page)",
    "numeric_keys": "select distinct id, id::int page from jobs where id % 3 <> 0",
    "enhanced_replies": f"""select row_id, case when k < 2 and (h <> '' or m <> '') then h when k = 2 and m <> '' then '' when k = 3 then h when k = 0 then '{{"han":"","vietnamese":""}}' when k = 1 then '{{"Han_Text":{{"text":""}},"meaning":{{"value":""}}}}' else '{{"viet":""}}' end han,
  case when k = 3 then '' else m end meaning from (select row_id, row_id % 4 k, {ST % 'han'} h, {ST % 'meaning'} m from {R_})""",
    "create_boxes": f"""with f as (select job_id, coalesce(regexp_replace(arg_min(human_id, row_id), '\\.[^.]*\\.[^.]*$', ''), 'HVB_001') prefix, arg_min(source_doc, row_id) source_doc, arg_min(image_path, row_id) any_ from {CUR} group by all),
  p as (select job_id, page, coalesce(max(line_no), 0) ln, arg_min(nullif(image_path, ''), row_id) own from {CUR} group by all)
  select job_id, page, prefix || '.' || lpad(page::varchar, 3, '0') || '.' || case when ln + box_no < 10 then '0' || (ln + box_no) else (ln + box_no)::varchar end human_id, (ln + box_no)::int line_no, case when box_no = 1 then '新' else '' end han, coalesce(own, any_, '') image_path, coalesce(source_doc, '') source_doc, 4::int n
  from {DRAWN} join f using (job_id) join p using (job_id, page)""",
    "link_resolution": f"""with l as (select job_id, human_id, row_id, previous, case when row_id % 3 = 0 then last end named, row_id % 3 k from {PREV} join (select job_id, max(human_id) last from {CUR} group by all) using (job_id) where row_id % 13 = 0),
  h as (select l.*, case when k = 0 then coalesce(nullif(q.part_of, ''), q.human_id) when k = 1 then previous end head from l left join {CUR} q on q.job_id = l.job_id and q.human_id = l.named)
  select job_id, human_id, case when head <> human_id then head end part_of, case when k = 2 then 'no head' when head is null then 'no entry before' when head = human_id then 'itself' end problem from h""",
    "insert_counts": f"select count(*) filter (where row_id % 2 = 1 or job_id is null) inserted, count(*) filter (where row_id % 2 = 0 and job_id is not null) known from {CUR}",
    "update_nulls": f"select row_id, case when row_id % 11 = 0 then '新' else han end han, case when row_id % 11 <> 0 then phonetic end phonetic from {CUR}",
    "batch_lifecycle": f"""with p as (select id, min("at") filter (where state = 'succeeded') a, arg_max(state, struct_pack(a := "at", s := state)) last from {POLL} group by id)
  select id, case when id % 5 = 0 or a is not null then 'applied' when last = 'unknown' then 'running' else last end state, case when id % 5 <> 0 then a end applied_at from p""",
    "assignment_bounds": f"select * from {BND}",
    "assignment_list": f"select * from {BND} order by job_id, page_start, id limit 200",
    "selected_pages": f"select row_id, page_no page, page_no target from {O} where page_no in (1, 3) or page_no between 20 and 40",
    "remapped_pages": f"select row_id, page_no page, case page_no when 3 then 706 when 5 then 707 else 708 end target from {O} where page_no in (3, 5, 7)",
    "placeholder_records": f"select doc_id, page_no, greatest(count(*) filter (where coalesce(text, '') <> '' and coalesce(trim(error), '') = ''), 1) n, count(*) filter (where coalesce(text, '') <> '' and coalesce(trim(error), '') = '') = 0 placeholder from {O} group by all",
    "placeholder_boxes": f"""select row_id, i::int i, b.text text, list_min([p[1] for p in b.box]) x0, list_max([p[2] for p in b.box]) y1, b.confidence conf from (select row_id, unnest(range(len(blocks))) i, unnest(blocks) b from {O})
  union all select row_id, 0, '#', 50.0, 100.0, 0.0 from {O} where coalesce(len(blocks), 0) = 0""",
    "error_envelope": f"select row_id, case when coalesce(trim(error), '') <> '' then '' else coalesce(text, '') end text, case when coalesce(trim(error), '') <> '' then error end error from {O}",
    "mean_confidences": f"select row_id, round(coalesce(list_avg([x.confidence for x in blocks if x.confidence is not null]), 0), 4) confidence from {O}",
    "refine_gate": f"select row_id from {O} where coalesce(error, '') = '' and page_no <= 10",
    "input_kinds": f"select row_id, case when lower(source_pdf) like '%.pdf' then 'pdf' when regexp_matches(lower(source_pdf), '\\.(png|jpg|jpeg|tif|tiff|bmp|webp)$') then 'image' end kind from {O}",
    "three_block_sources": f"select row_id, row_id % 5 = 0 or regexp_matches(lower(doc_id), 'uctrai|uc trai') three from {O}",
    "metadata_blocks": f"select row_id, i::int i, trim(regexp_replace({FIX}, ' {{2,}}', ' ', 'g')) text from (select row_id, unnest(range(len(blocks))) i, unnest([coalesce(x.text, '') for x in blocks]) text from {O})",
    "payload_blocks": f"select row_id, (row_number() over (partition by row_id order by i) - 1)::int i, b.text text, round(b.confidence, 6) confidence, len(b.box)::int points from (select row_id, unnest(range(len(blocks))) i, unnest(blocks) b from {O} where len(blocks) > 0) where b.text <> ''",
    "manifest_answers": f"select doc_id, page_no, count(*) filter (where coalesce(trim(error), '') = '') answers, max(confidence) filter (where coalesce(trim(error), '') = '') best from {O} where doc_id is not null group by all",
    "model_matrix": f"select unnest(['a', 'b']) model_name, count(*) pages, coalesce(sum(len(blocks)), 0)::bigint blocks from {O}",
    "sheet_formats": f"select row_id, printf('%.4f', accuracy) share, printf('%.1f', bbox_xmin) x, (row_number() over (partition by chapter, page order by row_id) % 2)::int band from {SRC}",
    "box_tenths": """with v as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_extendedprice * l_discount) * 8 a, (l_extendedprice * l_discount) * 2 b from lineitem), s as (select *, a + b s from v), e as (select *, (a - (s - (s - a))) + (b - (s - a)) r, floor(s) f from s)
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when s - f = 0.5 and r > 0 then f + 1 when s - f = 0.5 and r < 0 then f else round_even(s, 0) end / 10 v from e""",
}

from vellum.plans.alignment import SEQ_V as _V  # noqa: E402

# Layout and reference are columns of the same pages in the same order, so each column meets its own words.
SQL["alignment_run"] = f"""with v as (select row_id, count(*) pairs, round(avg((not gap and (black or len(g) > 0))::int), 6) share from {_V} group by row_id)
  select row_id, 'HVH_004.' || lpad(chapter::varchar, 3, '0') || '.' || lpad(page::varchar, 3, '0') || '.' || lpad((row_number() over (partition by chapter, page order by row_id))::varchar, 2, '0') sentence_id, pairs, share, pairs::int distance from {SRC} join v using (row_id)"""

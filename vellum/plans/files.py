"""Queries that write files in the engine's formats from the tables and read them again, and their SQL over the tables."""

from pyspark.sql import functions as F

from vellum.operators import extraction as X
from vellum.operators.corpus import current_records, folded, versions
from vellum.sources import files as S
from vellum.tables import load, scratch

c = F.col


def lines_file(df, what):
    """A text file of a column's values, read again with the place of each line."""
    path = scratch(df.sparkSession, what)
    S.write_lines(df, path)
    return S.numbered_lines(df.sparkSession, path)


def similar(s, d):
    """A dictionary file: a line for each character with its look-alikes by rank, a comment and lines that are skipped."""
    x = load(s, d, "similar_chars").where("sn is not null").distinct().groupBy("sn").agg(F.array_sort(F.collect_list(F.struct("rank_no", "similar_char"))).alias("v"))
    text = F.concat("sn", F.lit(": "), F.array_join(F.transform("v", lambda v: v["similar_char"]), " "))
    return S.dictionary(lines_file(x.select(F.explode(F.array(F.lit("# note"), F.lit(""), F.lit("no colon"), text)).alias("value")), "similar"))


def syllables(s, d):
    x = load(s, d, "translit").where("qn is not null").groupBy(F.lower(F.trim("qn")).alias("k")).agg(F.array_sort(F.collect_set("sn")).alias("v"))
    return S.dictionary(lines_file(x.select(F.concat(F.lit("  "), F.upper("k"), F.lit(" :"), F.array_join("v", "  ")).alias("value")), "syllables"), lower_keys=True)


def reading_file(s, d):
    """A CSV of characters with their readings as a list, quoted for every other character."""
    x = load(s, d, "translit").where("qn is not null and sn is not null").groupBy("sn").agg(F.array_sort(F.collect_set(F.lower(F.trim("qn")))).alias("v"))
    bare = F.concat(F.lit("["), F.array_join("v", ", "), F.lit("]"))
    quoted = F.concat(F.lit("["), F.array_join(F.transform("v", lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
    path = scratch(s, "readings")
    x.select(c("sn").alias("char"), F.when(F.ascii("sn") % 2 == 0, quoted).otherwise(bare).alias("hanviet"), F.lit("").alias("pinyin")).write.option("header", True).csv(path)
    return S.reading_table(s, path)


def record_lines(s, d):
    path = scratch(s, "records")
    S.write_records(versions(load(s, d, "records")), path)
    return S.read_records(s, path)


def page_files(s, d):
    """Each model's answer for a page as a line of JSON, and back."""
    x = versions(load(s, d, "ocr_results")).where("doc_id is not null and page_no is not null and model_name is not null")
    x = x.groupBy("doc_id", "page_no", "model_name").agg(F.min_by(F.struct("text", "confidence"), "row_id").alias("r"))
    rows = x.select("doc_id", "page_no", "model_name", "r.*")
    path = scratch(s, "pages")
    S.write_ocr_pages(rows, path)
    back = s.read.schema("doc_id STRING, page_no INT, model_name STRING, text STRING, confidence DOUBLE").json(path)
    return back.select("doc_id", "page_no", "model_name", "text", "confidence")


def manifests(s, d):
    x = versions(load(s, d, "ocr_results")).where("doc_id is not null and page_no is not null").select("doc_id", "source_pdf", "page_no", c("source_pdf").alias("object_key")).distinct()
    path = scratch(s, "manifests")
    S.manifest(x).write.json(path)
    return s.read.schema(S.MANIFEST).json(path)


def results(s, d):
    """Result lines of a batch: good ones, errors (also null ones), answers without parts, junk and blank lines."""
    x = versions(load(s, d, "ocr_results")).where("text is not null")
    k = c("row_id") % 5
    key, text = c("row_id").cast("string").alias("key"), c("text").alias("text")
    parts = F.to_json(F.struct(key, F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.substring("text", 1, 3).alias("text")), F.struct(F.substring("text", 4, 1 << 30).alias("text"))).alias("parts")).alias("content"))).alias("candidates")).alias("response")))
    bare = F.to_json(F.struct(key, F.struct(text).alias("response")))
    wrong = F.concat(F.lit('{"error": null, "key": "'), c("row_id"), F.lit('", "response": {"text": "x"}}'))
    line = F.when(k == 0, parts).when(k == 1, bare).when(k == 2, wrong).when(k == 3, "junk").otherwise(" ")
    return S.batch_results(lines_file(x.select(line.alias("value")), "results"))


def requests(s, d):
    x = versions(load(s, d, "ocr_results")).select(c("row_id").cast("string").alias("key"), F.encode(F.coalesce("source_pdf", F.lit("")), "UTF-8").alias("image"))
    back = lines_file(S.batch_requests(x, "read", "be exact"), "requests").where("value <> ''")
    v = F.parse_json("value")
    get = lambda p: F.try_variant_get(v, p, "string")
    return back.select(get("$.key").alias("key"), get("$.request.contents[0].parts[0].text").alias("prompt"), F.decode(F.unbase64(get("$.request.contents[0].parts[1].inline_data.data")), "UTF-8").alias("image"), get("$.request.generation_config.temperature").alias("temperature"))


def layouts(s, d):
    x = versions(load(s, d, "aligned_sentences")).select(F.concat_ws("#", "chapter", "page").alias("page_key"), c("column_no").alias("column_id"), F.posexplode("sn_chars").alias("reading_idx", "text"))
    path = scratch(s, "layout")
    S.nested_layout(x).write.json(path)
    return S.read_layout(s, path)


def corpus_file(s, d):
    """Chapters, pages and sentences as XML and back: a row for each sentence."""
    from vellum.operators import alignment as A
    from vellum.plans.alignment import rows

    v = A.verdicts(A.aligned(rows(s, d), "sn_chars", "qn_words", "row_id"), load(s, d, "similar_chars"), load(s, d, "translit"))
    pairs = v.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sn", "qn", c("verdict").alias("status"), c("correction").alias("corrected")))).alias("pairs"))
    x = rows(s, d).where("accuracy is not null and bbox_xmin is not null").join(pairs, "row_id")
    path = scratch(s, "xml")
    S.corpus_xml(S.chapters(x), path, "chapter")
    back = s.read.format("xml").option("rowTag", "chapter").option("attributePrefix", "_").schema(XML).load(path)
    e = back.select(c("_number").alias("chapter"), F.explode("page").alias("p")).select("chapter", c("p._number").alias("page"), F.explode("p.sentence").alias("s"))
    return e.select("chapter", "page", c("s._id").alias("sentence_id"), c("s._accuracy").alias("accuracy"), c("s.bbox._x_min").alias("x_min"), c("s.han").alias("han"), F.size("s.alignment.pair").alias("pairs"))


XML = "_id STRING, _number INT, page ARRAY<STRUCT<_id: STRING, _number: INT, sentence: ARRAY<STRUCT<_id: STRING, _column: INT, _accuracy: STRING, _edit_distance: INT, bbox: STRUCT<_x_min: STRING, _y_min: STRING, _x_max: STRING, _y_max: STRING>, han: STRING, quocngu: STRING, alignment: STRUCT<pair: ARRAY<STRUCT<_sn: STRING, _qn: STRING, _status: STRING, _corrected: STRING>>>>>>>"


def export_lines(s, d):
    """Merged entries of a job as JSON lines, and back."""
    path = scratch(s, "export")
    x = folded(load(s, d, "records"), True, 1 << 30).select("job_id", "human_id", "han", "meaning", "parts")
    S.write_lines(x.select(F.to_json(F.struct("*")).alias("value")), path)
    return s.read.schema("job_id BIGINT, human_id STRING, han STRING, meaning STRING, parts INT").json(path)


def text_layers(s, d):
    """(page_key, n): the words of each page's text layer, none below the least; pages of even number have given words of their own."""
    from vellum.plans.layout import spans

    x = spans(s, d).groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("pdf"))
    mock = F.when(F.size("pdf") % 2 == 0, F.slice("pdf", 1, 1)).otherwise(F.slice("pdf", 1, 0))
    return x.select("page_key", F.size(X.layer(mock, c("pdf"), F.lit(None).cast("string"))).alias("n"))


def validation(s, d):
    x = versions(load(s, d, "aligned_sentences"))
    return S.validated(x, x, "sentence_id", r"^[A-Z]{3}_\d{3}\.\d{3}\.\d{3}\.\d{2}$")


QUERIES = {
    "similar_file": similar,
    "syllable_file": syllables,
    "reading_file": lambda s, d: S.inverted(reading_file(s, d)),
    "first_readings": lambda s, d: S.first_readings(reading_file(s, d)),
    "record_lines": lambda s, d: record_lines(s, d).select("row_id", "job_id", "page", "han", "meaning", "part_of", F.size("han_bbox").alias("n")),
    "page_files": page_files,
    "manifest_files": lambda s, d: manifests(s, d).select("doc_id", "source_pdf", "total_pages", F.size("pages").alias("n")),
    "batch_result_lines": results,
    "batch_request_lines": requests,
    "layout_files": layouts,
    "corpus_xml_file": corpus_file,
    "export_lines": export_lines,
    "text_layers": text_layers,
    "export_validation": validation,
}

R = "(select distinct on (row_id) * from records)"
O = "(select distinct on (row_id) * from ocr_results)"  # noqa: E741
A_ = "(select distinct on (row_id) * from aligned_sentences)"
READ = "(select sn, list_sort(list(distinct lower(trim(qn)))) v from translit where qn is not null and sn is not null group by sn)"

SQL = {
    "similar_file": "select sn \"key\", list(similar_char order by rank_no, similar_char) vals from (select distinct * from similar_chars where sn is not null) group by sn",
    "syllable_file": "select lower(trim(qn)) \"key\", list_sort(list(distinct sn)) vals from translit where qn is not null group by all",
    "reading_file": "select lower(trim(qn)) reading, list_sort(list(distinct sn)) chars from translit where qn is not null and sn is not null group by all",
    "first_readings": f"select sn \"char\", v[1] reading from {READ}",
    "record_lines": f"select row_id, job_id, page, han, meaning, part_of, len(han_bbox)::int n from {R}",
    "page_files": f"select doc_id, page_no, model_name, arg_min(struct_pack(t := text), row_id).t text, arg_min(struct_pack(t := confidence), row_id).t confidence from {O} where doc_id is not null and page_no is not null and model_name is not null group by all",
    "manifest_files": f"select doc_id, min(source_pdf) source_pdf, count(*)::int total_pages, count(*)::int n from (select distinct doc_id, source_pdf, page_no from {O} where doc_id is not null and page_no is not null) group by all",
    "batch_result_lines": f"select row_id::varchar \"key\", text from {O} where text <> '' and row_id % 5 < 2",
    "batch_request_lines": f"select row_id::varchar \"key\", 'read' prompt, coalesce(source_pdf, '') image, '0.2' temperature from {O}",
    "layout_files": f"select chapter || '#' || page page_key, column_no column_id, i::int reading_idx, x text from (select chapter, page, column_no, unnest(range(len(sn_chars))) i, unnest(sn_chars) x from {A_})",
    "corpus_xml_file": f"select chapter, page, sentence_id, printf('%.4f', accuracy) accuracy, printf('%.1f', bbox_xmin) x_min, array_to_string(sn_chars, '') han, greatest(len(sn_chars), coalesce(len(qn_words), 0))::int pairs from {A_} where accuracy is not null and bbox_xmin is not null",
    "text_layers": "select page_key, case when n % 2 = 0 then 1 when n >= 5 then n else 0 end::int n from (select source_doc || '#' || page page_key, count(*) n from (select distinct on (row_id) * from detections) where text is not null and bbox is not null and len(bbox) >= 4 and source_doc is not null and page is not null group by all)",
    "export_validation": f"select count(*) \"rows\", count(*) expected, count(*) filter (where not coalesce(regexp_full_match(sentence_id, '[A-Z]{{3}}_[0-9]{{3}}[.][0-9]{{3}}[.][0-9]{{3}}[.][0-9]{{2}}'), false)) bad_ids from {A_}",
}

from vellum.plans.corpus import SQL as _CORPUS  # noqa: E402

SQL["export_lines"] = _CORPUS["export_entries"]

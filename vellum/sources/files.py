"""Readers and writers of the file formats around the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import page_address, page_count, strip, volume_id

RECORD = (
    "id STRING, job_id BIGINT, source_doc STRING, page INT, line_no INT, entry_no INT, han STRING, han_raw STRING, han_conf ARRAY<DOUBLE>, phonetic STRING, meaning STRING, layout_type STRING, image_path STRING, "
    "entry_meta STRUCT<ngay:STRING,to_tap:STRING,loai:STRING,xuat_xu:STRING,de_tai:STRING>, han_chars ARRAY<STRING>, phonetic_per_char ARRAY<STRING>, source_of STRUCT<han:STRING,phonetic:STRING,meaning:STRING>, "
    "review_status STRING, han_bbox ARRAY<DOUBLE>, meaning_bbox ARRAY<DOUBLE>, reviewed_by INT, reviewed_at DOUBLE, part_of STRING, created_at DOUBLE, row_id BIGINT"
)
OCR_PAGE = "doc_id STRING, source_pdf STRING, model_name STRING, page_no INT, text STRING, confidence DOUBLE, blocks ARRAY<STRUCT<text:STRING,confidence:DOUBLE,box:ARRAY<ARRAY<DOUBLE>>,source:STRING>>, elapsed_ms INT, error STRING, created_at STRING"
MANIFEST = "doc_id STRING, source_pdf STRING, total_pages INT, pages ARRAY<STRUCT<page_no:INT,object_key:STRING>>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): the lines of text files with their place, by whole files; dictionaries are small files."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
    return t


def dictionary(lines: DataFrame, lower_keys: bool = False, lenient: bool = False) -> DataFrame:
    """(key, values) of lines `key:value value …`; comments and blank lines are skipped, lines without a colon too, the first colon
    splits, a later key wins, a key without values stays. ``lenient`` also keeps an empty key."""
    x = lines.where(~F.ltrim(F.col("value")).startswith("#") & (strip(F.col("value")) != "") & F.col("value").contains(":"))
    key = strip(F.element_at(F.split("value", ":", 2), 1))
    values = F.filter(F.split(strip(F.element_at(F.split("value", ":", 2), 2)), r"\s+"), lambda v: v != "")
    x = x.select("file", "at", (F.lower(key) if lower_keys else key).alias("key"), (F.array_distinct(values) if lower_keys else values).alias("vals"))
    if not lenient:
        x = x.where("key <> ''")
    return x.groupBy("key").agg(F.max_by("vals", F.struct("file", "at")).alias("vals"))


def reading_table(spark: SparkSession, path: str) -> DataFrame:
    """(char, readings, file, at) of a CSV with a header whose second column is a list in brackets, its elements quoted or not; rows in
    which either is blank are skipped."""
    t = spark.read.option("header", True).csv(path)
    char, listed = t.columns[:2]
    x = t.select(strip(F.col(char)).alias("char"), strip(F.col(listed)).alias("listed"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).where("char <> '' and listed <> ''")
    quoted = F.regexp_extract_all("listed", F.lit("""(?:'([^']*)'|"([^"]*)")"""), F.lit(0))
    plain = F.split(F.regexp_replace("listed", r"^\[+|\]+$", ""), ",")
    bare = F.transform(F.when(F.size(quoted) > 0, quoted).otherwise(plain), lambda r: F.regexp_replace(r, r"^['\" ]+|['\" ]+$", ""))
    return x.select("char", bare.alias("readings"), "file", "at")


def first_readings(table: DataFrame) -> DataFrame:
    """(char, reading): the first reading of each character in lower case; a later row of a file wins."""
    one = F.lower(F.trim(F.try_element_at("readings", F.lit(1))))
    return table.where(F.size("readings") > 0).groupBy("char").agg(F.max_by(one, F.struct("file", "at")).alias("reading"))


def inverted(table: DataFrame) -> DataFrame:
    """(reading, chars) of (char, readings)."""
    x = table.select("char", F.explode("readings").alias("r")).select(F.lower(F.trim("r")).alias("reading"), "char").where("reading <> ''")
    return x.groupBy("reading").agg(F.array_sort(F.collect_set("char")).alias("chars"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """OCR answers of page_*.json files; the page number comes from the file name where the file has none."""
    t = spark.read.schema(OCR_PAGE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "page_*.json").json(path)
    return t.withColumn("page_no", F.coalesce("page_no", F.regexp_extract(F.col("_metadata.file_name"), r"page_(\d+)\.json$", 1).try_cast("int")))


def write_ocr_pages(pages: DataFrame, path: str) -> None:
    """OCR answers as JSON lines that hold their doc_id and model_name, in a folder for each model (its name in base64, as it may hold anything).
    Documents have no folders: there are as many as the corpus grows to, of a few pages each, and files cost more than pages."""
    pages.withColumn("model", F.base64(F.encode("model_name", "UTF-8"))).write.mode("overwrite").partitionBy("model").json(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One manifest for each document: the first by file path."""
    t = spark.read.schema(MANIFEST).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    return t.groupBy("doc_id").agg(F.min_by(F.struct("source_pdf", "total_pages", "pages"), "file").alias("m")).select("doc_id", "m.*")


def manifest(pages: DataFrame) -> DataFrame:
    """Manifests of (doc_id, source_pdf, page_no, object_key)."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "object_key")))
    return pages.groupBy("doc_id").agg(F.min("source_pdf").alias("source_pdf"), F.count("*").cast("int").alias("total_pages"), ordered.alias("pages"))


def batch_results(lines: DataFrame, value: str = "value", at: str = "at") -> DataFrame:
    """(key, text) of batch result lines: blank lines, junk, lines that have an error (also null) and lines without key or text are skipped;
    parts are put together, without parts the response's own text counts; a later key wins."""
    v = F.try_parse_json(F.col(value))
    parts = F.try_variant_get(v, "$.response.candidates[0].content.parts", "array<struct<text:string>>")
    text = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    x = lines.where(strip(F.col(value)) != "").select(
        F.col(at).alias("at"), F.try_variant_get(v, "$.key", "string").alias("key"), F.array_contains(F.json_object_keys(F.col(value)), "error").alias("error"), F.coalesce(text, F.try_variant_get(v, "$.response.text", "string")).alias("text")
    )
    x = x.where("key <> '' and text <> '' and not error")
    return x.groupBy("key").agg(F.max_by("text", "at").alias("text"))


def batch_requests(pages: DataFrame, prompt: str, system: str) -> DataFrame:
    """(value): a request line of JSON for each page (key, image BINARY): the page's image with a prompt."""
    image = F.struct(F.lit("image/png").alias("mime_type"), F.base64(F.coalesce("image", F.lit(b""))).alias("data"))
    parts = F.array(F.struct(F.lit(prompt).alias("text"), F.lit(None).cast("struct<mime_type:string,data:string>").alias("inline_data")), F.struct(F.lit(None).cast("string").alias("text"), image.alias("inline_data")))
    request = F.struct(
        F.array(F.struct(parts.alias("parts"))).alias("contents"), F.struct(F.array(F.struct(F.lit(system).alias("text"))).alias("parts")).alias("system_instruction"),
        F.struct(F.lit("application/json").alias("response_mime_type"), F.lit(0.2).alias("temperature")).alias("generation_config"),
    )
    return pages.select(F.to_json(F.struct("key", request.alias("request"))).alias("value"))


def listing(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(path, length) of the files under a path whose name has an ending, in order; directories are none. Contents are not read."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").load(path)
    return t.select("path", "length").orderBy("path")


def write_lines(df: DataFrame, path: str) -> None:
    """A column of texts as the lines of text files: JSON lines, dictionaries, requests."""
    df.write.mode("overwrite").text(path)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """(page_key, column_id, reading_idx, text) of layout files: a page's columns with their boxes."""
    t = spark.read.schema("page_key STRING, columns ARRAY<STRUCT<column_id:INT,boxes:ARRAY<STRUCT<reading_idx:INT,text:STRING>>>>").json(path)
    c = t.select("page_key", F.explode("columns").alias("c")).select("page_key", "c.column_id", F.explode("c.boxes").alias("b"))
    return c.select("page_key", "column_id", "b.reading_idx", "b.text")


def chapters(sentences: DataFrame) -> DataFrame:
    """(_id, _number, page) of sentences (chapter, page, column_no, sentence_id, accuracy, edit_distance, bbox_*, sn_chars, qn_words, pairs): a
    row for each chapter, its pages and sentences nested in order, for ``corpus_xml``. pairs: ARRAY<STRUCT<sn, qn, status, corrected>>."""
    one = lambda c: F.format_string("%.1f", c)
    s = F.struct(
        "column_no", F.col("sentence_id").alias("_id"), F.col("column_no").alias("_column"), F.format_string("%.4f", "accuracy").alias("_accuracy"), F.col("edit_distance").alias("_edit_distance"),
        F.struct(*(one(F.col(f"bbox_{a}{b}")).alias(f"_{a}_{b}") for b in ("min", "max") for a in ("x", "y"))).alias("bbox"), F.array_join("sn_chars", "").alias("han"), F.array_join("qn_words", " ").alias("quocngu"),
        F.struct(F.transform("pairs", lambda p: F.struct(p["sn"].alias("_sn"), p["qn"].alias("_qn"), p["status"].alias("_status"), p["corrected"].alias("_corrected"))).alias("pair")).alias("alignment"),
    )
    pages = sentences.groupBy("chapter", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_no", "sentence_id", s.alias("s")))), lambda x: x["s"].dropFields("column_no")).alias("sentence"))
    p = F.struct("page", F.format_string("%03d", "page").alias("_id"), F.col("page").alias("_number"), "sentence")
    g = pages.groupBy("chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", p.alias("p")))), lambda x: x["p"].dropFields("page")).alias("page"))
    return g.select(F.format_string("%03d", "chapter").alias("_id"), F.col("chapter").alias("_number"), "page")


def validated(written_: DataFrame, expected: DataFrame, id_: str, pattern: str) -> DataFrame:
    """One row, (rows, expected, bad_ids): whether an export holds as many rows as it should, and ids that do not fit the pattern."""
    n = written_.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(F.col(id_).rlike(pattern), F.lit(False))).alias("bad_ids"))
    return n.crossJoin(expected.agg(F.count("*").alias("expected"))).select("rows", "expected", "bad_ids")  # one row each


def corpus_xml(sentences: DataFrame, path: str, row: str = "sentence") -> None:
    """Sentences as XML; columns that start with _ become attributes."""
    sentences.write.format("xml").option("rootTag", "corpus").option("rowTag", row).option("attributePrefix", "_").mode("overwrite").save(path)


def landing_pages(html: DataFrame, base: str) -> DataFrame:
    """(volume, page, url): an address for each page that a landing page (html) names."""
    x = html.select(volume_id(F.col("html")).alias("volume"), page_count(F.col("html")).alias("n")).where("volume is not null and n is not null")
    return x.select("volume", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page")).withColumn("url", page_address(F.lit(base), F.col("volume"), F.col("page")))


def nested_layout(boxes: DataFrame) -> DataFrame:
    """(page_key, columns): a page's columns with their boxes, for JSON."""
    c = boxes.groupBy("page_key", "column_id").agg(F.array_sort(F.collect_list(F.struct("reading_idx", "text"))).alias("boxes"))
    return c.groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("column_id", "boxes"))).alias("columns"))

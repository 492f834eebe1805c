"""Files of pages: as many folders as models, whatever the documents, and keys of any text."""

import os

import duckdb
from vellum.plans import files


def test_page_files_by_model(spark, tmp_path, monkeypatch):
    names = ["", " a", "A", "a", "a/b=c", "0012", "__HIVE_DEFAULT_PARTITION__", "漢\n\"喃"]
    rows = [(i, f"d{i}", i % 3, names[i % 2 + 1], f"text {i}", i / 7) for i in range(200)]
    rows += [(1000 + i, n, 7, m, None if m == n else f"{n}|{m}\r\n", None if m < n else float(i)) for i, (n, m) in enumerate((n, m) for n in names for m in names)]
    rows += [(1, "d1", 1, names[2], "text 1", 1 / 7), (500, "d5", 2, names[2], "later", 0.5), (2000, None, 1, "a", "x", 0.1), (2001, "d", None, "a", "x", 0.1), (2002, "d", 1, None, "x", 0.1), (None, "e", 1, "a", "x", 0.1)]
    spark.createDataFrame(rows, "row_id long, doc_id string, page_no int, model_name string, text string, confidence double").write.parquet(f"{tmp_path}/ocr_results.parquet")
    con = duckdb.connect()
    con.sql(f"create view ocr_results as select * from '{tmp_path}/ocr_results.parquet/*.parquet'")
    monkeypatch.setattr(files, "scratch", lambda s, what: f"file://{tmp_path}/{what}")
    got = files.QUERIES["page_files"](spark, str(tmp_path)).select("doc_id", "page_no", "model_name", "text", "confidence").collect()
    expected = con.sql(f"select doc_id, page_no, model_name, text, confidence from ({files.SQL['page_files']})").fetchall()
    assert len(got) == 265 and sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert sum(bool(sub) or any(f.endswith(".json") for f in f_) for _, sub, f_ in os.walk(f"{tmp_path}/pages")) <= len(names) + 1

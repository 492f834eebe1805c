"""Every query of the subpackage over the smallest tables; those with SQL against it; found queries have the stated columns."""

import duckdb
import pytest

from vellum.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["table_name", "row_id", "end_pos"], "p2_found": ["table_name", "row_id", "han_end", "other_row_id", "other_end"], "p3_found": ["group_id", "text_from", "confidence_from"],
    "p5_found": ["table_name", "row_id", "field_name"], "p6_found": ["table_name", "row_id", "field_name", "line_no", "noise"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "seg_no", "lang"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)
    if name in SQL:
        c = duckdb.connect()
        import os

        for f in os.listdir(SMALL):
            c.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
        assert sorted(map(tuple, rows)) == sorted(c.execute(SQL[name]).fetchall())


CLASHING = ("units", "label", "prior", "n", "value", "x", "e", "z", "part", "bucket", "doc", "a", "b", "what", "form", "rank", "older", "source_", "p_vi", "token", "side", "term", "kind", "scope", "key", "at", "salt", "_text", "_u", "_s", "seg_no", "shown", "read", "corrected", "table_name_", "id_", "ids", "piece_no")


@pytest.fixture(scope="module")
def widened(spark, tmp_path_factory):
    """The smallest tables with further columns whose names operators use."""
    import os

    folder = str(tmp_path_factory.mktemp("wide"))
    from pyspark.sql import functions as F

    for f in os.listdir(SMALL):
        t = spark.read.parquet(f"{SMALL}/{f}")
        t.withColumns({c: F.lit("clash") for c in CLASHING if c not in t.columns}).write.parquet(f"{folder}/{f}")
    return folder


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.endswith("_found") or n in ("p7_ids", "p8_containers")))
def test_further_columns_change_nothing(spark, widened, name):
    key = lambda r: repr(r)
    got, want = (sorted((tuple(r) for r in QUERIES[name](spark, d).collect()), key=key) for d in (widened, SMALL))
    assert got == want

"""Queries against their SQL over the smallest tables, and the cases the tables lack."""

import duckdb
import pytest

import __spark_entry__ as entry
from vellum.operators import corpus as C

SMALL = "/root/testdata/sf0.001"
Q, S = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    import os

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SMALL):
        c.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(n for n in S if not n.startswith("p3_")))
def test_equals_sql(spark, db, name):
    df = Q[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = db.execute(S[name])
    names = [d[0] for d in r.description]
    want = sorted((tuple(plain(v[names.index(c)]) for c in cols) for v in r.fetchall()), key=repr)
    assert sorted(names) == cols
    assert got == want


def test_every_core_query_runs(spark):
    for name in sorted(set(Q) - set(S)):
        if not name.startswith("p"):
            assert Q[name](spark, SMALL).limit(5).collect() is not None


RECORDS = "row_id long, job_id long, human_id string, page int, line_no int, han string, meaning string, part_of string, review_status string"


def test_folding(spark):
    rows = [
        (1, 1, "a", 5, 1, "甲", " one ", None, "verified"), (2, 1, "b", 4, 2, "乙", "two", "a", "pending"), (3, 1, "c", 4, 1, "丙", " ", "a", None),
        (4, 1, "d", 1, 1, "丁", "lost", "zz", "verified"), (5, 2, "a", 1, None, None, None, "", "pending"),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    got = {(r.job_id, r.human_id): r for r in C.folded(df).collect()}
    assert set(got) == {(1, "a"), (2, "a")}
    assert got[1, "a"].han == "甲丙乙" and got[1, "a"].meaning == "one two" and got[1, "a"].pages == [5, 4, 4]
    assert got[2, "a"].meaning == "" and got[2, "a"].pages is None
    assert [(r.job_id, r.human_id) for r in C.folded(df, True).collect()] == [(1, "a")]
    page = {(r.page, r.human_id): r for r in C.page_entries(df).where("job_id = 1").collect()}
    assert page[4, "b"].spans and page[4, "b"].status == "verified" and not page[1, "d"].spans


def test_empty(spark):
    df = spark.createDataFrame([], RECORDS)
    assert C.folded(df).count() == 0 and C.page_entries(df).count() == 0 and C.previous_entry(df).count() == 0

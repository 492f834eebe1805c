"""Columns, lines, entries, passes and alignment on the cases the literature of the formats gives."""

import random

from pyspark.sql import functions as F

from vellum.operators import alignment as A
from vellum.operators import index as X
from vellum.operators import layout as L
from vellum.operators import mutations as M

FIVE = [("百", 341, 379, 8, 149), ("年", 261, 297, 9, 251), ("身", 181, 219, 6, 252), ("後", 102, 137, 9, 250), ("名", 20, 55, 9, 250)]


def boxes(spark, rows):
    return spark.createDataFrame([("p", i, t, (x0 + x1) / 2, (y0 + y1) / 2, float(x1 - x0)) for i, (t, x0, x1, y0, y1) in enumerate(rows)], "page_key string, ord int, text string, cx double, cy double, w double")


def test_single_columns(spark):
    b = boxes(spark, FIVE)
    got = L.columns(b).join(b, ["page_key", "ord"]).orderBy("reading_idx").collect()
    assert [r.text for r in got] == list("百年身後名") and [r.column_id for r in got] == [0, 1, 2, 3, 4]


def test_three_columns(spark):
    a = [(t, 340, 380, 10 + 55 * i, 60 + 55 * i) for i, t in enumerate("帝王臨朝")]
    b = [(t, 245, 285, 15 + 55 * i, 65 + 55 * i) for i, t in enumerate("聖德日")]
    c = [(t, 150, 190, 10 + 55 * i, 60 + 55 * i) for i, t in enumerate("新月異盛")]
    x = boxes(spark, c + a + b)
    got = L.column_texts(x.join(L.columns(x), ["page_key", "ord"])).orderBy("column_id").collect()
    assert [r.text for r in got] == ["帝王臨朝", "聖德日", "新月異盛"]
    assert L.columns(boxes(spark, [("x", 0, 1, 0, 1)]).limit(0)).count() == 0


def test_lines_and_entries(spark):
    spans = [("p", 0, "6 tháng 7 năm Gia Long 1", 300.0, 0.0, 500.0, 10.0), ("p", 1, "11", 300.0, 20.0, 310.0, 30.0), ("p", 2, "Loại: Chiếu", 320.0, 21.0, 400.0, 31.0), ("p", 3, "Đại Nội", 300.0, 40.0, 400.0, 50.0), ("p", 4, "Tập hợp con cháu", 300.0, 60.0, 400.0, 70.0), ("p", 5, "Chiếu: Nay", 300.0, 80.0, 400.0, 90.0), ("p", 6, "bái yết.", 300.0, 100.0, 400.0, 110.0)]
    lines = L.lines(spark.createDataFrame(spans, "page_key string, ord int, text string, x0 double, y0 double, x1 double, y1 double"))
    assert [r.text for r in lines.orderBy("line_no").collect()][1] == "11 Loại: Chiếu"
    e = L.entry_fields(L.entries(lines)).collect()
    assert len(e) == 1
    r = e[0]
    assert (r.entry_no, r.ngay, r.loai, r.xuat_xu, r.de_tai, r.meaning) == (11, "6 tháng 7 năm Gia Long 1", "Chiếu", "Đại Nội", "Tập hợp con cháu", "Chiếu: Nay bái yết.")


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(3)

    def make(n):
        out = []
        for i in range(n):
            x, y = rnd.uniform(0, 900), rnd.uniform(0, 900)
            out.append(("p", i, "x", 0.5, x, y, x + rnd.uniform(5, 400), y + rnd.uniform(5, 400)))
        return out

    a, b = make(40), make(40)
    schema = "page_key string, ord int, text string, conf double, x0 double, y0 double, x1 double, y1 double"
    got = {(r.a_ord, r.b_ord) for r in L.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 0.1).collect()}

    def iou(p, q):
        w, h = min(p[6], q[6]) - max(p[4], q[4]), min(p[7], q[7]) - max(p[5], q[5])
        if w <= 0 or h <= 0:
            return 0
        area = lambda r: max((r[6] - r[4]) * (r[7] - r[5]), 1)
        return w * h / (area(p) + area(q) - w * h)

    assert got == {(p[1], q[1]) for p in a for q in b if iou(p, q) >= 0.1}


def test_alignment(spark):
    pairs, cost = A.edit_script(list("abc"), list("axcd"))
    assert cost == 2 and pairs == [("a", "a"), ("b", "x"), ("c", "c"), ("", "d")]
    assert A.edit_script([], ["x"]) == ([("", "x")], 1) and A.edit_script([], []) == ([], 0)
    x = spark.createDataFrame([("百", "trăm"), ("X", "trăm"), ("旦", "nhật"), ("百", None), ("百", "∅")], "sn string, qn string")
    sim = spark.createDataFrame([("旦", 2, "白"), ("旦", 1, "日")], "sn string, rank_no int, similar_char string")
    tr = spark.createDataFrame([("trăm", "百"), (" Nhật ", "日"), ("nhật", "白")], "qn string, sn string")
    got = {(r.sn, r.qn): (r.verdict, r.correction) for r in A.verdicts(x, sim, tr).collect()}
    assert got == {("百", "trăm"): ("BLACK", None), ("X", "trăm"): ("RED", None), ("旦", "nhật"): ("GREEN", "日"), ("百", None): ("RED", None), ("百", "∅"): ("RED", None)}
    d = spark.createDataFrame([(["a", "bb", "c"], ["a", "c"])], "a array<string>, b array<string>").select(A.token_distance(F.col("a"), F.col("b"))).collect()[0][0]
    assert d == 1
    assert A.aligned(spark.createDataFrame([(1, None, ["x"]), (2, [], [])], "id int, a array<string>, b array<string>"), "a", "b", "id").count() == 1


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 5.0)], "id int, v string, at double")
    new = spark.createDataFrame([(2, "c", 5.0), (2, "d", 4.0), (3, "e", None)], "id int, v string, at double")
    assert {(r.id, r.v) for r in M.upsert(old, new, ["id"], "at").collect()} == {(1, "a"), (2, "c"), (3, "e")}
    assert {(r.id, r.v) for r in M.insert_absent(old, new.where("id = 3"), ["id"], "at").collect()} == {(1, "a"), (2, "b"), (3, "e")}


def test_nearest_equals_brute_force(spark):
    import numpy as np

    rnd = np.random.default_rng(0)
    v = rnd.normal(size=(60, 8)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "vec_id long, embedding array<float>")
    got = {}
    for r in X.nearest(df, df.where("vec_id < 7"), 3, block=4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = n @ n.T
    np.fill_diagonal(s, -9)
    for q in range(7):
        assert [got[q][k] for k in (1, 2, 3)] == list(np.argsort(-s[q], kind="stable")[:3])

"""Records of catalogue pages, replies, links, failing jobs and versions on cases the tables lack."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import extraction as X
from vellum.operators import mutations as M
from vellum.operators import replies as P
from vellum.plans import registry as R
from vellum.sources import files, store
from vellum.streaming import jobs as J

SPAN = "page_key string, ord long, text string, x0 double, y0 double, x1 double, y1 double"
DET = "page_key string, ord long, text string, x0 double, y0 double, x1 double, y1 double, conf double"

TWO = [
    ("99", 300, 40, 322, 58), ("TRÍCH YẾU", 345, 40, 430, 58), ("Công đồng truyền:", 345, 65, 480, 83), ("Ngày: 21 tháng 2 năm Gia Long 4", 345, 90, 560, 108), ("Tờ/Tập: 67/1", 345, 115, 440, 133), ("Loại: Truyền", 345, 140, 440, 158),
    ("Xuất xứ: Công Đồng", 345, 165, 500, 183), ("Đề tài: Báo cáo tình hình khai thác gỗ", 345, 190, 580, 208), ("Công đường quan doanh Bình Định được rõ: hỏi về số gỗ dân", 345, 215, 590, 233),
    ("100", 300, 260, 330, 278), ("Công đồng truyền:", 345, 260, 480, 278), ("Ngày: 15 tháng 3 năm Gia Long 4", 345, 285, 560, 303), ("Tờ/Tập: 68/2", 345, 310, 440, 328), ("Loại: Tư", 345, 335, 420, 353), ("Báo cáo việc thu thuế tại các trấn", 345, 360, 560, 378),
]
TWO_HAN = [("平", 55, 85), ("定", 88, 118), ("營", 121, 151), ("公", 154, 184), ("堂", 187, 217), ("官", 205, 232), ("諭", 272, 302), ("旨", 305, 335)]
ONE = [
    ("6 tháng 7 năm Gia Long 1", 300, 20, 520, 38), ("11", 300, 44, 318, 62), ("Loại: Chiếu", 325, 44, 430, 62), ("Đại Nội", 300, 68, 360, 86), ("Tập hợp con cháu trong họ,", 300, 92, 520, 110), ("Tờ/Tập: 1/1", 300, 116, 400, 134),
    ("TRÍCH YẾU", 300, 140, 400, 158), ("Chiếu: Nguyễn Phúc Phấn, là", 300, 164, 560, 182), ("con cháu Uy Thọ hầu Nguyễn Tôn", 300, 188, 560, 206), ("2S", 565, 188, 585, 206), ("Thái, hãy chiêu tập họ tộc để về thành", 300, 212, 580, 230), ("Thăng Long bái yết.", 300, 236, 460, 254),
]
ONE_HAN = [(t, 40 + 35 * i, y, 70 + 35 * i, y + 30) for y, row in ((165, "詔阮福乃威侯"), (200, "裔宗泰招拜詣")) for i, t in enumerate(row)]


def page(spark, key, spans, dets, scale=1.0):
    a = spark.createDataFrame([(key, i, t, *(v * scale for v in map(float, b))) for i, (t, *b) in enumerate(spans)], SPAN)
    b = spark.createDataFrame([(key, i, t, *(v * scale for v in map(float, b)), conf) for i, (t, *b, conf) in enumerate(dets)], DET)
    return a, b


@pytest.mark.parametrize("scale", [1.0, 2.0])
def test_two_entries(spark, scale):
    dets = [(t, 40, a, 80, b, 0.95) for t, a, b in TWO_HAN] + [("LƯU TRỮ VN", 120, 150, 230, 185, 0.15)]
    got = {r.entry_no: r for r in X.two_column(*page(spark, "p", TWO, dets, scale)).collect()}
    assert set(got) == {99, 100}
    a, b = got[99], got[100]
    assert (a.han, a.ngay, a.to_tap, a.loai, a.xuat_xu, a.de_tai) == ("平定營公堂官", "21 tháng 2 năm Gia Long 4", "67/1", "Truyền", "Công Đồng", "Báo cáo tình hình khai thác gỗ")
    assert a.meaning.startswith("Công đường quan doanh Bình Định") and "TRÍCH" not in a.meaning
    assert (b.han, b.to_tap, b.loai, b.meaning) == ("諭旨", "68/2", "Tư", "Báo cáo việc thu thuế tại các trấn")


def test_one_entry_with_positional_fields(spark):
    a, b = page(spark, "p", ONE, [(*d, 0.9) for d in ONE_HAN])
    (r,) = X.two_column(a, b).collect()
    assert (r.entry_no, r.ngay, r.to_tap, r.loai, r.xuat_xu, r.de_tai) == (11, "6 tháng 7 năm Gia Long 1", "1/1", "Chiếu", "Đại Nội", "Tập hợp con cháu trong họ,")
    assert r.meaning.startswith("Chiếu:") and r.meaning.endswith("Thăng Long bái yết.") and "2S" not in r.meaning
    assert "拜詣" in r.han and r.han_bbox[1] == 158.0 and 245 <= r.han_bbox[2] < 300
    assert [x.two_column for x in X.fingerprinted(a).collect()] == [True]
    assert X.two_column(a.limit(0), b).count() == 0


def entry_numbers(spark, lines):
    x = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, lines array<string>")
    return [r.n for r in x.orderBy("i").select(T.entry_number(F.col("lines"), F.lit(None).cast("int")).alias("n")).collect()]


def test_entry_number_minds_case(spark):
    assert entry_numbers(spark, [["6 tháng …", "Nộp 12 loại gỗ", "41 Loại: Chiếu"], ["Nộp 12 loại gỗ"], ["tập 3, 41 Loại: …"], ["TờITập: 7/1 Loại: Sai"], ["7n Loại: x"]]) == [41, None, 3, None, 7]


def test_tenths_round_as_python(spark):
    import random

    rnd = random.Random(4)
    values = [0.15, 0.25, 0.35, 2.675, 1.05, 0.45, 1e6 + 0.05, 12.25, 0.0] + [rnd.randrange(100000) / 20 for _ in range(2000)] + [rnd.uniform(0, 2000) for _ in range(500)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(G.round_tenth(F.col("v")).alias("r")).collect()
    assert [r.r for r in got] == [round(v, 1) for v in values]


def test_replies_to_records(spark):
    entries = [
        {"entry_no": 42, "han_box": [0, 0, 500, 250], "han": " 百 ", "vietnamese": "một"}, {"entry_no": None, "is_continuation": True, "han": "年", "viet": "hai"}, {}, 7, "x",
        {"han": "", "vi_box": [1, 2, 3]}, {"meaning": "ba", "meta": {"loai": " Tư "}, "han_box": [0, 0, 0, 0]},
    ]
    x = spark.createDataFrame([(1, "HVB_001", 7, 1000.0, 2000.0, "x ```json\n" + json.dumps({"entries": entries}) + "\n```"), (2, "HVB_001", 8, 1.0, 1.0, "{broken"), (3, "P", 9, 1.0, 1.0, json.dumps(entries[:1]))], "job_id long, prefix string, page int, width double, height double, reply string")
    got = P.page_records(x, "job_id").orderBy("job_id", "line_no").collect()
    one = [r for r in got if r.job_id == 1]
    assert [(r.human_id, r.line_no, r.entry_no, r.han, r.meaning, r.continues) for r in one] == [("HVB_001.007.01", 1, 42, "百", "một", False), ("HVB_001.007.02", 2, 2, "年", "hai", True), ("HVB_001.007.03", 3, 3, "", "ba", False)]
    assert one[0].han_bbox == [0.0, 0.0, 250.0, 1000.0] and one[2].han_bbox is None and one[2].entry_meta.loai == "Tư"
    assert not [r for r in got if r.job_id != 1]  # of a bare list the first braces are read, which name no entries


def test_enhanced_reply(spark):
    rows = ['```json\n{"Hán": {"text": " 百 "}, "Quoc_Ngu": "trăm"}\n```', "just text", '{"other": 1}', None, '{"han": 5, "translation": "x"}']
    x = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string").orderBy("i").select(P.enhanced(F.col("r")).alias("e")).collect()
    assert [(r.e.han, r.e.meaning) for r in x] == [("百", "trăm"), ("just text", ""), ('{"other": 1}', ""), ("", ""), ("", "x")]


def test_verified_pages_stay_and_continuations_link(spark):
    rec = spark.createDataFrame([(1, 1, "A.001.01", 1, 1, "甲", "a", "verified", None), (2, 1, "A.002.01", 2, 1, "乙", "b", "pending", None)], "row_id long, job_id long, human_id string, page int, line_no int, han string, meaning string, review_status string, part_of string")
    reply = json.dumps({"entries": [{"han": "丙", "is_continuation": True}, {"han": "丁"}]})
    r = spark.createDataFrame([(1, "A", p, 1.0, 1.0, reply) for p in (1, 2)], "job_id long, prefix string, page int, width double, height double, reply string")
    got = {(x.page, x.line_no, x.han, x.part_of) for x in P.applied(rec, r).collect()}
    assert got == {(1, 1, "甲", None), (2, 1, "丙", "A.001.01"), (2, 2, "丁", None)}


def test_links_resolve_one_level(spark):
    rec = spark.createDataFrame([(1, 1, "a", 1, 1, None), (2, 1, "b", 1, 2, "a"), (3, 1, "c", 2, 1, None)], "row_id long, job_id long, human_id string, page int, line_no int, part_of string")
    links = spark.createDataFrame([(1, "c", "b"), (1, "c", ""), (1, "a", None), (1, "a", "a"), (1, "c", "zz"), (1, "q", "a")], "job_id long, human_id string, part_of string")
    got = sorted(((r.human_id, r.part_of, r.problem) for r in M.resolve_links(rec, links).collect()), key=repr)
    assert got == sorted([("c", "a", None), ("c", "a", None), ("a", None, "no entry before"), ("a", None, "itself"), ("c", None, "no head"), ("q", None, "no record")], key=repr)


def test_a_failing_job_fails_alone(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("jobs", "out", "mark"))
    row = lambda i, kind, name: (i, name, None, None, "pending", None, None, 0.0, 0.0, kind, None, None)
    spark.createDataFrame([row(1, "extract", "ok"), row(2, "extract", "bad"), row(3, "reocr", "ok")], J.JOB).write.parquet(src)
    broken = lambda df: df.select("id", F.when(F.col("filename") == "bad", F.raise_error(F.lit("no such file")).cast("string")).otherwise("fine").alias("text"))
    J.run_available(J.incoming(spark, src), J.dispatch({"extract": broken, "reocr": lambda df: df.select("id")}, out), mark)
    done = lambda k: [r.id for r in spark.read.option("recursiveFileLookup", True).parquet(f"{out}/kind={k}").collect()]
    assert done("extract") == [1] and done("reocr") == [3]
    (f,) = spark.read.parquet(f"{out}/kind=failed").collect()
    assert (f.id, f.status) == (2, "failed") and f.error


def test_versions_and_claims(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2):
        store.publish(spark.range(n), path)
        assert store.current(spark, path).count() == n
    assert [store.claim(spark, str(tmp_path / "claims"), 7) for _ in range(2)] == [True, False]


def test_retries_and_envelope(spark):
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise RuntimeError("HTTP 503")
        return x

    assert R.retried(flaky, sleep=waits.append)(5) == 5 and waits == [2.0, 4.0]
    with pytest.raises(ValueError):
        R.retried(lambda: (_ for _ in ()).throw(ValueError("bad key")), sleep=waits.append)()
    v = spark.range(1).select(R.EMBEDDERS["hash"](F.lit("a b a")).alias("v"), R.EMBEDDERS["hash"](F.lit("")).alias("z")).collect()[0]
    assert len(v.v) == 384 and abs(sum(x * x for x in v.v) - 1) < 1e-6 and set(v.z) == {0.0}


def test_reading_file_and_placeholders(spark, tmp_path):
    (tmp_path / "h.csv").write_text("char,hanviet,pinyin\n佛,\"['phật', 'phất']\",fo\n上,[thướng],\n,x,\n下,,\n佛,\"['Bụt']\",\n", encoding="utf-8")
    t = files.reading_table(spark, str(tmp_path / "h.csv"))
    assert {r.char: r.reading for r in files.first_readings(t).collect()} == {"佛": "bụt", "上": "thướng"}
    assert {r.reading: list(r.chars) for r in files.inverted(t).collect()} == {"phật": ["佛"], "phất": ["佛"], "bụt": ["佛"], "thướng": ["上"]}
    p = spark.createDataFrame([("d", 1), ("d", 2)], "doc string, page int")
    got = sorted((r.page, r.placeholder) for r in X.with_placeholders(p, spark.createDataFrame([("d", 1, 1, "x")], "doc string, page int, line_no int, han string"), ["doc", "page"]).collect())
    assert got == [(1, False), (2, True)]

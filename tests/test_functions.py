"""Text, geometry and id functions on literal cases."""

import uuid

import pytest
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import ids as I
from vellum.functions import text as T


def one(spark, c):
    return spark.range(1).select(c.alias("x")).collect()[0][0]


@pytest.mark.parametrize(
    ("made", "want"),
    [
        (lambda: T.cjk_ratio(F.lit("百 a𠀀　")), 2 / 3), (lambda: T.cjk_ratio(F.lit(" ")), 0.0), (lambda: T.looks_latin(F.lit("ab1-")), True), (lambda: T.looks_latin(F.lit("")), False),
        (lambda: T.fix_phrases(F.lit("MUCLUC  CHAUBAN TRIEU NGUYEN tap i")), "MỤC LỤC CHÂU BẢN TRIỀU NGUYỄN TẬP I"),
        (lambda: T.kind_of_entry(F.lit("11 LOẠI： Chiếu Xuất xứ: x")), "Chiếu"), (lambda: T.is_noise(F.lit("2S")), True), (lambda: T.is_noise(F.lit("2024")), False),
        (lambda: T.is_garbage(F.lit("2E]Í#")), True), (lambda: T.is_vietnamese_word(F.lit("ở")), False), (lambda: T.is_vietnamese_word(F.lit("Tư")), True),
        (lambda: T.has_fingerprint(F.lit("công đồng truyền")), True), (lambda: T.safe_stem(F.lit("a/b/Châu x.pdf")), "Ch_u_x"), (lambda: T.source_of_file(F.lit("/in/CHAU-1.pdf")), "ChauBan"),
        (lambda: T.page_filter(F.lit("1,3, 5-7")), [1, 3, 5, 6, 7]), (lambda: T.page_filter(F.lit(" , ")), None), (lambda: T.page_suffix(T.page_filter(F.lit("2-4"))), "_p2-4"), (lambda: T.page_suffix(T.page_filter(F.lit("2,5"))), "_p2-5"),
        (lambda: T.retry_delay(F.lit("please RETRY in 2.5s")), 2.5), (lambda: T.batch_state(F.lit("JOB_STATE_FAILED")), "failed"), (lambda: T.batch_state(F.lit(None)), "unknown"),
        (lambda: T.passage(F.lit(" query: x")), "query: x"), (lambda: T.volume_id(F.lit("<img src='/site_media/nom/nlvnpf-0506/jpeg/a.jpg'>")), "nlvnpf-0506"),
        (lambda: T.page_count(F.lit("<dl><dt>Pages</dt><dd>107</dd></dl>")), 107), (lambda: T.page_count(F.lit("Page 1 of 88")), 88), (lambda: T.page_count(F.lit("<a href='page/7'>")), 7), (lambda: T.page_count(F.lit("none")), None),
        (lambda: T.sentence_id(F.lit(1), F.lit(3), F.lit(7)), "HVH_004.001.003.07"), (lambda: T.entry_number(F.array(F.lit("; 11 Loại: Chiếu")), F.lit(None).cast("int")), 11), (lambda: T.entry_number(F.array(F.lit("Tờ 5/2 Loại: Tư")), F.lit(None).cast("int")), None),
        (lambda: I.uuid5(F.lit("d|m|1|page|page")), str(uuid.uuid5(uuid.NAMESPACE_URL, "d|m|1|page|page"))), (lambda: I.json_field(F.lit('```json\n{"han": "百"}\n```'), "han"), "百"), (lambda: I.json_field(F.lit("{broken"), "han"), None),
        (lambda: I.int_or(F.lit(" 12 "), F.lit(3)), 12), (lambda: I.int_or(F.lit("12.0"), F.lit(3)), 3),
        (lambda: G.to_pixels(F.array(*map(F.lit, (0.0, 0.0, 500.0, 250.0))), F.lit(1000.0), F.lit(2000.0)), [0.0, 0.0, 250.0, 1000.0]),
        (lambda: G.to_pixels(F.array(*map(F.lit, (-100.0, 900.0, 1100.0, 1200.0))), F.lit(1000.0), F.lit(1000.0)), [900.0, 0.0, 1000.0, 1000.0]), (lambda: G.to_pixels(F.array(F.lit(1.0)), F.lit(10.0), F.lit(10.0)), []),
        (lambda: G.upper_median(F.array(*map(F.lit, (1.0, 4.0, 3.0, 2.0)))), 3.0),
    ],
)
def test_values(spark, made, want):
    got = one(spark, made())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_errors(spark):
    for bad in (lambda: T.page_filter(F.lit("5-2")), lambda: T.sentence_id(F.lit(1), F.lit(1), F.lit(100))):
        with pytest.raises(Exception):
            one(spark, bad())


def test_png(spark):
    data = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (1234).to_bytes(4, "big") + (5678).to_bytes(4, "big")
    got = spark.createDataFrame([(bytearray(data),), (bytearray(b"JPEG"),)], "d binary").select(I.png_size(F.col("d"))).collect()
    assert tuple(got[0][0]) == (1234, 5678) and got[1][0] is None

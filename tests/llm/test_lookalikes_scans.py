"""Look-alike forms and repair of scans on literals, dirt and held-out noise."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from vellum.llm import lookalikes as L
from vellum.llm import scans as S

MODEL = L.Model({})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ngàу", "ngày"), ("νау", "vay"), ("bản β, tr. 5", "bản β, tr. 5"), ("Β", "Β"), ("v.ν", "v.v"), ("ｋｈẩu １2", "khẩu 12"), ("ϲoi", "coi"), ("th﻿ôn sá‌u", "thôn sáu"),
        ("⽉六\U000e0100年︀", "月六年"), ("a b c", "a b c"), ("奉　聖旨", "奉　聖旨"), ("a　b", "a b"), (unicodedata.normalize("NFD", "nhận xét"), "nhận xét"), ("…“”—！，", "…“”—！，"), ("", ""), ("Москва", "Москва"), ("x² №5", "x2 №5"),
    ],
)
def test_form(text, want):
    assert L.form(text, MODEL) == want


def test_every_change_is_seen_by_the_filter(spark):
    texts = [c for c in map(chr, [*range(1, 0x3400), *range(0xF900, 0xFFF0), 0x1D400, 0x2F800, 0xE0101]) if L.form("a" + c + "b", MODEL) != "a" + c + "b"]
    df = spark.createDataFrame([("a" + c + "b",) for c in texts], "t string")
    missed = [r.t for r in df.where(~L.is_open(F.col("t"))).collect()]
    assert not missed, missed[:20]


REC = "row_id long, han string, meaning string, text string"


def test_changed(spark):
    rec = spark.createDataFrame([(1, "甲⽉", "sạch", "x"), (1, "甲⽉", "sạch", "x"), (2, None, "ngàу", "x"), (3, "", "", "x")], REC)
    det = spark.createDataFrame([(1, "l­ính"), (2, None), (3, "ổn β")], "row_id long, text string")
    got = {tuple(r) for r in L.changed(rec, det).collect()}
    assert got == {("records", 1, "han"), ("records", 2, "meaning"), ("detections", 1, "text")}
    assert L.forms(rec, det).count() == 9
    assert L.changed(rec.limit(0), det.limit(0)).count() == 0


WORDS = "quan huyện xem xét nhận thuế muối của dân làng rồi sai lính trạm chở về kho tàng trong thành".split()


def corpus(spark, n=400, seed=0):
    rnd = random.Random(seed)
    clean = [" ".join(rnd.choice([WORDS[:6], WORDS[6:12], WORDS[12:]])) + "." for _ in range(n)]
    rec = spark.createDataFrame([(i, "河官修理石橋。" if i % 2 else "戶部查點銀兩。", "戶部查占銀兩。" if i == 8 else None, t) for i, t in enumerate(clean)], "row_id long, han string, han_raw string, meaning string")
    return clean, rec


def test_noise_is_found_and_repaired(spark):
    clean, rec = corpus(spark)
    page = "Sổ biên kho, tập 3   12\nqnan huyện xem x^ét\nnhận thuế mu-\n- 7 -\nối.\n12\ntấn muối"
    ocr = spark.createDataFrame([(1, page, None), (2, page, "quota"), (3, "Sa!", " "), (4, None, None), (5, "", None)], "row_id long, text string, error string")
    got = {tuple(r)[3:] for r in S.noise(rec, ocr).where("table_name = 'ocr_results' and row_id = 1").collect()}
    assert got == {(1, "furniture"), (4, "furniture"), (2, "misread"), (3, "broken_word")}  # 12 stands before its unit
    fixed = {r.row_id: r.repaired for r in S.repaired(rec, ocr).where("table_name = 'ocr_results'").collect()}
    assert fixed[1].startswith("quan huyện xem xét nhận thuế muối.") and 2 not in fixed
    han = {tuple(r) for r in S.noise(rec, ocr).where("field_name = 'han_raw'").collect()}
    assert han == {("records", 8, "han_raw", 1, "misread")}


def test_held_out_noise(spark):
    """Errors put into lines the channel has not counted are found; clean lines stay."""
    clean, rec = corpus(spark, 600)
    none = spark.createDataFrame([], "row_id long, text string, error string")
    channel = S.Channel(*S.fit(rec, none)[0].value)
    rnd = random.Random(9)
    hit = 0
    for k in range(200):
        words = list(rnd.choice([WORDS[:6], WORDS[6:12], WORDS[12:]]))
        assert channel.repair(" ".join(words) + ".")[0] == []
        i = rnd.choice([j for j, w in enumerate(words) if any(c in w for c in "nhtc")])
        c = rnd.choice([c for c in words[i] if c in "nhtc"])
        words[i] = words[i].replace(c, {"n": "u", "h": "b", "t": "f", "c": "e"}[c], 1)
        noise, text = channel.repair(" ".join(words) + ".")
        hit += noise == [(1, "misread")]
    assert hit >= 190


@pytest.mark.parametrize("share", [1e-3, 0.02])
def test_rare_pairs_count(spark, monkeypatch, share):
    """Pairs and tokens under the share of what is broadcast have their whole counts, by broadcast where there are few, else from a file."""
    clean, rec = corpus(spark)
    rare = [f"{w} {x} làng" for w, x in zip(WORDS, ("hiếm", "lạ", "hiếm", "hiếm", "nhỏ"))]
    rec = rec.unionByName(spark.createDataFrame([(1000 + i, None, None, t) for i, t in enumerate(rare)], rec.schema))
    ocr = spark.createDataFrame([(1, "qnan huyện xem xét\nquan hiêm làng\nhiếm làng", None)], "row_id long, text string, error string")
    pairs, n = {}, {}
    for t in (*clean, *rare, *(r.han for r in rec.where("han is not null").collect()), "qnan huyện xem xét\nquan hiêm làng\nhiếm làng"):
        ts = S.tokens(t)
        for a, b in zip([".", *ts], [*ts, "."]):
            pairs[a, b] = pairs.get((a, b), 0) + 1
            n[b] = n.get(b, 0) + 1
    want = {tuple(r) for r in S.noise(rec, ocr).collect()}
    monkeypatch.setattr(S, "PAIR_SHARE", share)
    channel = S.Channel(*S.fit(rec, ocr)[0].value)
    assert {p: channel.pairs.get(p, 0) for p in pairs} == pairs and {w: channel.n.get(w, 0) for w in n} == n
    assert channel.total == sum(n.values()) and channel.common == {w for w, k in n.items() if k >= 3 and w.isalpha()}
    assert channel.pairs.get(("làng", "quan"), 0) == 0 and ("làng", "quan") not in channel.pairs and ("quan", "hiếm") in channel.pairs
    assert {tuple(r) for r in S.noise(rec, ocr).collect()} == want


def test_neighbours_misread_into_common_words(spark):
    """Three words in a row, each misread into another common word, are mended together."""
    lines = ["đi nan ban can về."] * 300 + [f"kia {w} rồi." for w in ("nau", "bau", "cau")] * 100
    rec = spark.createDataFrame([(i, None, None, t) for i, t in enumerate(lines)], "row_id long, han string, han_raw string, meaning string")
    channel = S.Channel(*S.fit(rec, spark.createDataFrame([], "row_id long, text string, error string"))[0].value)
    assert channel.repair("đi nau bau cau về.") == ([(1, "misread")], "đi nan ban can về.")
    assert channel.repair("kia bau rồi.")[0] == []


def test_empty(spark):
    rec = spark.createDataFrame([], "row_id long, han string, han_raw string, meaning string")
    none = spark.createDataFrame([], "row_id long, text string, error string")
    assert S.noise(rec, none).count() == 0

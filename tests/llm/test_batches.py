"""What is done for many texts at once, in blocks or by halves gives what one by one gives."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from vellum.llm import codes
from vellum.llm import languages as L
from vellum.llm import scans as S
from vellum.llm import sentences as N
from vellum.llm import survivors as V

_HAN = "⺀-⿟㐀-鿿豈-﫿\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[{_HAN}]|[^\W\d_{_HAN}]+(?:[’'](?=[^\W\d_{_HAN}]))?")


def test_tokens_equal_patterns():
    rnd = random.Random(2)
    alphabet = "abĐđêÊÀ'’ 1２_.,\n百姓𠀀⺀ß​ǅ-"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(800)] + ["", "​"]
    number, text, place = codes.tokens(texts)
    seen: dict = {}
    k = 0
    for i, t in enumerate(texts):
        for m in _TOKEN.finditer(t.replace("​", "")):
            w = m[0].lower()
            assert text[k] == i and seen.setdefault(w, number[k]) == number[k]
            if "​" not in t:
                assert place[k] == m.start()
            k += 1
    assert k == len(number) and len(set(seen.values())) == len(seen)
    assert codes.is_han(number).sum() == sum(len(w) == 1 and bool(re.match(f"[{_HAN}]", w)) for t in texts for w in _TOKEN.findall(t.replace("​", "")))
    assert [x for a, b in codes.steps(texts, 100) for x in range(a, b)] == list(range(len(texts))) and list(codes.steps([], 5)) == []


def test_texts_that_are_not_opened_do_not_change():
    """A text that is scored as a whole and not opened has one segment, the same, however it is cut."""
    rnd = random.Random(3)
    words = {"vi": "quan huyện xem xét nhận thuế".split(), "en": "the officer looked at old boats".split(), "fr": "le mandarin regarde les vieux bateaux".split(), "lzh": list("河官修理石橋也之"), "zh": list("我们的书在这里了")}
    rows = [(lang, " ".join(rnd.choices(w, k=12))) for lang, w in words.items() for _ in range(60)]
    number, text, _ = codes.tokens([t for _, t in rows])
    n = np.zeros((len(number), 5), np.int64)
    n[np.arange(len(number)), [L.LANGS.index(rows[i][0]) for i in text]] = 1
    token, n = codes.distinct(number, n)
    labels = {(a, b): 0.0 if a == b else -3.0 for a in L.LANGS for b in L.LANGS}
    model = L.Text(token, n, n.sum(0), labels)
    texts = [". ".join(" ".join(rnd.choices(words[rnd.choice(list(words)) if mixed else lang], k=rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 6))) + "." for lang in words for mixed in (0, 1) for _ in range(80)]
    label = [rnd.choice([*L.LANGS, None]) for _ in texts]
    say = model.said(label, [None] * len(texts))
    lang, confidence, opens = model.whole(texts, say)
    assert 50 < opens.sum() < len(texts) - 50
    for i, t in enumerate(texts):
        for cut in (r"[^.]+\.?\s*", r"\S+\s*"):  # sentences, and as fine as can be
            got = model.segments(t, [(m.start(), m.end() - 1) for m in re.finditer(cut, t)], say[i])
            if not opens[i]:
                assert len(got) == 1 and got[0][2] == L.LANGS[lang[i]] and abs(got[0][3] - confidence[i]) < 1e-5
    assert model.whole(["", "…"], model.said([None] * 2, [None] * 2))[0].tolist() == [-1, -1]


def test_headers_of_small_works(spark):
    """A header of one work among a hundred is found on that work's pages, and is no header elsewhere."""
    rows, i = [], 0
    for w in range(100):
        for p in range(7):
            i += 1
            rows.append((i, f"Sách riêng số{'abcdefghij'[w % 10]}{'klmnopqrst'[w // 10]} bản\nquan huyện xem xét thuế muối.", None, f"w{w}", p))
    rows.append((i + 1, "Sách riêng sốak bản\nquan huyện xem xét thuế muối.", None, "w55", 99))
    ocr = spark.createDataFrame(rows, "row_id long, text string, error string, doc_id string, page_no int")
    rec = spark.createDataFrame([], "row_id long, han string, han_raw string, meaning string, source_doc string, page int")
    counted = S.count(rec.select(F.lit(None).cast("string").alias("han"), F.col("meaning").alias("shown"), F.lit(None).cast("string").alias("read"), F.lit("").alias("work"), "page").unionByName(ocr.select(F.lit(None).cast("string").alias("han"), F.col("text").alias("shown"), F.lit(None).cast("string").alias("read"), F.col("doc_id").alias("work"), F.col("page_no").alias("page"))))
    found = S.work_headers(counted).collect()
    assert len(found) == 100 and len({r.work for r in found}) == 100
    got = {(r.row_id, r.line_no) for r in S.noise(rec, ocr).where("noise = 'furniture'").collect()}
    assert {(k, 1) for k in range(1, i + 1)} <= got


def test_headers_count_in_their_own_work(spark, monkeypatch):
    monkeypatch.setattr(S, "SHAPE_SHARE", 0.9)
    page = "Sách của riêng một kho\nquan huyện xem xét thuế muối."
    ocr = spark.createDataFrame([(p, page, None, "a", p) for p in range(8)] + [(100, page, None, "b", 1)], "row_id long, text string, error string, doc_id string, page_no int")
    rec = spark.createDataFrame([], "row_id long, han string, han_raw string, meaning string, source_doc string, page int")
    got = {r.row_id for r in S.noise(rec, ocr).where("noise = 'furniture'").collect()}
    assert got == set(range(8))


def test_second_reader_decides(spark):
    channel = S.Channel({("河", "官"): 50, (".", "河"): 50, ("官", "."): 50}, {"河": 50, "官": 50, ".": 50}, 150, {}, [])
    assert channel.repair("河宫", "河官")[0] == [(1, "misread")] and channel.repair("河宫", "河官")[1] == "河官"
    assert channel.repair("河\n官", "河官")[0] == [] and channel.repair("河宫", None)[0] == []


def test_packed_claims_equal_joined(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["d", "e", "hot"]), rnd.choice(["m", "n", "o"]), rnd.randrange(4), f"văn {rnd.randrange(3)}", rnd.choice([0.5, 0.7, None]), None, None) for i in range(300)]
    ocr = spark.createDataFrame(rows, "row_id long, doc_id string, model_name string, page_no int, text string, confidence double, error string, created_at string")
    a = V.answers(ocr, spark.createDataFrame([], "model_name string, trust_rank int"))
    want = sorted(map(tuple, V.discover(a)[0].collect()))
    for name, value in (("PACKED_CLAIMS", 0), ("PACKED_CLAIMS", 7), ("BROADCAST_SOURCES", 1)):
        with monkeypatch.context() as m:
            m.setattr(V, name, value)
            assert sorted(map(tuple, V.discover(a)[0].collect())) == want


def test_units_in_blocks(spark, monkeypatch):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["Một câu.", "Hai!", "三人行。", "四", " ", "\n"]) for _ in range(rnd.randrange(40))) for _ in range(60)] + ["", " ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = df.select("i", N.units(F.col("t")).alias("u")).orderBy("i").collect()
    for n in (1, 3):
        monkeypatch.setattr(N, "BLOCK", n)
        assert df.select("i", N.units(F.col("t")).alias("u")).orderBy("i").collect() == want

"""Sentence units on literal texts of each habit, on dirt, and on arrays."""

import pytest
from pyspark.sql import functions as F

from vellum.llm import sentences as S
from vellum.llm.bilingual import latin_ends

CASES = [
    ("里民呈報桐油四十兩，水勢漸退。河官修橋！", ["里民呈報桐油四十兩，水勢漸退。", "河官修橋！"]),
    ("戶部查點計61.7兩(T. 282, tr. 9). 次日田主交納．", ["戶部查點計61.7兩(T. 282, tr. 9).", "次日田主交納．"]),
    ("巡檢查點稱：\"次日驛卒製造.夏中織婦減免.\"禮官補足.", ["巡檢查點稱：\"次日驛卒製造.夏中織婦減免.\"", "禮官補足."]),
    ("據河官稱：「堤已完。橋已修。」等因。倉官請領。", ["據河官稱：「堤已完。橋已修。」等因。", "倉官請領。"]),
    ("據河官稱：『甲○乙○』云云○倉官請領○", ["據河官稱：『甲○乙○』云云○", "倉官請領○"]),
    ("石工也者買入文書耳樂工抄錄田稅欽此焉能不三月借用紙張焉", ["石工也者買入文書耳", "樂工抄錄田稅欽此", "焉能不三月借用紙張焉"]),
    ("書吏呈報奉　聖旨准免　營兵修理", ["書吏呈報奉　聖旨准免", "營兵修理"]),
    ("樂工驗收金器\n八月府尹換取油燈", ["樂工驗收金器", "八月府尹換取油燈"]),
    ("匠人交納公田, 天雨連日", ["匠人交納公田, 天雨連日"]),
    ("土司製造銅錢？！巡檢到○", ["土司製造銅錢？！", "巡檢到○"]),
    ("謹‍奏", ["謹‍奏"]),
    ("𠀀甲。𠀁乙", ["𠀀甲。", "𠀁乙"]),
    ("Giá 1.731 quan, cùng muối, v.v. Lính trạm (tr. 5) tới… Hết", ["Giá 1.731 quan, cùng muối, v.v.", "Lính trạm (tr. 5) tới…", "Hết"]),
    ("Ông nói: “Tại xã. Ở đây.” như vậy. Dân chài tới!", ["Ông nói: “Tại xã. Ở đây.” như vậy.", "Dân chài tới!"]),
    ("Quan nói: “Đi. Về.” Dân ở lại.", ["Quan nói: “Đi. Về.”", "Dân ở lại."]),
    ("See Dr. Lee on fol. 12.5 at http://a.b/c.d now. Next?", ["See Dr. Lee on fol. 12.5 at http://a.b/c.d now.", "Next?"]),
    ("", []), (" 　\n", []), ("。", ["。"]), ("\"甲。乙", ["\"甲。", "乙"]),
]


def cut(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = {i: [] for i in range(len(texts))}
    for r in df.select("id", F.explode(S.units(F.col("t"))).alias("u")).orderBy("id", "u.start").collect():
        out[r.id].append(texts[r.id][r.u.start : r.u.last + 1])
    return [out[i] for i in range(len(texts))]


def test_literals(spark):
    for (text, want), got in zip(CASES, cut(spark, [c[0] for c in CASES])):
        assert got == want, text


def test_latin_twin(spark):
    texts = [t for t, _ in CASES if t.isascii() and t.strip() and t[0] != "\"" or t[:3] in ("Giá", "Ông")]
    for t, got in zip(texts, cut(spark, texts)):
        assert [t[a : b + 1] for a, b in latin_ends(t)] == got


def test_long_text_is_linear(spark):
    text = "河官修橋。" * 4000 + "（" + "甲。" * 2000
    assert len(cut(spark, [text])[0]) == 6000


def test_ends(spark):
    rec = spark.createDataFrame([(1, "甲。乙", 0), (1, "甲。乙", 0), (2, None, 0), (3, "", 0), (None, "丙", 0)], "row_id long, han string, table_name int")
    al = spark.createDataFrame([(1, ["案、", "夜", "火○", "又", None, "也。"]), (2, None), (3, []), (4, ["7", "6.", "7", "畝．"])], "row_id long, sn_chars array<string>")
    got = sorted((r.table_name, -1 if r.row_id is None else r.row_id, r.end_pos) for r in S.ends(rec, al).collect())
    assert got == [("aligned_sentences", 1, 2), ("aligned_sentences", 1, 5), ("aligned_sentences", 4, 3), ("records", -1, 0), ("records", 1, 1), ("records", 1, 2)]
    assert S.ends(rec.limit(0), al.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a\x00b. C", "‘’“”「」『』«»()（）", "." * 500])
def test_odd(spark, text):
    assert cut(spark, [text])[0]

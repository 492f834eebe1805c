"""The alignment run beyond what a sentence id has room for, and the edit script of lists that share no token."""

import random

import duckdb
from vellum.operators import alignment as A
from vellum.plans import pages


def test_alignment_run_beyond_the_ids(spark, tmp_path):
    rows = [(i, 1, 1, ["人", "日"], ["nhân", "nhật"]) for i in range(1, 103)]  # more columns than two digits count
    rows += [(200, 1000, 3, ["人"], ["nhân", "x"]), (201, 3, 1000, ["日", "人"], None), (202, None, 2, ["人"], ["nhân"]), (203, 4, None, ["人"], ["x"])]
    rows += [(None, 5, 1, ["日"], ["nhân"]), (204, 5, 1, ["人"], ["nhân"]), (205, 0, -1, ["人"], ["nhân"]), (206, 6, 1, [], [])]
    spark.createDataFrame(rows, "row_id long, chapter int, page int, sn_chars array<string>, qn_words array<string>").write.parquet(f"{tmp_path}/aligned_sentences.parquet")
    spark.createDataFrame([("日", 1, "人")], "sn string, rank_no int, similar_char string").write.parquet(f"{tmp_path}/similar_chars.parquet")
    spark.createDataFrame([("nhân", "人")], "qn string, sn string").write.parquet(f"{tmp_path}/translit.parquet")
    con = duckdb.connect()
    for t in ("aligned_sentences", "similar_chars", "translit"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = pages.QUERIES["alignment_run"](spark, str(tmp_path)).select("row_id", "sentence_id", "pairs", "share", "distance").collect()
    expected = con.sql(f"select row_id, sentence_id, pairs, share, distance from ({pages.SQL['alignment_run']})").fetchall()
    assert len(got) == 108 and sorted(map(tuple, got)) == sorted(expected)


def test_edit_script_without_common_tokens():
    def plain(a, b):
        both = [*a, "same"], [*b, "same"]  # a token in both lists, so the whole table is made
        pairs, cost = A.edit_script(*both)
        assert pairs[-1] == ("same", "same")
        return pairs[:-1], cost

    rng = random.Random(5)
    for _ in range(300):
        a, b = [rng.choice("abc") for _ in range(rng.randrange(8))], [rng.choice("xyz") for _ in range(rng.randrange(8))]
        assert A.edit_script(a, b) == plain(a, b)

"""Survivors against SQL and brute force."""

import math
import random

import pytest

from vellum.llm import survivors as S

OCR = "row_id long, doc_id string, model_name string, page_no int, text string, confidence double, error string, created_at string, source string"
MODELS = "model_name string, trust_rank int"


def rows_of(rnd, n):
    out = []
    for i in range(n):
        doc = "hot" if rnd.random() < 0.35 else rnd.choice(["a", "B ", " b", "c", None])
        out.append((
            i + 1, doc, rnd.choice(["m1", " M1", "m2", "zz", None]), rnd.choice([1, 2, None]), rnd.choice([None, "", "--", "văn", "văn bản", "văn bản dài", "百姓" * 5]),
            rnd.choice([None, 0.0, -1.0, 0.5, 0.9, 1.0, 90.0]), rnd.choice([None, " ", "　", "time-out"]), rnd.choice([None, "2024-01-01T00:00:00Z", "2024-01-01T03:00:00+07:00", "2024-01-02T00:00:00"]), "x",
        ))
    return out + out[:3]


def brute(rows, ranks):
    import datetime as d

    seen = {}
    for r in rows:
        seen.setdefault(r[0], r)
    groups = {}
    for r in seen.values():
        if r[1] is not None and r[3] is not None:
            groups.setdefault((r[1].strip().lower(), r[3]), []).append(r)
    out = set()
    for g in groups.values():
        if len(g) < 2:
            continue

        def key(r):
            at = r[7]
            t = d.datetime.fromisoformat(at if not at or at.endswith("Z") or "+" in at else at + "+00:00") if at else None
            return ranks.get((r[2] or "").strip().lower(), 10**9), -(t.timestamp()) if t else 1e18, r[0]

        ok = [r for r in g if not (r[6] or "").strip()]
        texts = [r for r in ok if r[4] and any(c.isalpha() for c in r[4])]
        top = max((len(r[4]) for r in texts), default=0)
        texts = [r for r in texts if len(r[4]) * 10 >= top * 8]
        confs = [r for r in ok if r[5] is not None and 0 < r[5] <= 1]
        out.add((min(r[0] for r in g), min(texts, key=key)[0] if texts else -1, min(confs, key=key)[0] if confs else -1))
    return out


def test_precedence_equals_brute_force(spark):
    for seed in range(3):
        rows = rows_of(random.Random(seed), 120)
        models = spark.createDataFrame([("M1 ", 2), ("m2", 1), (None, 3)], MODELS)
        got = S.by_precedence(S.answers(spark.createDataFrame(rows, OCR), models)).collect()
        assert {tuple(r) for r in got} == brute(rows, {"m1": 2, "m2": 1})
        assert len(got) == len({r.group_id for r in got})


def test_empty(spark):
    none = S.answers(spark.createDataFrame([], OCR), spark.createDataFrame([], MODELS))
    assert S.by_precedence(none).count() == 0
    assert S.discover(none)[0].count() == 0


def test_truth_discovery_follows_the_reliable(spark):
    rows, i = [], 0
    for page in range(40):
        for model, text in (("good", "đúng"), ("good2", "đúng"), ("bad", f"sai{page}a")) if page < 30 else (("good", "đúng"), ("bad", f"sai{page}b")):
            i += 1
            rows.append((i, "d", model, page, text, None, None, None, "x"))
    best, weights = S.discover(S.answers(spark.createDataFrame(rows, OCR), spark.createDataFrame([], MODELS)))
    w = {r.source: r.weight for r in weights.collect() if r.field == "text"}
    assert w["good"] > w["bad"]
    models = {r[0]: r[2] for r in rows}
    got = best.where("field = 'text'").collect()
    assert len(got) == 40 and all(models[r.value_from].startswith("good") for r in got)


def test_truth_discovery_ends_converged(spark):
    """Rounds that run out while reliabilities move are an error, and a finished iteration does not move any more."""
    rows = [(5 * p + k, "d", m, p, f"văn {v}", None, None, None, "x") for p in range(12) for k, (m, v) in enumerate((("a", 0), ("b", p % 2), ("c", p % 3), ("d", p % 5)))]
    rows = S.answers(spark.createDataFrame(rows, OCR), spark.createDataFrame([], MODELS))
    with pytest.raises(RuntimeError, match="still move"):
        S.discover(rows, rounds=1)
    loose, tight = ({(r.source, r.field): r.weight for r in S.discover(rows, moved=m)[1].collect()} for m in (S.MOVED, 1e-7))
    assert all(abs(math.exp(-loose[k]) - math.exp(-tight[k])) < 20 * S.MOVED for k in tight)

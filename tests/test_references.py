"""Orphan references against brute force, with nulls, ties, repeats, hot keys and empty tables."""

import random

from vellum.operators import references as R

REC = "row_id long, job_id long, human_id string, part_of string, reviewed_by int, created_at double, reviewed_at double, salt int, key string"
JOB, USER, GONE = "id long, created_at double", "id int, created_at double", "table_name string, job_id long, key_text string, removed_at double"


def brute(recs, jobs, users, gone):
    out = set()

    def judge(kind, scope, key, at):
        ups = {"job_id": [t for i, t in jobs if str(i) == key], "reviewed_by": [t for i, t in users if str(i) == key], "part_of": [r[5] for r in recs if r[1] == scope and r[2] == key]}[kind]
        table = {"job_id": "jobs", "reviewed_by": "users", "part_of": "records"}[kind]
        downs = [g[3] for g in gone if g[0] == table and g[2] == key and (table != "records" or g[1] == scope)]
        if downs and not any(u >= max(downs) for u in ups):
            return "deleted"
        if not ups:
            return "missing"
        return "later" if min(ups) > at else None

    for r in recs:
        for kind, key, at in (("job_id", r[1], r[5]), ("part_of", r[3], r[5]), ("reviewed_by", r[4], r[6] if r[6] is not None else r[5])):
            if key is None or key == "":
                continue
            if reason := judge(kind, r[1], str(key), at):
                out.add((r[0], kind, reason))
    return out


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    recs = []
    for i in range(400):
        job = 1 if rnd.random() < 0.4 else rnd.choice([None, 2, 3, 4, 9])
        recs.append((i, job, f"h{rnd.randrange(60)}", rnd.choice([None, "", f"h{rnd.randrange(80)}"]), rnd.choice([None, 1, 2, 7]), float(rnd.randrange(1000)), rnd.choice([None, float(rnd.randrange(1000))]), 0, "x"))
    recs += recs[:5]
    jobs = [(1, 5.0), (1, 5.0), (2, 500.0), (4, 100.0)]
    users = [(1, 0.0), (2, 900.0), (2, 950.0)]
    gone = [("jobs", None, "4", 50.0), ("jobs", None, "9", 10.0), ("records", 1, "h3", 400.0), ("users", None, "1", 300.0), ("users", None, "7", 1.0), (None, None, None, None)]
    got = R.record_references(spark.createDataFrame(recs, REC), spark.createDataFrame(jobs, JOB), spark.createDataFrame(users, USER), spark.createDataFrame(gone, GONE))
    rows = [(r.row_id, r.field_name, r.reason) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(recs, jobs, users, gone)


def test_empty_tables(spark):
    recs = spark.createDataFrame([(1, 5, "a", "b", 3, 0.0, None, 0, "x"), (2, None, None, None, None, None, None, 0, None)], REC)
    none = [spark.createDataFrame([], s) for s in (JOB, USER, GONE)]
    got = {(r.row_id, r.field_name, r.reason, r.period) for r in R.record_references(recs, *none).collect()}
    assert got == {(1, f, "missing", "1970-01") for f in ("job_id", "part_of", "reviewed_by")}
    assert R.record_references(spark.createDataFrame([], REC), *none).count() == 0


def test_hot_key_is_salted(spark):
    refs = spark.range(5000).selectExpr("'k' as kind", "'' as scope", "cast(if(id % 3 = 0, 1, id) as string) as key", "1.0D as at", "id as salt_by")
    up = spark.range(0, 4000).selectExpr("'k' as kind", "'' as scope", "cast(id as string) as key", "0.0D as at")
    gone = spark.createDataFrame([], "kind string, scope string, key string, at double")
    assert R.dangling(refs, up, gone).count() == sum(1 for i in range(5000) if i % 3 and i >= 4000)

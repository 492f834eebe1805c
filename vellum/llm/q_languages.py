"""Queries of problem 9."""

from vellum.llm import languages as L
from vellum.tables import load


def p9_found(spark, d):
    return L.found(load(spark, d, "documents"))


def p9_segments(spark, d):
    return L.segments(load(spark, d, "documents"))


QUERIES = {"p9_found": p9_found, "p9_segments": p9_segments}
SQL = {}

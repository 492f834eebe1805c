"""Queries of problem 2."""

from vellum.llm import bilingual as B
from vellum.tables import load


def p2_found(spark, d):
    return B.found(load(spark, d, "records"), load(spark, d, "aligned_sentences"))


QUERIES = {"p2_found": p2_found}
SQL = {}

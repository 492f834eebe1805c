"""Queries of problem 6."""

from vellum.llm import scans as S
from vellum.tables import load


def p6_found(spark, d):
    return S.noise(load(spark, d, "records"), load(spark, d, "ocr_results"))


def p6_repaired(spark, d):
    return S.repaired(load(spark, d, "records"), load(spark, d, "ocr_results"))


QUERIES = {"p6_found": p6_found, "p6_repaired": p6_repaired}
SQL = {}

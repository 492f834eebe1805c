"""Queries of problem 1."""

from vellum.llm import sentences as S
from vellum.tables import load


def p1_found(spark, d):
    return S.ends(load(spark, d, "records"), load(spark, d, "aligned_sentences"))


def p1_documents(spark, d):
    return S.sentences(load(spark, d, "documents"), "text", "doc_id")


QUERIES = {"p1_found": p1_found, "p1_documents": p1_documents}
SQL = {}

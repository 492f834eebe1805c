"""Queries of problem 8."""

from vellum.llm.packing import fill, pack_documents
from vellum.tables import load


def p8_containers(spark, d):
    return pack_documents(load(spark, d, "documents"))


def p8_fill(spark, d):
    return fill(p8_containers(spark, d))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
SQL = {}

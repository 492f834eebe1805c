"""Query of problem 7; a round trip through the vocabulary tests it."""

from vellum.llm.encoding import encode
from vellum.tables import load


def p7_ids(spark, d):
    return encode(load(spark, d, "documents"))


QUERIES = {"p7_ids": p7_ids}
SQL = {}

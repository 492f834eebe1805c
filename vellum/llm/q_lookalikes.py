"""Queries of problem 5."""

from vellum.llm import lookalikes as L
from vellum.tables import load


def p5_found(spark, d):
    return L.changed(load(spark, d, "records"), load(spark, d, "detections"))


def p5_forms(spark, d):
    return L.forms(load(spark, d, "records"), load(spark, d, "detections"))


QUERIES = {"p5_found": p5_found, "p5_forms": p5_forms}
SQL = {}

"""Identifiers are read out of a parsed document by casts, once for lists and once for single ones."""

import json

import pytest
from pyspark.sql import functions as F

from tidegraph.functions import jsontext
from tidegraph.plans.queries import registered_queries

ODD = [
    ({"a": {"data": {"type": "t", "id": "1"}}, "b": [], "c": "x", "d": None}, [("t", "1")]),
    ({"a": {"data": [None, 3, [{"type": "t", "id": "9"}], {"type": "t", "id": "2"}, {"id": "3"}]}}, [("t", "2")]),
    ({"a": {"data": [{"type": "t", "id": v} for v in (1, 1.5, True, None, [], {}, 10**30, "", "true")]}}, [("t", ""), ("t", "true")]),
    ({"a": {"data": {"type": 7, "id": "1"}}, "b": {"data": {"type": "t", "id": "ü\u0000'\"\\"}}}, [("t", "ü\u0000'\"\\")]),
    ({"a": {"data": {"type": "t", "id": "1", "meta": {"k": [1]}}}, "b": {"data": [{"type": "t", "id": "1"}] * 2}}, [("t", "1")]),
    ({"": {"data": {"type": "b", "id": "1"}}, "data": {"data": [{"type": "a", "id": "2"}]}}, [("a", "2"), ("b", "1")]),
    ({}, []),
    ([{"data": {"type": "t", "id": "1"}}], []),
    ("text", []),
    (None, []),
]


@pytest.mark.parametrize("nested", [False, True])
def test_only_strings_of_the_right_place_are_identifiers(spark, nested):
    texts = [json.dumps({"relationships": value} if nested else value) for value, _ in ODD]
    path = "$.relationships" if nested else "$"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    ids = jsontext.identifiers(jsontext.parsed(F.col("t")), path)
    rows = df.select("i", ids.alias("ids")).orderBy("i").collect()
    assert [[tuple(r) for r in row["ids"]] for row in rows] == [want for _, want in ODD]


def test_a_document_is_parsed_once_and_no_kind_is_looked_up(spark, capsys):
    registered_queries()["relationship_extraction"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("parseJson(") == 1
    assert "get_json_object" not in plan and "schema_of_variant" not in plan

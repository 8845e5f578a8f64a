import pytest
from pyspark.sql import functions as F

from rankloom.functions import answers

FULL = '{"C1": 1, "C2": 0}'


@pytest.mark.parametrize("text,category,verdicts", [
    (f'{{"doc_1": {{"criteria": {FULL}}}, "Document 2": {{"criteria": {{"C2": "1", "C1": "0"}}}}}}', "ok", {1: [1, 0], 2: [0, 1]}),
    (f'<think>{{}}</think> so: ```json\n{{"1": {{"criteria": {FULL}, "why": "x"}}, "2": {{"criteria": {FULL}}}}}\n```', "ok", {1: [1, 0], 2: [1, 0]}),
    (f'{{"1": {{"criteria": {FULL}}}}}', "incomplete", None), (f'{{"1": {{"criteria": {FULL}}}, "3": {{"criteria": {FULL}}}}}', "schema", None),
    (f'{{"1": {{"criteria": {FULL}}}, "doc_1": {{"criteria": {FULL}}}}}', "schema", None), (f'{{"1": {{"criteria": {FULL}}}, "1": {{"criteria": {FULL}}}}}', "duplicate", None),
    ('{"1": {"criteria": {"C1": 1}}, "2": {"criteria": {"C1": 1}}}', "schema", None), ('{"1": {"criteria": {"C1": 1, "C2": 0, "C3": 1}}}', "schema", None),
    ('{"1": {"criteria": {"C1": true, "C2": 0}}}', "schema", None), ('{"1": {"criteria": {"C1": 1.0, "C2": 0}}}', "schema", None), ('{"1": {"criteria": {"C1": 2, "C2": 0}}}', "schema", None),
    ('{"1": {"criteria": {"C1": null, "C2": 0}}}', "schema", None), ('{"1": 1}', "schema", None), ('{"1": {"criteria": [1, 0]}}', "schema", None), (f'{{"zero": {{"criteria": {FULL}}}}}', "schema", None),
    (f'{{"1": {{"criteria": {FULL}}}', "json", None), ("none", "empty", None), ("", "empty", None), (None, "empty", None),
])
def test_rubric_answers(text, category, verdicts):
    assert answers.rubric(text, 2, 2) == {"category": category, "verdicts": verdicts}


def test_rubric_windows_and_columns(spark):
    for slots, criteria in ((0, 2), (2, 0)):
        with pytest.raises(ValueError):
            answers.rubric("{}", slots, criteria)
    rows = spark.createDataFrame([(f'{{"1": {{"criteria": {FULL}}}}}', 1), (None, 3)], "t string, n int")
    got = rows.select(answers.rubric_verdicts(F.col("t"), F.col("n"), 2).alias("r")).collect()
    assert [(g.r.category, g.r.verdicts) for g in got] == [("ok", {1: [1, 0]}), ("empty", None)]


def test_verdict_vectors(spark):
    row = lambda m: spark.createDataFrame([(m,)], "m map<string, int>").select(answers.verdict_vector(F.col("m"), ["C1", "C2"]).alias("v"))
    assert row({"C2": 1, "C1": 0}).first().v == [0, 1]
    for bad in ({"C1": 1}, {"C1": 1, "C2": 2}, {"C1": 1, "C3": 1}, {"C1": 1, "C2": 1, "C3": 0}, {"C1": None, "C2": 0}):
        with pytest.raises(Exception, match="do not cover"):
            row(bad).collect()

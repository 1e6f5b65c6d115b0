import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cueline.operators.utterance import to_utterances
from cueline.sources import subtitles, tables

TEXT = "1\n00:00:01,000 --> 00:00:02,500\nOne\ntwo.\n\n2\n0:00:03.5 --> 1:00:04 X1:1 X2:2 Y1:3 Y2:4\nThree\n"


def test_parse_srt_in_sql_equals_the_reader(spark):
    tables.register(spark)
    files = spark.createDataFrame([("a", TEXT), ("b", ""), ("c", None), (None, TEXT)], "path string, content string")
    found = spark.sql("SELECT path AS filepath, cues.* FROM {files} f, LATERAL parse_srt(path, f.content) AS cues", files=files)
    names = ["filepath", "idx", "line_idx", "timestamp_start", "timestamp_end", "content", "x1", "y1", "x2", "y2"]
    read = subtitles.parse_srt(files.where("path = 'a'"), remove_html=False).select(names)
    assert sorted(map(tuple, found.where("path = 'a'").select(names).collect())) == sorted(map(tuple, read.collect()))
    assert found.where("path is null").count() == 2 and found.where("path in ('b', 'c')").count() == 0


def test_bad_lines_are_rows_with_errors(spark):
    tables.register(spark)
    files = spark.createDataFrame([("a", "x\n"), ("b", "1\n99:00:00,000 --> 00:00:01,000\nx\n"), ("c", "1\nno\n")], "path string, content string")
    found = spark.sql("SELECT path, error FROM {files}, LATERAL parse_srt(path, content)", files=files.withColumnRenamed("content", "content"))
    assert {p: e.split(": ", 1)[1].split(":")[0] for p, e in found.collect()} == {"a": "no index", "b": "bad timestamps", "c": "no timestamps"}
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM parse_srt('x', 1)")


def test_utterances_in_sql_equal_the_operator(spark):
    tables.register(spark)
    rng = random.Random(3)
    said = ["yes.", "and then", "- who? - me", "- alone", "- a - b - c", "what -", "", None, "- x - y.", " trail "]
    rows = [(f, i, i + 1, float(i), i + 0.5, rng.choice(said), None, "n") for f in ("a", "b", None) for i in range(60)]
    cues = spark.createDataFrame(rows, "filepath string, idx long, line_idx long, timestamp_start double, timestamp_end double, content string, embedding array<double>, n string")
    cues = cues.repartition(5, F.rand(1))
    want = to_utterances(cues).drop("embedding")
    found = spark.sql("SELECT * FROM to_utterances(TABLE({cues}))", cues=cues).select(want.columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert spark.sql("SELECT * FROM to_utterances(TABLE({cues}))", cues=cues.where("false")).count() == 0
    with pytest.raises(AnalysisException, match="lack content"):
        spark.sql("SELECT * FROM to_utterances(TABLE({cues}))", cues=cues.drop("content")).count()


@pytest.mark.parametrize("code, value", [("1:02:03", 3723.0), ("01:02:03,5", 3723.5), ("2:03.25", 123.25), ("7.125", 7.125), ("2:03", None), ("24:00:00", None), (None, None)])
def test_seconds(code, value):
    assert tables.seconds(code) == value

import os
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cueline.functions.text import clean_srt_text
from cueline.sources import datasource, media, subtitles

TEXT = "1\n00:00:01,000 --> 00:00:02,500\n<i>One</i>\ntwo.\n\n2\n0:00:03.5 --> 1:00:04 X1:1 X2:2 Y1:3 Y2:4\nThree\n"


@pytest.fixture
def folder(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.srt").write_text(TEXT)
    (tmp_path / "in" / "deep" / "b.srt").write_bytes("7\r\n00:00:01,000 --> 00:00:02,000\r\nÄ b\x0cc\r\n".encode("utf-16"))
    (tmp_path / "in" / "empty.srt").write_text("")
    (tmp_path / "in" / "_hidden").write_text("no")
    return str(tmp_path)


def rows(table, *columns):
    short = F.regexp_extract("filepath", r"[^/]*$", 0)
    return sorted(map(tuple, table.withColumn("filepath", short).select("filepath", *columns).collect()), key=repr)


def test_formats_equal_the_readers(spark, folder):
    columns = [c for c in subtitles.parse_srt(spark.createDataFrame([], "path string, content string")).columns if c != "filepath"]
    names = [f"{folder}/in/{x}" for x in ("a.srt", "deep/b.srt", "empty.srt")]
    for size in (1, 1 << 20):
        found = spark.read.format("cueline_srt").option("partitionBytes", size).load(f"{folder}/in")
        assert rows(found, *columns) == rows(subtitles.read_srt(spark, names, remove_html=False), *columns)
        assert rows(found.withColumn("content", clean_srt_text(F.col("content"), True)), *columns) == rows(subtitles.read_srt(spark, names), *columns)
        assert found.rdd.getNumPartitions() == (3 if size == 1 else 1)
    one = f"{folder}/in/a.srt"
    assert rows(spark.read.format("cueline_lines").load(one), "line_idx", "raw") == rows(media.read_screenplay_lines(spark, one), "line_idx", "raw")


def test_bad_files(spark, folder):
    for name, text in (("x.srt", "1\nno\n"), ("y.srt", "1\n99:00:00,000 --> 00:00:01,000\nx\n")):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
        read = spark.read.format("cueline_srt")
        with pytest.raises(PySparkException):
            read.load(f"{folder}/{name}").count()
        errors = [r["error"] for r in spark.read.format("cueline_srt").option("mode", "PERMISSIVE").load(f"{folder}/{name}").collect()]
        assert len(errors) == 1 and "timestamps" in errors[0]
    with pytest.raises(PySparkException):
        spark.read.format("cueline_srt").load(f"{folder}/nowhere").count()


def test_written_files_are_read_back(spark, folder):
    read = lambda path: spark.read.format("cueline_srt").load(path)
    cues = read(f"{folder}/in")
    datasource.write_srt(cues.repartition(3), f"{folder}/out")
    columns = ["idx", "timestamp_start", "timestamp_end", "content", "x1", "x2", "y1", "y2"]
    assert rows(read(f"{folder}/out"), *columns) == rows(cues, *columns)
    assert sorted(os.listdir(f"{folder}/out")) == ["a.srt", "b.srt"]
    with pytest.raises(PySparkException):  # the names are there
        datasource.write_srt(cues, f"{folder}/out")
    with pytest.raises(PySparkException):  # a cue without text
        datasource.write_srt(cues.withColumn("content", F.when(F.col("idx") == 2, "").otherwise("x")), f"{folder}/other")
    assert [x for _, _, n in os.walk(f"{folder}/other") for x in n] == []
    datasource.write_srt(cues.where("idx = 7"), f"{folder}/out", "overwrite")
    assert os.listdir(f"{folder}/out") == ["b.srt"]


def test_streams_take_each_file_once(spark, folder):
    def run():
        found = spark.readStream.format("cueline_srt").option("settle", 0).load(f"{folder}/in")
        query = found.select("filepath", "idx").writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/sunk")
        query.awaitTermination(60)
        query.stop()
        return rows(spark.read.schema("filepath string, idx long").parquet(f"{folder}/sunk"), "idx")

    assert run() == [("a.srt", 1), ("a.srt", 2), ("b.srt", 7)]
    time.sleep(0.1)
    with open(f"{folder}/in/late.srt", "w") as f:
        f.write(TEXT)
    # A restart goes on from the checkpoint's offset.
    assert run() == [("a.srt", 1), ("a.srt", 2), ("b.srt", 7), ("late.srt", 1), ("late.srt", 2)]

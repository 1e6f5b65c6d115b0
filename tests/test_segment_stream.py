import random

from cueline.operators.utterance import to_utterances
from cueline.streaming.utterances import segment_stream

KIND = "filepath string, idx long, line_idx long, timestamp_start double, timestamp_end double, content string, embedding array<double>"


def rows(seed):
    rng = random.Random(seed)
    said = ["yes.", "and then", "- who? - me", "- alone", "so", "and", None]
    return [(f, i, i + 1, float(i), i + 0.5, rng.choice(said), None) for f in ("a", "b") for i in range(25)]


def feed(spark, folder, out, checkpoint, idle=600_000):
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder)
    return segment_stream(stream, idle).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out)


def done(spark, out):
    from cueline.streaming.utterances import SEGMENTS

    return spark.read.schema(SEGMENTS).parquet(out)


def test_any_split_over_restarts_gives_the_same_utterances(spark, tmp_path):
    own, (folder, out, checkpoint) = rows(1), [str(tmp_path / x) for x in ("in", "out", "check")]
    ends = [("a", 98, 99, 98.0, 98.5, "not ended", None), ("b", 99, 100, 99.0, 99.5, "the end", None)]
    late, other = [("a", 3, 4, 3.0, 3.5, "late one", None)], [("c", 0, 1, 0.0, 0.5, "x.", None)]
    parts = [([r for r in own if r[1] < 7], 600_000), ([r for r in own if r[1] >= 7], 600_000), (late + ends, 1), (other, 600_000)]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for part, idle in parts:
            spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(folder)
            # Each part is a run of its own: the open utterance comes from the checkpoint, and in the last one patience with a and b is over.
            assert feed(spark, folder, out, checkpoint, idle).trigger(availableNow=True).start().awaitTermination(60)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    found = done(spark, out)
    assert [(r["filepath"], r["idx"], r["content"]) for r in found.where("late").collect()] == [("a", None, "late one")]
    want = to_utterances(spark.createDataFrame(own + ends + other, KIND)).select([c for c in found.columns if c != "late"])
    assert sorted(map(str, map(tuple, found.where("not late").drop("late").collect()))) == sorted(map(str, map(tuple, want.collect())))

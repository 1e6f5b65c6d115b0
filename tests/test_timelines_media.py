import pytest
from pyspark.sql import functions as F

from cueline.errors import DatasetError, ShotError, VideoError
from cueline.functions import grid, mime, text, timecode
from cueline.operators import models, sprites
from cueline.operators.timeline import Timeline
from cueline.plans.extract import main
from cueline.sources import media, sinks
from cueline.streaming.utterances import stream_utterances

TIMES = [0.0, 1.5, 1.5, 4.0, 9.0]


def timeline(spark):
    return Timeline(spark.createDataFrame([(t, f"v{i}") for i, t in enumerate(TIMES)], "timestamp_start double, v string"))


def test_scalar_lookups(spark):
    own = timeline(spark)
    at = lambda r: r["timestamp_start"]
    assert len(own) == 5
    assert [at(own.find_lt(4)), at(own.find_le(4)), at(own.find_gt(4)), at(own.find_ge(4)), at(own.find_nearest(2.75)), at(own.find_nearest(8))] == [1.5, 4.0, 9.0, 4.0, 1.5, 9.0]
    for find, t in ((own.find_lt, 0), (own.find_le, -1), (own.find_gt, 9), (own.find_ge, 10)):
        with pytest.raises(DatasetError):
            find(t)
    assert [at(r) for r in own.find_between(1.5, 4).collect()] == [1.5, 1.5, 4.0]
    with pytest.raises(ValueError):
        own.find_between(2, 1)
    assert at(own[0]) == 0.0 and at(own[-1]) == 9.0 and sorted(at(r) for r in own[1:-1].collect()) == [1.5, 1.5, 4.0]
    with pytest.raises(DatasetError):
        own[5]
    assert [t for t, _ in own] == TIMES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "code, seconds",
    [("1:02:03", 3723.0), ("01:02:03,5", 3723.5), ("23:59:59.999999", 86399.999999), ("2:03.25", 123.25), ("7.125", 7.125), ("2:03", None), ("24:00:00", None), ("x", None), ("1:60:00", None)],
)
def test_timecodes(spark, code, seconds):
    assert one(spark, timecode.timecode_seconds(F.lit(code))) == seconds


def test_intervals(spark):
    halves = one(spark, F.struct(timecode.first_half(F.lit(1.0), F.lit(4.0)).alias("a"), timecode.second_half(F.lit(1.0), F.lit(4.0)).alias("b")))
    assert [tuple(halves["a"]), tuple(halves["b"])] == [(1.0, 2.5), (2.5, 4.0)]
    assert one(spark, timecode.to_seconds(F.expr("interval '1 02:00:03.5' day to second"), "interval")) == 93603.5
    assert one(spark, timecode.srt_code(F.lit(3723.4567))) == "01:02:03,457"


@pytest.mark.parametrize("raw, plain", [("a<b>c</b>", "ac"), ("a<b\rc>d", "ad"), ("a<b c>d", "ad"), ("a<b\nc>d", "a<b\nc>d"), ("1 < 2", "1 < 2")])
def test_tags(spark, raw, plain):
    assert one(spark, text.remove_html_tags(F.lit(raw))) == plain


MHTML = (
    'From: x\r\nContent-Type: multipart/related;\r\n\tBoundary="b-1"\r\n\r\nleft out\r\n--b-1\r\nContent-Type: text/html\r\n\r\n'
    '<html><figcaption>Slide #1: 00:00:00,000 - 00:00:04,500 (duration: 4.500)</figcaption><img src="cid:one@x"></figure>\r\n'
    '<figcaption>no slide</figcaption><figcaption>Slide #2: 00:00:04,500 - 00:00:06,000 (duration: 1.500)</figcaption><img src="cid:two@x">'
    "\r\n--b-1  \r\nContent-ID: <two@x>\r\nCONTENT-TYPE: Image/PNG; q=1\r\nContent-Location:\r\n http://h/two\r\n\r\nAAAA\r\n\r\nBBBB\r\n--b-1--\r\n"
)


def test_storyboards(spark):
    files = spark.createDataFrame([("f", MHTML), ("none", "no boundary")], "path string, content string")
    rows = [tuple(r) for r in media.parse_storyboards(files, 2, 2).orderBy("idx").collect()]
    assert rows == [("f", 1, 0.0, 4.5, "one@x", 2, 2, None, None), ("f", 2, 4.5, 6.0, "two@x", 2, 2, "http://h/two", "image/png")]


def test_sheet_plan(spark):
    sheets = spark.createDataFrame([("f", 1, 0.0, 4.0, 90, 160), ("f", 2, 4.0, 7.0, 90, 160)], "filepath string, idx int, start double, end double, height int, width int")
    rows = sprites.sheet_plan(sheets, 2, 2).orderBy("timestamp").collect()
    assert [r["timestamp"] for r in rows] == [0, 1, 2, 3, 4, 5, 6]
    assert tuple(rows[3]["box"]) == (1, 1, 80, 45, 160, 90) and tuple(rows[6]["box"]) == (1, 0, 0, 45, 80, 90)


def test_probes(spark):
    probe = '{"streams":[{"index":1,"codec_type":"subtitle","codec_name":"ass"},{"index":4,"codec_type":"subtitle","codec_name":"subrip"}]}'
    streams = media.subtitle_streams(spark.createDataFrame([(probe,)], "json string"))
    assert media.select_stream(streams, 4)["codec_name"] == "subrip"
    for own, index in ((streams, None), (streams, 2), (streams.where("false"), None)):
        with pytest.raises(VideoError):
            media.select_stream(own, index)
    with pytest.raises(Exception, match="no video stream"):
        media.video_metadata(spark.createDataFrame([(probe,)], "json string")).collect()


def test_shapes_and_shots(spark):
    none = F.lit(None).cast("int")
    assert tuple(one(spark, grid.resolve_shape(F.lit(100), F.lit(200), none, F.lit(50), none))) == (25, 50)
    with pytest.raises(Exception, match="either a ratio or a shape"):
        one(spark, grid.resolve_shape(F.lit(100), F.lit(200), none, F.lit(50), F.lit(0.5)))
    with pytest.raises(ShotError):
        sprites.shots(spark.range(1), 1.0)


def test_decoded_frames(spark):
    plan = sprites.plan_seek(spark.createDataFrame([("v", 1.0)], "path string, duration double"), 2.0)
    found = sprites.decode_frames(plan, lambda rows: ((r.pos, r.timestamp, 1, 1, 3, bytes([int(r.pos)])) for r in rows.itertuples()))
    assert [(r["timestamp"], bytes(r["frame"])) for r in found.orderBy("pos").collect()] == [(0.0, b"\0"), (0.5, b"\1"), (1.0, b"\2")]


def test_models_and_sinks(spark, tmp_path):
    frames = spark.createDataFrame([(0, 0.0, bytearray(b"ab")), (1, 1.0, bytearray(b"abc"))], "pos long, timestamp double, frame binary")

    def make():
        def client(prompt, image):
            if len(image) > 2:
                raise ValueError("too large")
            return prompt[-12:]

        return client

    said = models.annotate(frames, make, synopsis="a dog story.")
    sinks.write_annotations(said, f"{tmp_path}/good", f"{tmp_path}/bad")
    assert spark.read.json(f"{tmp_path}/good").first()["annotation"] == "a dog story."
    assert spark.read.json(f"{tmp_path}/bad").first()["error"] == "ValueError: too large"
    sinks.write_frames(frames, f"{tmp_path}/frames", "sprite", "v.mp4", fps=2)
    assert sinks.read_metadata(spark, f"{tmp_path}/frames.parquet") == {"type": "sprite", "source": "v.mp4", "n_entries": "2", "fps": "2"}
    own = media.read_timeline(spark, f"{tmp_path}/frames.parquet", "timestamp double, pos long", "timestamp")
    assert own.count() == 2
    with pytest.raises(DatasetError):
        media.read_timeline(spark, f"{tmp_path}/frames.parquet", "pos long", "timestamp")
    texts = spark.createDataFrame([("a",), (None,)], "content string")
    assert {r["content"]: r["embedding"] for r in models.embed(texts, lambda: lambda ts: [[len(t)] for t in ts]).collect()} == {"a": [1.0], None: None}


def test_command_line_and_stream(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHalf\n\n2\n00:00:02,000 --> 00:00:03,000\na line.\n")
    assert main(["extract-subtitles", str(tmp_path / "a.srt"), str(tmp_path / "cues.parquet")]) == 0
    assert main(["extract-subtitles", str(tmp_path / "a.srt"), str(tmp_path / "said.parquet"), "--utterances"]) == 0
    assert spark.read.parquet(f"{tmp_path}/cues.parquet").count() == 2
    assert spark.read.parquet(f"{tmp_path}/said.parquet").first()["content"] == "Half a line."
    (tmp_path / "b.mhtml").write_bytes(MHTML.encode())
    assert main(["extract-sprites", str(tmp_path / "b.mhtml"), str(tmp_path / "plan"), "--height", "90", "--width", "160", "--grid-rows", "2", "--grid-cols", "2"]) == 0
    assert spark.read.parquet(f"{tmp_path}/plan.parquet").count() == 5
    query = stream_utterances(spark, f"{tmp_path}/cues.parquet", f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    assert [r["content"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["Half a line."]


def storyboard(sheets, size):
    page = "".join(f'<figcaption>#{k}: 00:00:0{k % 10},000 - 00:00:0{k % 10},500</figcaption><img src="cid:c{k}">' for k in range(1, sheets + 1))
    parts = [f"--=b.+\r\nContent-Type: text/html\r\n\r\n{page}"]
    parts += [f"--=b.+\r\nContent-ID: <c{k}>\r\nContent-Type: image/png\r\nContent-Location: http://x/{k}\r\n\r\n" + ("QUJD" * 18 + "\r\n") * (size // sheets // 74) for k in range(1, sheets + 1)]
    return 'Content-Type: multipart/related;\r\n boundary="=b.+"\r\n\r\n' + "\r\n".join([*parts, "--=b.+--\r\n"])


def test_storyboards_take_time_in_proportion(spark):
    import time

    def took(size):
        files = spark.createDataFrame([("f", storyboard(40, size))], "path string, content string").repartition(1).cache()
        files.count()
        began = time.time()
        rows = media.parse_storyboards(files).collect()
        assert len(rows) == 40 and {(r["cid"], r["location"], r["type"]) for r in rows} == {(f"c{k}", f"http://x/{k}", "image/png") for k in range(1, 41)}
        return time.time() - began

    took(100_000)
    small, large = took(500_000), took(5_000_000)
    assert large < 3 and large < 20 * small + 1


def test_part_bodies_and_bare_parts(spark):
    text = 'x boundary="b"\n--b\nA: 1\n\nbody\r\nmore\r\n--b \t\r\n\r\nno headers\n--b\nnone\n--bb\n--b--\nend'
    frame = spark.createDataFrame([(text,)], "t string").select(F.explode(mime.parts(F.col("t"), F.lit("b"))).alias("p"))
    found = [tuple(r) for r in frame.select(mime.part_headers(F.col("p")), mime.part_body(F.col("p"))).collect()]
    assert found == [("A: 1", "body\r\nmore"), ("", "no headers"), (None, None), (None, None)]


def test_errors_surface_in_counts(spark):
    short = spark.createDataFrame([(1.0, 2, 2, 3, b"abc")], "timestamp double, height int, width int, channels int, frame binary")
    with pytest.raises(Exception, match="lacks pixels"):
        sprites.whole_frames(short).count()
    probe = spark.createDataFrame([('{"streams":[],"format":{"duration":"1"}}',)], "json string")
    with pytest.raises(Exception, match="no video stream"):
        media.video_metadata(probe).count()

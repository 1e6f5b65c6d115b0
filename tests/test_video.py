import sys
import types

import numpy as np
import pytest

from cueline.errors import SpriteError, VideoError
from cueline.operators import sprites
from cueline.plans.extract import VideoExtractor, main

PROBE = (
    '{"streams":[{"index":0,"codec_type":"video","r_frame_rate":"4/1","nb_frames":"10","height":40,"width":60},'
    '{"index":2,"codec_type":"subtitle","codec_name":"subrip"}],"format":{"duration":"2.5"}}'
)
SRT = "1\n00:00:01,000 --> 00:00:02,000\nHalf\n\n2\n00:00:02,000 --> 00:00:03,000\na line.\n"


def tools(probe=PROBE, channels=3):
    def decode(rows):
        for r in rows.itertuples():
            yield r.pos, r.timestamp, r.height, r.width, 3, bytes([int(r.pos)]) * (r.height * r.width * channels)

    found = types.ModuleType("media_tools_of_test")
    found.probe, found.demux, found.decode = lambda path: probe, lambda path, stream: SRT, decode
    found.scores = lambda path: [(0.5, 0.9), (1.0, 0.1), (2.0, 0.4)]
    return found


def test_video_sprites(spark):
    video = VideoExtractor(spark, "v.mkv", tools())
    shape = lambda df: [(r["timestamp"], r["height"], r["width"]) for r in df.orderBy("pos").collect()]
    assert shape(video.sprites(2.0, height=20)) == [(0.0, 20, 30), (0.5, 20, 30), (1.0, 20, 30), (1.5, 20, 30), (2.0, 20, 30)]
    assert shape(video.sprites(1.0, scale_ratio=0.1, method="seek")) == [(0.0, 4, 6), (1.0, 4, 6), (2.0, 4, 6)]
    with pytest.raises(SpriteError):
        video.sprites(method="guess")
    with pytest.raises(Exception, match="either a ratio or a shape"):
        video.sprites(height=3, scale_ratio=0.5).collect()
    with pytest.raises(Exception, match="lacks pixels"):
        VideoExtractor(spark, "v.mkv", tools(channels=2)).sprites().collect()


def test_shots_and_single_frames(spark):
    video = VideoExtractor(spark, "v.mkv", tools())
    assert [(r["timestamp"], r["score"], r["height"]) for r in video.shots(0.2).orderBy("pos").collect()] == [(0.5, 0.9, 40), (2.0, 0.4, 40)]
    one = video.frames_at(spark.createDataFrame([(1.25,)], "timestamp double"), width=6).collect()
    assert [(r["timestamp"], r["height"], r["width"], len(r["frame"])) for r in one] == [(1.25, 4, 6, 72)]


def test_video_subtitles(spark):
    assert [r["content"] for r in VideoExtractor(spark, "v.mkv", tools()).subtitles().orderBy("idx").collect()] == ["Half", "a line."]
    with pytest.raises(VideoError):
        VideoExtractor(spark, "v.mkv", tools()).subtitles(7)
    with pytest.raises(Exception, match="no subtitle stream"):
        VideoExtractor(spark, "v.mkv", tools('{"streams":[]}')).subtitles()


def test_sheets_are_cut(spark):
    sheets = spark.createDataFrame([("f", 1, 0.0, 4.0, "one"), ("f", 2, 4.0, 7.0, "two"), ("g", 1, 0.0, 8.0, "one")], "filepath string, idx int, start double, end double, location string")

    def fetch(location):
        if location == "bad":
            raise OSError("gone")
        image = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
        return image if location == "one" else image + 100

    rows = sprites.sheet_frames(sheets, 2, 2, fetch).orderBy("filepath", "pos").collect()
    assert [(r["filepath"], r["pos"], r["timestamp"]) for r in rows] == [("f", k, float(k)) for k in range(7)] + [("g", k, 2.0 * k) for k in range(4)]
    assert bytes(rows[3]["frame"]) == fetch("one")[2:4, 3:6].tobytes() and (rows[3]["height"], rows[3]["width"], rows[3]["channels"]) == (2, 3, 3)
    assert bytes(rows[6]["frame"]) == fetch("two")[2:4, 0:3].tobytes()
    for location, error in ((None, "has no location"), ("bad", "gone")):
        with pytest.raises(Exception, match=error):
            sprites.sheet_frames(spark.createDataFrame([("f", 1, 0.0, 4.0, location)], sheets.schema), 2, 2, fetch).collect()


def test_command_line(spark, tmp_path):
    sys.modules["media_tools_of_test"] = tools()
    more = ["--tools", "media_tools_of_test"]
    assert main(["extract-sprites", "v.mkv", f"{tmp_path}/frames", "--fps", "2", "--scale-ratio", "0.5", "--method", "seek", *more]) == 0
    assert spark.read.parquet(f"{tmp_path}/frames.parquet").count() == 6
    assert main(["extract-subtitles", "v.mkv", f"{tmp_path}/cues", "--stream", "2", *more]) == 0
    assert spark.read.parquet(f"{tmp_path}/cues.parquet").count() == 2
    with pytest.raises(SystemExit):
        main(["extract-sprites", "v.mkv", f"{tmp_path}/x"])

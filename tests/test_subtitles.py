import pytest

from cueline.operators.utterance import to_utterances
from cueline.sources.subtitles import parse_ass, parse_srt, parse_stream, read_srt, read_video_subtitles, srt_cues, time_line
from cueline.errors import SubtitleError

TWO = "7\n0:00:04,250 --> 0:00:06,5\nFirst <i>words</i>\nof a cue\n\n\n9\n01:10,000 --> 01:12,125 X1:10 X2:20\n- Yes. - No.\n"


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, content string")


def test_cues(spark):
    rows = parse_srt(files(spark, TWO)).orderBy("idx").collect()
    assert [(r["idx"], r["line_idx"], r["timestamp_start"], r["timestamp_end"], r["content"]) for r in rows] == [
        (7, 1, 4.25, 6.5, "First words of a cue"),
        (9, 7, 70.0, 72.125, "- Yes. - No."),
    ]
    assert [rows[1][c] for c in ("x1", "x2", "y1", "y2")] == [10, 20, None, None]
    assert parse_srt(files(spark, TWO), remove_html=False).orderBy("idx").first()["content"] == "First <i>words</i> of a cue"
    assert parse_srt(files(spark, "", "\n\n")).count() == 0


@pytest.mark.parametrize(
    "line, found",
    [
        ("1 --> 2", ("1", "2", None, None, None, None)),
        ("1-->2 X1:3 X2:4 Y1:5 Y2:6", ("1", "2", 3, 4, 5, 6)),
        ("1 --> 2 X1:3 Y2:6", ("1", "2", 3, None, None, 6)),
        ("1 --> 2 Y1:5 Y2:6", ("1", "2", None, None, None, None)),
        ("1 --> 2 Y1:5 X1:6", None),
        ("1 --> 2 X1:a", None),
        ("1 -> 2", None),
        ("1 --> ", None),
        ("1 1 --> 2", None),
    ],
)
def test_time_lines(line, found):
    assert time_line(line) == found


def test_bad_lines(spark):
    assert "no index" in list(srt_cues("f", "x\n"))[0][-1]
    assert "no timestamps" in list(srt_cues("f", "1\nnever\n"))[0][-1]
    bad = files(spark, "1\n00:00:99,000 --> 00:01:00,000\nx\n")
    assert "bad timestamps" in parse_srt(bad, mode="PERMISSIVE").first()["error"]
    with pytest.raises(Exception, match="bad timestamps"):
        parse_srt(bad).collect()
    with pytest.raises(SubtitleError):
        parse_srt(bad, mode="LAX")


def test_encodings(spark, tmp_path):
    text = "1\n00:00:01,000 --> 00:00:02,000\nÀ côté\n"
    for name, code in (("a", "utf-8"), ("b", "utf-8-sig"), ("c", "utf-16"), ("d", "cp1252")):
        (tmp_path / f"{name}.srt").write_bytes(text.encode(code))
    assert [r["content"] for r in read_srt(spark, str(tmp_path)).collect()] == ["À côté"] * 4


ASS = """[Script Info]
Dialogue: 0,0:00:00.00,0:00:01.00,not an event
[Events]
Format: Layer, Start, End, Style, Text
Comment: 0,0:00:00.00,0:00:01.00,S,left out
Dialogue: 0,0:00:01.50,0:00:02.00,S,{\\b1}Bold{\\b0}, with\\Na comma
Dialogue: 1,0:00:03.00,0:00:04.00,S,  two\\h words
"""


def test_ass(spark):
    rows = parse_ass(files(spark, ASS)).orderBy("idx").collect()
    assert [(r["idx"], r["line_idx"], r["timestamp_start"], r["content"]) for r in rows] == [(1, 6, 1.5, "Bold, with a comma"), (2, 7, 3.0, "two words")]


@pytest.mark.parametrize(
    "text, error",
    [
        ("[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,x", "before Format"),
        ("[Events]\nFormat: Start, Text\nDialogue: 0:00:01.00,x", "lacks"),
        ("[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0,0:00:01.00", "fewer"),
        ("[Events]\nFormat: Start, End, Text\nDialogue: soon,0:00:01.00,x", "bad timestamps"),
    ],
)
def test_ass_errors(spark, text, error):
    assert error in parse_ass(files(spark, text), mode="PERMISSIVE").first()["error"]
    with pytest.raises(Exception, match=error):
        parse_ass(files(spark, text)).collect()


def test_streams(spark):
    videos = spark.createDataFrame([("v", 3)], "path string, stream int")
    found = read_video_subtitles(videos, lambda path, stream: f"{stream}\n00:00:01,000 --> 00:00:02,000\n{path}\n", "subrip")
    assert [(r["idx"], r["content"]) for r in found.collect()] == [(3, "v")]
    with pytest.raises(SubtitleError):
        parse_stream("pgs", files(spark, "x"))


def cues(spark, *rows):
    own = [("f", i, i * 10, 2.0 * i, 2.0 * i + 1, c, [float(i)]) for i, c in enumerate(rows)]
    return spark.createDataFrame(own, "filepath string, idx long, line_idx long, timestamp_start double, timestamp_end double, content string, embedding array<double>")


def test_utterances(spark):
    found = to_utterances(cues(spark, "One", "goes on.", "- A? - B", "then C!", "- alone", "- a - b - c", "tail")).orderBy("idx").collect()
    assert [(r["content"], r["timestamp_start"], r["timestamp_end"], r["line_idxs"], r["embedding"]) for r in found] == [
        ("One goes on.", 0.0, 3.0, [0, 10], None),
        ("A?", 4.0, 4.5, [20], None),
        ("B then C!", 4.5, 7.0, [20, 30], None),
        ("- alone", 8.0, 9.0, [40], [4.0]),
        ("- a - b - c", 10.0, 11.0, [50], [5.0]),
        ("tail", 12.0, 13.0, [60], [6.0]),
    ]


@pytest.mark.parametrize("bad", ["x\n00:01 --> 00:02\nno index\n", "1\nbad --> times\ntext\n"])
def test_a_bad_cue_fails_whatever_is_read(spark, bad):
    files = spark.createDataFrame([("f", "1\n00:01,000 --> 00:02,000\nfine\n\n" + bad)], "path string, content string")
    for read in (lambda d: d.count(), lambda d: d.select("content").collect(), lambda d: d.select("x1").collect()):
        with pytest.raises(Exception, match="f:"):
            read(parse_srt(files))
    assert parse_srt(files, mode="PERMISSIVE").where("error is not null").count() == 1


def test_only_line_ends_end_lines(spark):
    text = "1\r00:01,000 --> 00:02,000\ra\x0c\x0b\x85 b\r\n\r\n2\n00:03,000 --> 00:04,000\nc"
    found = parse_srt(spark.createDataFrame([("f", text)], "path string, content string")).orderBy("idx").collect()
    assert [r["idx"] for r in found] == [1, 2] and found[0]["content"].split() == ["a", "b"] and found[1]["content"] == "c"

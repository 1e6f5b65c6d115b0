"""Whole chains from files to tables, as fluent extractors and as commands."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.errors import SpriteError, SubtitleError
from cueline.operators import sprites
from cueline.operators.models import embed
from cueline.operators.screenplay import parse_lines, parse_screenplay, singleton_utterances
from cueline.operators.utterance import to_utterances
from cueline.sources.media import read_screenplay_lines, read_storyboards, select_stream, subtitle_streams, video_metadata
from cueline.sources.sinks import write_frames, write_timeline
from cueline.sources.subtitles import read_ass, read_srt, read_video_subtitles

READERS = {"srt": read_srt, "ass": read_ass}
METHODS = {"select": sprites.plan_select, "seek": sprites.plan_seek}


class SubtitleExtractor:
    """read -> embed -> utterances -> save; every step but save returns the extractor."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.kind, self.table = spark, path, "subtitle", None

    def extract(self) -> SubtitleExtractor:
        suffix = self.path.rsplit(".", 1)[-1].lower()
        if suffix not in READERS:
            raise SubtitleError(f"no reader for .{suffix} files")
        self.table = READERS[suffix](self.spark, self.path)
        return self

    def compute_embeddings(self, make_model) -> SubtitleExtractor:
        self.table = embed(self.table, make_model)
        return self

    def convert_to_utterances(self, **options) -> SubtitleExtractor:
        self.table, self.kind = to_utterances(self.table, **options), "utterance"
        return self

    def save(self, path: str, **options) -> str:
        write_timeline(self.table, path, self.kind, self.path, **options)
        return path


def screenplay_sentences(spark: SparkSession, paths, make_model=None) -> DataFrame:
    """Sentences of labelled screenplays, embedded if a model is given."""
    _, elements = parse_screenplay(parse_lines(read_screenplay_lines(spark, paths)))
    found = singleton_utterances(elements)
    return embed(found, make_model) if make_model else found


class VideoExtractor:
    """Subtitles, sprites, shots and single frames of one video, by ``tools``.

    ``tools`` has what reads media: probe(path) returns the probe's JSON, demux(path, stream) a subtitle stream's text, decode(rows) yields rows of
    SPRITE for a batch of planned rows (filepath, timestamp, frame_idx if all frames are passed, height, width), scores(path) yields (timestamp, score).
    """

    def __init__(self, spark: SparkSession, path: str, tools):
        self.spark, self.path, self.tools = spark, path, tools
        self.probe = spark.createDataFrame([(path, tools.probe(path))], "filepath string, json string")

    def _video(self, height: int | None, width: int | None, scale_ratio: float | None) -> DataFrame:
        return sprites.scaled(video_metadata(self.probe), height, width, scale_ratio)

    def subtitles(self, stream: int | None = None) -> DataFrame:
        """Cues of the only subtitle stream, or that with the index ``stream``."""
        found = select_stream(subtitle_streams(self.probe, needed=True), stream)
        video = self.spark.createDataFrame([(self.path, found["index"])], "path string, stream int")
        return read_video_subtitles(video, self.tools.demux, found["codec_name"])

    def sprites(self, fps: float = 1.0, height: int | None = None, width: int | None = None, scale_ratio: float | None = None, method: str = "select") -> DataFrame:
        """A frame each 1 / ``fps`` seconds: "select" passes all frames once, "seek" looks each one up."""
        if method not in METHODS:
            raise SpriteError(f"method must be one of {tuple(METHODS)}")
        plan = METHODS[method](self._video(height, width, scale_ratio), fps)
        return sprites.whole_frames(sprites.decode_frames(plan, self.tools.decode))

    def frames_at(self, times: DataFrame, height: int | None = None, width: int | None = None, scale_ratio: float | None = None) -> DataFrame:
        """The frames at ``times`` (timestamp)."""
        plan = sprites.plan_frames(self._video(height, width, scale_ratio), times.select(F.lit(self.path).alias("filepath"), "timestamp"))
        return sprites.whole_frames(sprites.decode_frames(plan, self.tools.decode))

    def shots(self, threshold: float = 0.2, height: int | None = None, width: int | None = None, scale_ratio: float | None = None) -> DataFrame:
        """The first frame of each shot, with its score."""
        scored = self.spark.createDataFrame([(float(t), float(x)) for t, x in self.tools.scores(self.path)], "timestamp double, score double")
        found = sprites.shots(scored, threshold)
        return self.frames_at(found, height, width, scale_ratio).join(found, "timestamp")


def main(argv: list[str] | None = None) -> int:
    """cueline extract-subtitles IN OUT [--utterances] [--stream N] | extract-sprites IN OUT [--fps --height --width --scale-ratio --method] [--grid-rows --grid-cols].

    Videos and images need --tools, a module with the functions that VideoExtractor names, and fetch(location) for storyboards. Without it a
    storyboard's plan is written, which needs --height and --width of its sheets.
    """
    parser = argparse.ArgumentParser(prog="cueline")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("extract-subtitles")
    two = commands.add_parser("extract-sprites")
    for c in (one, two):
        c.add_argument("input")
        c.add_argument("output")
        c.add_argument("--tools", type=importlib.import_module)
    one.add_argument("--utterances", action="store_true")
    one.add_argument("--stream", type=int)
    two.add_argument("--grid-rows", type=int, default=3)
    two.add_argument("--grid-cols", type=int, default=3)
    two.add_argument("--height", type=int)
    two.add_argument("--width", type=int)
    two.add_argument("--scale-ratio", type=float)
    two.add_argument("--fps", type=float, default=1.0)
    two.add_argument("--method", choices=tuple(METHODS), default="select")
    args = parser.parse_args(argv)
    suffix = args.input.rsplit(".", 1)[-1].lower()
    video = suffix not in (READERS if args.command == "extract-subtitles" else ("mhtml",))
    if video and args.tools is None:
        parser.error(f"a .{suffix} file needs --tools")
    spark = SparkSession.builder.appName("cueline").getOrCreate()
    if args.command == "extract-subtitles":
        own = SubtitleExtractor(spark, args.input)
        if video:
            own.table = VideoExtractor(spark, args.input, args.tools).subtitles(args.stream)
        else:
            own.extract()
        print((own.convert_to_utterances() if args.utterances else own).save(args.output))
        return 0
    if video:
        frames = VideoExtractor(spark, args.input, args.tools).sprites(args.fps, args.height, args.width, args.scale_ratio, args.method)
        write_frames(frames, args.output, "sprite", args.input, fps=args.fps, method=args.method)
        return 0
    sheets = read_storyboards(spark, args.input, args.grid_rows, args.grid_cols)
    if args.tools is not None:
        write_frames(sprites.sheet_frames(sheets, args.grid_rows, args.grid_cols, args.tools.fetch), args.output, "sprite", args.input)
        return 0
    if args.height is None or args.width is None:
        parser.error("a storyboard's plan needs --height and --width")
    sized = sheets.withColumn("height", F.lit(args.height)).withColumn("width", F.lit(args.width))
    plan = sprites.sheet_plan(sized, args.grid_rows, args.grid_cols)
    write_timeline(plan.drop("fps"), args.output, "sprite", args.input, width=args.width, height=args.height)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

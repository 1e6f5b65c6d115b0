"""Descriptions of videos and storyboards: probe JSON, labelled screenplays, MHTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.errors import DatasetError, VideoError, surely
from cueline.functions.mime import boundary, content_type, header_value, materialised, part_body, part_headers, parts
from cueline.functions.timecode import timecode_seconds

_PROBE = (
    "streams array<struct<index:int,codec_type:string,codec_name:string,codec_long_name:string,start_time:string,duration:string,"
    "r_frame_rate:string,nb_frames:string,height:int,width:int,tags:map<string,string>>>, format struct<duration:string>"
)


def subtitle_streams(probes: DataFrame, json: str = "json", needed: bool = False) -> DataFrame:
    """``probes`` with one row for each subtitle stream that the probe's JSON lists; without one no row, or an error if they are ``needed``."""
    streams = F.filter(F.from_json(F.col(json), _PROBE)["streams"], lambda s: s["codec_type"] == "subtitle")
    if needed:
        streams = F.when(F.size(streams) > 0, streams).otherwise(F.raise_error(F.lit("no subtitle stream")))
    others = [c for c in probes.columns if c != json]
    found = probes.select(*others, F.explode(streams).alias("s"))
    return found.select(
        *others, "s.index", "s.codec_name", "s.codec_long_name", F.col("s.start_time").cast("double").alias("start_time"),
        F.col("s.duration").cast("double").alias("duration"), F.col("s.tags")["language"].alias("language"), F.col("s.tags")["title"].alias("title"),
    )


def select_stream(streams: DataFrame, index: int | None = None):
    """The one subtitle stream of a video, or that with ``index``; VideoError if there is no such one or a choice is needed."""
    rows = (streams if index is None else streams.where(F.col("index") == index)).limit(2).collect()
    if not rows:
        raise VideoError("no such subtitle stream")
    if len(rows) > 1:
        raise VideoError("several subtitle streams: an index is needed")
    return rows[0]


def video_metadata(probes: DataFrame, json: str = "json") -> DataFrame:
    """``probes`` with fps, duration, n_frames, height and width of the first video stream; without one an error."""
    probe = F.from_json(F.col(json), _PROBE)
    own = probes.select(*[c for c in probes.columns if c != json], probe.alias("p"))
    own = own.withColumn("v", F.get(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(0)))
    rate = F.split("v.r_frame_rate", "/")
    fps = rate[0].cast("double") / F.coalesce(F.get(rate, F.lit(1)).cast("double"), F.lit(1.0))
    duration = F.coalesce(F.col("v.duration").cast("double"), F.col("p.format.duration").cast("double"))
    own = surely(own, F.when(F.col("v").isNull(), F.lit("no video stream")))
    own = own.withColumn("fps", fps).withColumn("duration", duration)
    frames = F.coalesce(F.col("v.nb_frames").try_cast("long"), F.bround(F.col("duration") * F.col("fps")).cast("long"))
    return own.select(*[c for c in own.columns if c not in ("p", "v")], frames.alias("n_frames"), "v.height", "v.width")


def storyboard_captions(pages: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """filepath, idx, start, end, cid of the captions of storyboard pages: each names a slide and its times, and its image follows at once."""
    return _captions(pages.select(F.col(path).alias("filepath"), F.col(html).alias("_page")), ["filepath"])


def _captions(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, idx, start, end, cid of the captions in ``_page``."""
    chunks = F.split(F.col("_page"), "<figcaption>")
    own = pages.select(*keep, F.explode(F.filter(chunks, lambda _, i: i > 0)).alias("_chunk"))
    own = materialised(own, "_said", F.substring_index("_chunk", "</figcaption>", 1))
    image = F.regexp_extract(F.substring("_chunk", F.length("_said") + 14, F.length("_chunk")), r"^<img[^>]*cid:([^\">]+)", 1)
    times = F.regexp_extract_all("_said", F.lit(r"[\d:]+,\d+"), 0)
    rows = own.select(*keep, F.regexp_extract("_said", r"#(\d+)", 1).alias("idx"), times.alias("times"), image.alias("cid"))
    rows = rows.where("idx != '' and size(times) >= 2 and cid != ''")
    return rows.select(*keep, F.col("idx").cast("int").alias("idx"), timecode_seconds(F.col("times")[0]).alias("start"), timecode_seconds(F.col("times")[1]).alias("end"), "cid")


def parse_storyboards(files: DataFrame, rows: int = 3, cols: int = 3, path: str = "path", content: str = "content") -> DataFrame:
    """filepath, idx, start, end, cid, rows, cols, location, type of the sheets of MHTML ``files`` (path, content as text).

    The first part has the captions, later ones a sheet's headers each. A sheet without headers has nulls. A file is one row all along: it is
    scanned once and nothing is shuffled; each text is cut once, and images are dropped before anything is read from headers.
    """
    cut = materialised(files.select(F.col(path).alias("filepath"), content), "_parts", parts(F.col(content), boundary(F.col(content)))).drop(content)
    own = cut.where("size(_parts) > 0").select("filepath", part_body(F.get("_parts", F.lit(0))).alias("_page"), F.transform(F.filter("_parts", lambda _, i: i > 0), part_headers).alias("_heads"))
    own = materialised(own, "_text", F.filter("_heads", lambda h: h.isNotNull()))
    sheet = lambda h: F.struct(
        F.btrim(header_value(h, "Content-ID"), F.lit("<>")).alias("cid"), header_value(h, "Content-Location").alias("location"), content_type(h).alias("type")
    )
    own = materialised(own.select("filepath", "_page", "_text"), "_sheets", F.transform("_text", sheet)).drop("_text")
    captions = _captions(own, ["filepath", "_sheets"])
    mine = captions.select("filepath", "idx", "start", "end", "cid", F.explode_outer(F.filter("_sheets", lambda h: h["cid"] == F.col("cid"))).alias("_sheet"))
    return mine.select("filepath", "idx", "start", "end", "cid", F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), "_sheet.location", "_sheet.type")


def read_storyboards(spark: SparkSession, paths, rows: int = 3, cols: int = 3) -> DataFrame:
    texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return parse_storyboards(texts, rows, cols)


def read_screenplay_lines(spark: SparkSession, paths) -> DataFrame:
    """filepath, line_idx, raw of labelled screenplays, lines numbered from 1 as they stand in the file."""
    texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("filepath"), "value")
    lines = F.split(F.regexp_replace("value", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")
    return texts.select("filepath", F.posexplode(lines).alias("n", "raw")).select("filepath", (F.col("n") + 1).alias("line_idx"), "raw")


def read_images(spark: SparkSession, paths) -> DataFrame:
    """path, frame of local image files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("content").alias("frame"))


def read_timeline(spark: SparkSession, path: str, schema: str, ts: str = "timestamp_start") -> DataFrame:
    """A timestamped Parquet table with the explicit ``schema``; columns that aren't used, such as frames, aren't read."""
    table = spark.read.schema(schema).parquet(path)
    if ts not in table.columns:
        raise DatasetError(f"{path} has no column {ts}")
    return table

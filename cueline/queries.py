"""Queries that run the operators over the driver's tables, with the same results as SQL where SQL can state them.

The tables hold no media, so events are timelines, conversations and documents are cues and dialogue, pages are
markup, parts are videos and frames, and embeddings, by label, are pairs of sequences (even and odd vec_id).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueline.functions import grid, layout, mime, text, timecode, vector
from cueline.operators import anchors as anchoring
from cueline.operators import chaining, crf
from cueline.operators import dtw as warping
from cueline.operators import fuzzy, hmm, models, scenes, screenplay, sprites, tiles, timeline, utterance
from cueline.shared import Rounds
from cueline.sources import datasource, media, subtitles, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function as a query, with its SQL."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, in whatever zone the session is."""
    day = F.unix_date(ts.cast("date")).cast("long") * 86400
    return (day + F.hour(ts) * 3600 + F.minute(ts) * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def six(value: Column) -> Column:
    return F.round(value, 6)


# Timelines

_EVENTS = "e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events)"


def _events(spark, sf_dir):
    """All events, as probes and as references."""
    own = table(spark, sf_dir, "events").select("event_id", "user_id", micros(F.col("ts")).alias("us"), "event_type")
    return own, own


def _register_as_of(how: str, sign: str, order: str) -> None:
    def run(spark, sf_dir):
        probes, refs = _events(spark, sf_dir)
        found = timeline.as_of(probes, refs, ["user_id"], "us", "us", how, "event_id")
        return found.select("event_id", "user_id", F.col("ref.event_id").alias("ref_event_id"), F.col("ref.us").alias("ref_us"))

    sql = (
        f"WITH {_EVENTS} SELECT event_id, user_id, ref_event_id, ref_us FROM (SELECT p.event_id, p.user_id, r.event_id AS ref_event_id, r.us AS ref_us, "
        f"row_number() OVER (PARTITION BY p.event_id ORDER BY r.us {order}, r.event_id {order}) AS k "
        f"FROM e p LEFT JOIN e r ON p.user_id = r.user_id AND r.us {sign} p.us) WHERE k = 1"
    )
    query(sql, f"asof_{how}")(run)


for _how, _sign, _order in (("lt", "<", "DESC"), ("le", "<=", "DESC"), ("gt", ">", "ASC"), ("ge", ">=", "ASC")):
    _register_as_of(_how, _sign, _order)


@query(
    f"WITH {_EVENTS}, c AS (SELECT p.event_id, r.event_id AS ref_event_id, row_number() OVER (PARTITION BY p.event_id "
    "ORDER BY abs(r.us - p.us), r.us, CASE WHEN r.us < p.us THEN -r.event_id ELSE r.event_id END) AS k FROM e p LEFT JOIN e r ON p.user_id = r.user_id) "
    "SELECT event_id, ref_event_id FROM c WHERE k = 1"
)
def nearest(spark, sf_dir):
    probes, refs = _events(spark, sf_dir)
    found = timeline.nearest(probes, refs, ["user_id"], "us", "us", "event_id")
    return found.select("event_id", F.col("ref.event_id").alias("ref_event_id"))


@query(
    f"WITH {_EVENTS}, q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS pos FROM e) "
    "SELECT p.event_id, min(q.pos) AS first_pos, max(q.pos) AS last_pos, count(q.pos) AS n "
    "FROM e p LEFT JOIN q ON p.user_id = q.user_id AND q.us BETWEEN p.us AND p.us + 3600000000 * 6 GROUP BY p.event_id"
)
def between(spark, sf_dir):
    probes, refs = _events(spark, sf_dir)
    probes = probes.withColumn("until", F.col("us") + 3_600_000_000 * 6)
    return timeline.between(probes, refs, ["user_id"], "us", "until", "us", ["event_id"]).select("event_id", "first_pos", "last_pos", "n")


@query(
    "SELECT user_id, event_id, pos FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, "
    "count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE pos >= n - 5 AND pos < n - 1"
)
def timeline_slice(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return timeline.slice_positions(own, ["user_id"], ["ts", "event_id"], -5, -1).select("user_id", "event_id", F.col("pos").cast("long").alias("pos"))


#: Ranges into which one timeline of all events is cut.
RANGES = 32


@query(f"WITH {_EVENTS} SELECT p.event_id, r.ref_event_id, r.us AS ref_us FROM e p ASOF LEFT JOIN (SELECT us, max(event_id) AS ref_event_id FROM e GROUP BY us) r ON p.us > r.us")
def asof_one_timeline(spark, sf_dir):
    probes, refs = _events(spark, sf_dir)
    found = timeline.as_of(probes, refs, [], "us", "us", "lt", "event_id", parts=RANGES)
    return found.select("event_id", F.col("ref.event_id").alias("ref_event_id"), F.col("ref.us").alias("ref_us"))


@query(f"WITH {_EVENTS} SELECT event_id, row_number() OVER (ORDER BY us, event_id) - 1 AS pos FROM e")
def positions_one_timeline(spark, sf_dir):
    own, _ = _events(spark, sf_dir)
    return timeline.with_position(own, [], ["us", "event_id"], RANGES).select("event_id", "pos")


@query(
    "SELECT event_id, a / 1e6 AS start_s, (a + b) / 2 / 1e6 AS mid_s, (b - a) / 1e6 AS duration_s FROM (SELECT event_id, "
    "(epoch_us(ts) % 86400000000) AS a, (epoch_us(ts) % 86400000000) + 2000 * (event_id % 997) AS b FROM events)"
)
def interval_halves(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", (F.pmod(micros(F.col("ts")), F.lit(86_400_000_000))).alias("a"))
    own = own.withColumn("s", F.col("a") / 1e6).withColumn("e", (F.col("a") + 2000 * (F.col("event_id") % 997)) / 1e6)
    halves = own.select("event_id", timecode.first_half(F.col("s"), F.col("e")).alias("h"), timecode.duration(F.col("s"), F.col("e")).alias("d"))
    return halves.select("event_id", six("h.start").alias("start_s"), six("h.end").alias("mid_s"), six("d").alias("duration_s"))


ORACLES["interval_halves"] = (
    "SELECT event_id, round(start_s, 6) AS start_s, round(mid_s, 6) AS mid_s, round(duration_s, 6) AS duration_s FROM (" + ORACLES["interval_halves"] + ")"
)


@query(
    "SELECT event_id, CASE event_id % 7 WHEN 0 THEN h * 3600 + m * 60 + s WHEN 1 THEN h * 3600 + m * 60 + s + ms / 1000 WHEN 2 THEN h * 3600 + m * 60 + s + ms / 1000 "
    "WHEN 3 THEN m * 60 + s + ms / 1000 WHEN 4 THEN m * 60 + s + ms / 1000 WHEN 5 THEN s + ms / 1000 END AS seconds FROM (SELECT event_id, "
    "hour(ts) AS h, minute(ts) AS m, second(ts) AS s, ((epoch_us(ts) // 1000) % 1000)::DOUBLE AS ms FROM events)"
)
def timecode_parse(spark, sf_dir):
    ts = F.col("ts")
    h, m, s = F.hour(ts), F.minute(ts), F.second(ts)
    ms = F.pmod(F.floor(micros(ts) / 1000), F.lit(1000))
    layouts = ("%1$02d:%2$02d:%3$02d", "%1$02d:%2$02d:%3$02d,%4$03d", "%1$d:%2$d:%3$d.%4$03d", "%2$02d:%3$02d,%4$03d", "%2$d:%3$02d.%4$03d", "%3$d.%4$03d", "%2$02d:%3$02d")
    code = F.lit(None).cast("string")
    for k, layout_ in enumerate(layouts):
        code = F.when(F.col("event_id") % 7 == k, F.format_string(layout_, h, m, s, ms)).otherwise(code)
    return table(spark, sf_dir, "events").select("event_id", timecode.timecode_seconds(code).alias("seconds"))


ORACLES["timecode_parse"] = "SELECT event_id, round(seconds, 6) AS seconds FROM (" + ORACLES["timecode_parse"] + ")"


# Text


@query("SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS plain FROM pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.remove_html_tags(F.col("html")).alias("plain"))


@query(
    "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace('{' || '\\an8' || '}' || text || '\\Nend', '\\N', ' '), '\\{.*?\\}', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM conversations"
)
def ass_text(spark, sf_dir):
    raw = F.concat(F.lit("{\\an8}"), F.col("text"), F.lit("\\Nend"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_ass_text(raw).alias("plain"))


_SENTENCES = (
    "SELECT {keys}, unnest(generate_series(1, len(s))) AS n, unnest(s) AS sentence FROM (SELECT {keys}, list_filter(list_transform("
    "string_split(regexp_replace(trim({text}), '([.!?\\-])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM {table})"
)


@query(_SENTENCES.format(keys="conv_id, turn", text="text", table="conversations"))
def sentences(spark, sf_dir):
    cut = F.posexplode(text.split_sentences(F.col("text"))).alias("n", "sentence")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cut).withColumn("n", (F.col("n") + 1).cast("long"))


@query("SELECT c_custkey, upper(c_name) AS name, 'V.O.' AS one, c_mktsegment AS two, 2::BIGINT AS n FROM customer")
def character_extensions(spark, sf_dir):
    own = table(spark, sf_dir, "customer")
    raw = F.concat(F.lit("  "), F.upper("c_name"), F.lit(" (V.O.) ("), F.col("c_mktsegment"), F.lit(")."))
    c = text.split_character(raw)
    return own.select("c_custkey", c["name"].alias("name"), c["extensions"][0].alias("one"), c["extensions"][1].alias("two"), F.size(c["extensions"]).cast("long").alias("n"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'to ' || c_name || ' (softly)' WHEN 1 THEN c_name ELSE '(' || c_name END AS plain FROM customer")
def parenthetical(spark, sf_dir):
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, F.concat(F.lit(" ( to "), F.col("c_name"), F.lit(" (softly) ) "))).when(k == 1, F.col("c_name")).otherwise(F.concat(F.lit("(("), F.col("c_name"), F.lit(" )"))).alias("raw")
    return table(spark, sf_dir, "customer").select("c_custkey", text.clean_parenthetical(raw).alias("plain"))


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN upper(c_name) || '   GUEST' ELSE upper(c_name) END AS left_name, "
    "CASE WHEN c_custkey % 3 < 2 THEN 'GUEST' END AS right_name, CASE WHEN c_custkey % 3 < 2 THEN 2 ELSE 1 END::BIGINT AS n FROM customer"
)
def character_lines(spark, sf_dir):
    k = F.col("c_custkey") % 3
    gap = F.when(k == 0, F.lit(" (O.S.)          ")).when(k == 1, F.lit("    (O.S.)       ")).otherwise(F.lit("   "))
    raw = F.concat(F.lit("   "), F.upper("c_name"), gap, F.lit("GUEST (V.O.)"))
    own = table(spark, sf_dir, "customer").select("c_custkey", layout.parse_character_line(raw).alias("c"))
    return own.select("c_custkey", F.get("c", F.lit(0))["name"].alias("left_name"), F.get("c", F.lit(1))["name"].alias("right_name"), F.size("c").cast("long").alias("n"))


# Readers, on files that are made of the tables

_LINE = "trim(replace(text, chr(10), ' '))"


def _dialogue(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").withColumn("line", F.trim(F.replace("text", F.lit("\n"), F.lit(" "))))
    start = F.col("turn") * 4 + (F.col("conv_id") % 1000) / 8
    return own.withColumn("s", start).withColumn("e", start + 2.5)


def _files(own: DataFrame, block: Column, head: str, gap: str) -> DataFrame:
    blocks = F.array_sort(F.collect_list(F.struct("turn", block.alias("b"))))
    body = F.array_join(F.transform(blocks, lambda x: x["b"]), gap)
    return own.groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.concat(F.lit(head), body).alias("content"))


@query(f"SELECT conv_id::VARCHAR AS filepath, turn + 1 AS idx, turn * 4 + (conv_id % 1000) / 8 AS timestamp_start, turn * 4 + (conv_id % 1000) / 8 + 2.5 AS timestamp_end, {_LINE} AS content FROM conversations")
def srt_roundtrip(spark, sf_dir):
    own = _dialogue(spark, sf_dir)
    block = F.concat_ws("\n", (F.col("turn") + 1).cast("string"), F.concat(timecode.srt_code(F.col("s")), F.lit(" --> "), timecode.srt_code(F.col("e"))), "line")
    cues = subtitles.parse_srt(_files(own, block, "", "\n\n"), remove_html=False)
    return cues.select("filepath", "idx", "timestamp_start", "timestamp_end", "content")


@query(ORACLES["srt_roundtrip"])
def udtf_parse_srt(spark, sf_dir):
    tables.register(spark)
    own = _dialogue(spark, sf_dir)
    block = F.concat_ws("\n", (F.col("turn") + 1).cast("string"), F.concat(timecode.srt_code(F.col("s")), F.lit(" --> "), timecode.srt_code(F.col("e"))), "line")
    sql = "SELECT path AS filepath, idx, timestamp_start, timestamp_end, cues.content FROM {files} AS files, LATERAL parse_srt(path, files.content) AS cues"
    return spark.sql(sql, files=_files(own, block, "", "\n\n"))


@query(ORACLES["srt_roundtrip"])
def srt_format(spark, sf_dir):
    own = _dialogue(spark, sf_dir).select(
        F.concat(F.col("conv_id").cast("string"), F.lit(".srt")).alias("filepath"), (F.col("turn") + 1).alias("idx"), F.col("s").alias("timestamp_start"), F.col("e").alias("timestamp_end"), F.col("line").alias("content")
    )
    folder = f"{Rounds(spark, 'srt').root}/files"
    datasource.write_srt(own, folder)
    found = spark.read.format("cueline_srt").load(folder)
    return found.select(F.regexp_extract("filepath", r"([^/]*)\.srt$", 1).alias("filepath"), "idx", "timestamp_start", "timestamp_end", "content")


@query(f"SELECT conv_id::VARCHAR AS filepath, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, turn * 4 + (conv_id % 1000) / 8 AS timestamp_start, trim(regexp_replace({_LINE}, '\\s+', ' ', 'g')) AS content FROM conversations")
def ass_roundtrip(spark, sf_dir):
    own = _dialogue(spark, sf_dir)
    block = F.concat(F.lit("Dialogue: 0,"), timecode.srt_code(F.col("s"), "."), F.lit(","), timecode.srt_code(F.col("e"), "."), F.lit(",{\\i1}"), F.col("line"))
    head = "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Text\nComment: 0,0:00:00.00,0:00:00.00,no\n"
    cues = subtitles.parse_ass(_files(own, block, head, "\n"))
    return cues.select("filepath", "idx", "timestamp_start", "content")


_STREAM = "SELECT s_suppkey, 2 AS stream_index, 'subrip' AS codec_name, s_suppkey / 4 AS duration, 'eng' AS language, s_name AS title FROM supplier"


@query(_STREAM)
def stream_metadata(spark, sf_dir):
    json = F.format_string(
        '{"streams":[{"index":0,"codec_type":"video","codec_name":"h264"},{"index":2,"codec_type":"subtitle","codec_name":"subrip",'
        '"duration":"%s","tags":{"language":"eng","title":"%s"}}]}', (F.col("s_suppkey") / 4).cast("string"), F.col("s_name"),
    )
    found = media.subtitle_streams(table(spark, sf_dir, "supplier").select("s_suppkey", json.alias("json")))
    return found.select("s_suppkey", F.col("index").alias("stream_index"), "codec_name", "duration", "language", "title")


@query("SELECT p_partkey, 25.0::DOUBLE AS fps, p_size / 2 AS duration, round_even(p_size * 12.5, 0)::BIGINT AS n_frames, 90 AS height, 160 AS width FROM part")
def video_metadata(spark, sf_dir):
    json = F.format_string('{"streams":[{"codec_type":"audio"},{"codec_type":"video","r_frame_rate":"50/2","height":90,"width":160}],"format":{"duration":"%s"}}', (F.col("p_size") / 2).cast("string"))
    return media.video_metadata(table(spark, sf_dir, "part").select("p_partkey", json.alias("json"))).select("p_partkey", "fps", "duration", "n_frames", "height", "width")


@query(
    "SELECT s_suppkey::VARCHAR AS filepath, k AS idx, ((k - 1) * 9)::DOUBLE AS start_s, (k * 9)::DOUBLE AS end_s, 'c' || k || '@' || s_suppkey AS cid, "
    "'http://x/' || k AS location, 'image/jpeg' AS type FROM supplier, (SELECT unnest([1, 2, 3])::INTEGER AS k)"
)
def storyboard_captions(spark, sf_dir):
    code = lambda s: timecode.srt_code(F.lit(float(s)))
    key = F.col("s_suppkey").cast("string")
    caption = lambda k: F.concat(F.lit(f"<figcaption>Slide #{k}: "), code(9 * k - 9), F.lit(" - "), code(9 * k), F.lit(f' (duration: 9.000)</figcaption><img src="cid:c{k}@'), key, F.lit('">'))
    head = F.lit('Content-Type: multipart/related; boundary="==b"\r\n\r\n')
    page = F.concat(F.lit("--==b\r\nContent-Type: text/html\r\n\r\n<!DOCTYPE html>"), *[caption(k) for k in (1, 2, 3)])
    sheet = lambda k: F.concat(F.lit(f"\r\n--==b\r\nContent-ID: <c{k}@"), key, F.lit(f">\r\nContent-Type: Image/JPEG;\r\n x=1\r\nContent-Location: http://x/{k}\r\n\r\nAAAA"))
    whole = F.concat(head, page, *[sheet(k) for k in (1, 2, 3)], F.lit("\r\n--==b--\r\n"))
    found = media.parse_storyboards(table(spark, sf_dir, "supplier").select(key.alias("path"), whole.alias("content")))
    return found.select("filepath", "idx", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "cid", "location", "type")


@query("SELECT page_id, trim(url) AS location, 'image/png' AS type, 'sheet_' || page_id || '.png' AS filename FROM pages")
def mime_headers(spark, sf_dir):
    headers = F.concat(F.lit("Content-type: Image/PNG; q=1\r\nX: 1\r\nCONTENT-LOCATION:\r\n  "), F.col("url"), F.lit("\r\nY: 2"))
    own = table(spark, sf_dir, "pages").select("page_id", mime.header_value(headers, "Content-Location").alias("location"), mime.content_type(headers).alias("type"))
    return own.withColumn("filename", mime.sheet_filename(F.col("page_id"), F.col("type")))


# Segmentation

_SEGMENTS = (
    "SELECT {key}, seg AS idx, count(*) AS n_pieces, min(s)::DOUBLE AS timestamp_start, max(e)::DOUBLE AS timestamp_end, string_agg(content, ' ' ORDER BY ord) AS content "
    "FROM (SELECT *, sum(CASE WHEN solo OR before IS NULL OR before THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY ord)::BIGINT AS seg "
    "FROM (SELECT *, lag(solo OR right(content, 1) IN ('.', '!', '?', '-')) OVER (PARTITION BY {key} ORDER BY ord) AS before FROM ({pieces}))) GROUP BY {key}, seg"
)
_LINES = (
    "SELECT doc_id, i AS ord, l AS content, i * 2.0 AS s, i * 2.0 + 1.5 AS e, false AS solo FROM (SELECT doc_id, unnest(ls) AS l, unnest(generate_series(0, len(ls) - 1)) AS i "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE l <> ''"
)


def _cues(own: DataFrame) -> DataFrame:
    return own.withColumn("line_idx", F.col("idx")).withColumn("embedding", F.lit(None).cast("array<double>"))


def _utterances(cues: DataFrame, key: str) -> DataFrame:
    found = utterance.to_utterances(_cues(cues), key)
    return found.select(key, F.col("idx"), F.size("line_idxs").cast("long").alias("n_pieces"), "timestamp_start", "timestamp_end", "content")


@query(_SEGMENTS.format(key="doc_id", pieces=_LINES))
def utterances(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "content")).where("content != ''")
    lines = lines.withColumn("idx", F.col("idx").cast("long"))
    return _utterances(lines.withColumn("timestamp_start", F.col("idx") * 2.0).withColumn("timestamp_end", F.col("idx") * 2.0 + 1.5), "doc_id")


@query(f"SELECT doc_id::VARCHAR AS filepath, * EXCLUDE (doc_id) FROM ({_SEGMENTS.format(key='doc_id', pieces=_LINES)})")
def udtf_utterances(spark, sf_dir):
    tables.register(spark)
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("filepath"), F.posexplode(F.split("text", "\n")).alias("idx", "content")).where("content != ''")
    cues = lines.withColumn("idx", F.col("idx").cast("long")).withColumn("timestamp_start", F.col("idx") * 2.0).withColumn("timestamp_end", F.col("idx") * 2.0 + 1.5)
    sql = "SELECT filepath, idx, size(line_idxs)::bigint AS n_pieces, timestamp_start, timestamp_end, content FROM to_utterances(TABLE({cues}))"
    return spark.sql(sql, cues=_cues(cues))


_A, _B = "replace(substr(text, 1, length(text) // 2), '-', '.')", "replace(substr(text, length(text) // 2 + 1), '-', '.')"
_DASHES = (
    f"SELECT conv_id, turn * 2.0 AS ord, {_A} AS content, turn * 4.0 AS s, turn * 4.0 + 1 AS e, true AS solo FROM conversations WHERE turn % 3 = 1 "
    f"UNION ALL SELECT conv_id, turn * 2.0 + 1, {_B}, turn * 4.0 + 1, turn * 4.0 + 2, false FROM conversations WHERE turn % 3 = 1 "
    "UNION ALL SELECT conv_id, turn * 2.0, replace(text, '-', '.'), turn * 4.0, turn * 4.0 + 2, false FROM conversations WHERE turn % 3 <> 1"
)


@query(_SEGMENTS.format(key="conv_id", pieces=_DASHES))
def utterances_dash(spark, sf_dir):
    plain = F.replace("text", F.lit("-"), F.lit("."))
    middle = F.floor(F.length(plain) / 2).cast("int")
    two = F.concat(F.lit("- "), F.substring(plain, F.lit(1), middle), F.lit(" - "), F.substring(plain, middle + 1, F.length(plain)))
    own = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), F.when(F.col("turn") % 3 == 1, two).otherwise(plain).alias("content"))
    return _utterances(own.withColumn("timestamp_start", F.col("idx") * 4.0).withColumn("timestamp_end", F.col("idx") * 4.0 + 2), "conv_id")


def _screenplay(spark, sf_dir):
    said = F.concat(F.lit("Well, "), F.trim(F.replace("text", F.lit("\n"), F.lit(" "))))
    who = F.concat(F.upper("role"), F.lit(" (V.O.)"))
    lines = F.when(F.col("role") == "system", F.array(F.concat(F.lit("N|"), said))).otherwise(
        F.array(F.concat(F.lit("C|"), who), F.lit("P|(quietly)"), F.concat(F.lit("U,G|"), said))
    )
    head = F.when(F.col("turn") == 0, F.array(F.concat(F.lit("S|INT. ROOM "), F.col("conv_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("filepath"), "turn", F.posexplode(F.concat(head, lines)).alias("k", "raw"))
    own = own.select("filepath", (F.col("turn") * 10 + F.col("k")).cast("int").alias("line_idx"), "raw")
    return screenplay.parse_screenplay(screenplay.parse_lines(own))


_HEAD = "(CASE WHEN turn = 0 THEN 1 ELSE 0 END)"


@query(
    "SELECT conv_id::VARCHAR AS filepath, 'INT. ROOM ' || conv_id AS heading, 'Cold-open' AS act, false AS deleted, 1 AS start_line, "
    f"max(turn * 10 + {_HEAD} + CASE WHEN role = 'system' THEN 0 ELSE 2 END)::INTEGER AS stop_line FROM conversations GROUP BY conv_id"
)
def screenplay_scenes(spark, sf_dir):
    scenes, _ = _screenplay(spark, sf_dir)
    return scenes.select("filepath", "heading", "act", "deleted", F.col("source_line_start_idx").alias("start_line"), F.col("source_line_stop_idx").alias("stop_line"))


@query(
    "SELECT filepath, row_number() OVER (PARTITION BY filepath ORDER BY line)::INTEGER AS id, type, value, character FROM ("
    f"SELECT conv_id::VARCHAR AS filepath, turn * 10 + {_HEAD} AS line, 'dialogue' AS type, NULL AS value, upper(role) AS character FROM conversations WHERE role <> 'system' "
    f"UNION ALL SELECT conv_id::VARCHAR, turn * 10 + {_HEAD} + 1, 'P', 'quietly', NULL FROM conversations WHERE role <> 'system' "
    f"UNION ALL SELECT conv_id::VARCHAR, turn * 10 + {_HEAD} + 2, 'U', 'Well, ' || {_LINE}, NULL FROM conversations WHERE role <> 'system' "
    f"UNION ALL SELECT conv_id::VARCHAR, turn * 10 + {_HEAD}, 'N', 'Well, ' || {_LINE}, NULL FROM conversations WHERE role = 'system')"
)
def screenplay_elements(spark, sf_dir):
    _, elements = _screenplay(spark, sf_dir)
    return elements.select("filepath", "id", "type", F.array_join("value", " ").alias("value"), "character")


@query(
    "SELECT filepath, (row_number() OVER (PARTITION BY filepath ORDER BY turn, n))::INTEGER AS id, character, sentence AS content FROM (SELECT filepath, turn, upper(role) AS character, n, sentence FROM ("
    + _SENTENCES.format(keys="filepath, turn, role", text="said", table=f"(SELECT conv_id::VARCHAR AS filepath, turn, role, 'Well, ' || {_LINE} AS said FROM conversations WHERE role <> 'system')")
    + "))"
)
def singleton_utterances(spark, sf_dir):
    found = screenplay.singleton_utterances(_screenplay(spark, sf_dir)[1])
    return found.select("filepath", "id", "character", "content")


# Sequences

_AB = (
    "a AS (SELECT label, vec_id AS i, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 2 = 0), "
    "b AS (SELECT label, vec_id AS j, embedding::DOUBLE[] AS y FROM embeddings WHERE vec_id % 2 = 1)"
)
_MEASURES = {
    "cosine": "list_cosine_similarity(x, y)",
    "dot": "list_dot_product(x, y)",
    "euclidean": "list_distance(x, y)",
    "manhattan": "list_sum(list_transform(generate_series(1, len(x)), lambda k: abs(x[k] - y[k])))",
}


def _halves(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings")
    return own.where("vec_id % 2 = 0"), own.where("vec_id % 2 = 1")


def _register_pairs(metric: str) -> None:
    kind = "similarity" if metric in ("cosine", "dot") else "distance"

    def run(spark, sf_dir):
        a, b = _halves(spark, sf_dir)
        return anchoring.all_pairs(a, b, ["label"], "vec_id", metric, kind, digits=6)

    query(f"WITH {_AB} SELECT a.label, i, j, round({_MEASURES[metric]}, 6) AS value FROM a JOIN b ON a.label = b.label", f"{metric}_pairs")(run)


for _metric in vector.METRICS:
    _register_pairs(_metric)


@query("SELECT vec_id, unnest(generate_series(0, len(x) - 1)) AS k, round(unnest(x) / sqrt(list_dot_product(x, x)), 6) AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)")
def normalize(spark, sf_dir):
    unit = vector.normalize(vector.as_double(F.col("embedding")))
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(unit).alias("k", "value"))
    return own.select("vec_id", F.col("k").cast("long").alias("k"), six("value").alias("value"))


THRESHOLD = 0.25
_CELLS = (
    f"WITH {_AB}, s AS (SELECT a.label, i, j, list_cosine_similarity(x, y) AS v FROM a JOIN b ON a.label = b.label), t AS (SELECT *, count(*) OVER (PARTITION BY label, i) AS ri, "
    f"count(*) OVER (PARTITION BY label, j) AS cj FROM s WHERE v > {THRESHOLD}), c AS (SELECT * FROM t WHERE ri BETWEEN 1 AND 2 AND cj BETWEEN 1 AND 2) "
)


@query(_CELLS + "SELECT label, i, j, round(v, 6) AS value, ri AS row_matches, cj AS col_matches FROM c")
def anchors(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    cells = anchoring.anchor_cells(anchoring.close_pairs(a, b, ["label"], "vec_id", THRESHOLD), ["label"], THRESHOLD)
    return cells.select("label", "i", "j", six("value").alias("value"), "row_matches", "col_matches")


@query(_CELLS + "SELECT DISTINCT label, i AS vec_id FROM c")
def anchor_items_a(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return anchoring.anchors(a, b, ["label"], "vec_id", THRESHOLD)[0].select("label", "vec_id")


@query(_CELLS + "SELECT DISTINCT label, j AS vec_id FROM c")
def anchor_items_b(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return anchoring.anchors(a, b, ["label"], "vec_id", THRESHOLD)[1].select("label", "vec_id")


@query(
    f"WITH {_AB}, s AS (SELECT a.label, i, j, list_cosine_similarity(x, y) AS v FROM a JOIN b ON a.label = b.label), t AS (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY v DESC, j) AS r, "
    "row_number() OVER (PARTITION BY label, j ORDER BY v DESC, i) AS c FROM s) SELECT label, i, j, round(v, 6) AS value FROM t WHERE r = 1 AND c = 1"
)
def mutual_best(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return anchoring.mutual_best(a, b, ["label"], "vec_id").withColumn("value", six("value"))


#: Chains of the query: similarity in thousandths, of which a skipped position costs GAP and a chain is worth LEAST or more.
SEED, GAP, LEAST = 0.15, 4.0, 300.0
_POSITIONED = (
    f"{_AB}, pa AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY i) - 1 AS i, x FROM a), pb AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY j) - 1 AS j, y FROM b)"
)
_CHAINS = (
    f"WITH RECURSIVE {_POSITIONED}, n AS (SELECT label, i, j, round(1000 * list_cosine_similarity(x, y)) AS w, row_number() OVER (PARTITION BY label ORDER BY i, j) AS k "
    f"FROM pa JOIN pb USING (label) WHERE list_cosine_similarity(x, y) > {SEED}), "
    "r AS (SELECT DISTINCT label, 0::BIGINT AS k, NULL::BIGINT AS i, NULL::BIGINT AS j, 0.0::DOUBLE AS w, 0.0::DOUBLE AS s, NULL::BIGINT AS pi, NULL::BIGINT AS pj, "
    "[]::STRUCT(v DOUBLE, i BIGINT, j BIGINT)[] AS done FROM n UNION ALL "
    f"SELECT label, k, i, j, w, s, pi, pj, list_append(done, {{'v': s + {GAP} * (i + j), 'i': i, 'j': j}}) FROM (SELECT *, CASE WHEN gain > 0 THEN w + gain ELSE w END AS s, "
    f"CASE WHEN gain > 0 THEN best.i END AS pi, CASE WHEN gain > 0 THEN best.j END AS pj FROM (SELECT *, best.v - {GAP} * (i + j - 2) AS gain FROM "
    "(SELECT n.label, n.k, n.i, n.j, n.w, r.done, list_max(list_filter(r.done, lambda e: e.i < n.i AND e.j < n.j)) AS best FROM r JOIN n ON n.label = r.label AND n.k = r.k + 1)))), "
    "f AS (SELECT label, i, j, w, s, pi, pj FROM r WHERE k > 0), "
    "up AS (SELECT label, i AS ei, j AS ej, s AS es, i, j, pi, pj FROM f UNION ALL SELECT up.label, ei, ej, es, f.i, f.j, f.pi, f.pj FROM up JOIN f ON f.label = up.label AND f.i = up.pi AND f.j = up.pj), "
    "o AS (SELECT up.label, ei, ej, es, up.i, up.j, f.w, f.s FROM up JOIN f ON f.label = up.label AND f.i = up.i AND f.j = up.j QUALIFY row_number() OVER (PARTITION BY up.label, up.i, up.j ORDER BY es DESC, ei, ej) = 1), "
    f"h AS (SELECT label, ei, ej, es - arg_min(s - w, i) AS chain_score FROM o GROUP BY label, ei, ej, es HAVING es - arg_min(s - w, i) >= {LEAST}), "
    "c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY chain_score DESC, ei, ej) AS chain FROM h) "
)


@query(_CHAINS + "SELECT label, chain, row_number() OVER (PARTITION BY label, chain ORDER BY i) AS pos, i, j, w AS weight, s AS score, chain_score FROM o JOIN c USING (label, ei, ej)")
def chain_anchors(spark, sf_dir):
    a, b = (timeline.with_position(x, ["label"], ["vec_id"]) for x in _halves(spark, sf_dir))
    seeds = anchoring.close_pairs(a, b, ["label"], "pos", SEED)
    return chaining.chain_anchors(spark, seeds.withColumn("weight", F.round(F.col("value") * 1000)), ["label"], GAP, LEAST)


#: Lines of a scene and of a window of the query; costs in thousandths.
SCENE, JUMP, PENALTY, SKIP = 5, 2, 15.0, 820.0
_PLACED = (
    f"WITH RECURSIVE {_POSITIONED}, c AS (SELECT label, scene, list(cost ORDER BY w) AS cost FROM (SELECT label, scene, w, round(1000 * avg(1 - m)) AS cost FROM "
    f"(SELECT label, i // {SCENE} AS scene, i, j // {SCENE} AS w, max(list_cosine_similarity(x, y)) AS m FROM pa JOIN pb USING (label) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL), "
    "r AS (SELECT label, -1::BIGINT AS scene, list_transform(generate_series(1, len(cost) + 1), lambda k: {'v': CASE WHEN k = 1 THEN 0.0::DOUBLE ELSE 'infinity'::DOUBLE END, 'path': []::BIGINT[]}) AS st "
    "FROM c WHERE scene = 0 UNION ALL SELECT label, scene, list_transform(picked, lambda p, k: {'v': p.v, 'path': list_append(st[p.u].path, CASE WHEN p.skipped = 0 THEN k - 2 END)}) FROM "
    "(SELECT c.label, c.scene, r.st, list_transform(generate_series(1, len(r.st)), lambda k: list_min(list_prepend("
    f"{{'v': r.st[k].v + {SKIP}, 'skipped': 1, 'u': k}}, list_transform(list_filter(generate_series(1, len(r.st)), lambda u: k > 1 AND u <> k AND abs(k - u - 1) <= {JUMP}), "
    f"lambda u: {{'v': r.st[u].v + {PENALTY} * abs(k - u - 1) + c.cost[k - 1], 'skipped': 0, 'u': u}})))) AS picked FROM r JOIN c ON c.label = r.label AND c.scene = r.scene + 1)), "
    "e AS (SELECT label, list_transform(st, lambda x: x.v) AS vs, st FROM r QUALIFY scene = max(scene) OVER (PARTITION BY label)), "
    "t AS (SELECT label, list_min(vs) AS total, st[list_position(vs, list_min(vs))].path AS path FROM e), "
    "p AS (SELECT label, total, unnest(path) AS w, unnest(generate_series(0, len(path) - 1)) AS scene FROM t) "
)


@query(_PLACED + "SELECT p.label, p.scene, p.w AS window_no, c.cost[p.w + 1] AS cost, total FROM p JOIN c ON c.label = p.label AND c.scene = p.scene")
def scene_order(spark, sf_dir):
    a, b = (timeline.with_position(x, ["label"], ["vec_id"]) for x in _halves(spark, sf_dir))
    costs = anchoring.best_matches(a, b, ["label"], "pos", SCENE, SCENE)
    return scenes.align_packed(costs, ["label"], JUMP, PENALTY, SKIP, digits=0, unit=1000).withColumnRenamed("window", "window_no")


#: Jumps of -2 to 2 states of the aligning model: log scores, in thousandths like the cells, and probabilities; the cells' sharpness; the least posterior given.
STEPS, JUMPS, SHARP, LIKELY = [-300.0, -150.0, -100.0, 0.0, -150.0], [0.05, 0.15, 0.2, 0.45, 0.15], 8.0, 0.05
_EMITTED = f"{_POSITIONED}, c AS (SELECT label, i, list({{value}} ORDER BY j) AS c FROM (SELECT label, i, j, list_cosine_similarity(x, y) AS v FROM pa JOIN pb USING (label)) GROUP BY label, i)"
_VITERBI = (
    f"WITH RECURSIVE {_EMITTED.format(value='round(1000 * v)')}, r AS (SELECT label, i, c AS s, []::BIGINT[] AS came FROM c WHERE i = 0 "
    "UNION ALL SELECT label, i, list_transform(picked, lambda p: p.v), list_transform(picked, lambda p: -p.u) FROM (SELECT c.label, c.i, list_transform(generate_series(1, len(c.c)), "
    f"lambda k: list_max(list_transform(generate_series(greatest(1, k - 2), least(len(c.c), k + 2)), lambda u: {{'v': r.s[u] + {STEPS}[k - u + 3] + c.c[k], 'u': -u}}))) AS picked "
    "FROM r JOIN c ON c.label = r.label AND c.i = r.i + 1)), "
    "e AS (SELECT label, i, list_max(s) AS total, list_position(s, list_max(s))::BIGINT AS j FROM r QUALIFY i = max(i) OVER (PARTITION BY label)), "
    "w AS (SELECT label, i, j, total FROM e UNION ALL SELECT w.label, w.i - 1, r.came[w.j], total FROM w JOIN r ON r.label = w.label AND r.i = w.i WHERE w.i > 0) "
)
_NEAR = "generate_series(greatest(1, k - 2), least(len(c.c), k + 2))"
_FORWARD_BACKWARD = (
    f"WITH RECURSIVE {_EMITTED.format(value=f'exp({SHARP} * v)')}, n AS (SELECT label, max(i) AS last FROM c GROUP BY label), "
    "f AS (SELECT label, i, c, list_sum(c) AS s, list_transform(c, lambda x: x / list_sum(c)) AS a FROM c WHERE i = 0 UNION ALL "
    "SELECT label, i, c, list_sum(a), list_transform(a, lambda x: x / list_sum(a)) FROM (SELECT c.label, c.i, c.c, list_transform(generate_series(1, len(c.c)), "
    f"lambda k: c.c[k] * list_sum(list_transform({_NEAR}, lambda u: f.a[u] * {JUMPS}[k - u + 3]))) AS a FROM f JOIN c ON c.label = f.label AND c.i = f.i + 1)), "
    "g AS (SELECT f.label, f.i, f.c, f.s, list_transform(f.c, lambda x: 1.0::DOUBLE) AS b FROM f JOIN n ON n.label = f.label AND n.last = f.i UNION ALL "
    f"SELECT c.label, c.i, c.c, c.s, list_transform(generate_series(1, len(c.c)), lambda k: list_sum(list_transform({_NEAR}, lambda u: {JUMPS}[u - k + 3] * g.c[u] * g.b[u])) / g.s) "
    "FROM g JOIN f AS c ON c.label = g.label AND c.i = g.i - 1) "
)


def _scored(spark, sf_dir, values):
    """Cells of all positions of the two sequences of each label, made of their cosines."""
    a, b = (timeline.with_position(x, ["label"], ["vec_id"]) for x in _halves(spark, sf_dir))
    return hmm.Products(a, b, "pos", values)


def _thousandths(value, i, j):
    return anchoring.rounded(value * 1000, 0)


def _sharpened(value, i, j):
    return value * SHARP


@query(_VITERBI + "SELECT label, i, j - 1 AS j, total FROM w")
def hmm_path(spark, sf_dir):
    return hmm.best_path(spark, _scored(spark, sf_dir, _thousandths), ["label"], STEPS)


@query(
    _FORWARD_BACKWARD + "SELECT label, i, j - 1 AS j, round(p, 6) AS posterior, round(z, 6) AS log_likelihood FROM (SELECT label, i, unnest(list_transform(generate_series(1, len(g.b)), lambda k: f.a[k] * g.b[k])) AS p, "
    f"unnest(generate_series(1, len(g.b))) AS j FROM f JOIN g USING (label, i)) JOIN (SELECT label, sum(ln(s)) AS z FROM f GROUP BY label) USING (label) WHERE p >= {LIKELY}"
)
def hmm_posteriors(spark, sf_dir):
    cells = _scored(spark, sf_dir, _sharpened)
    found = hmm.posteriors(spark, cells, ["label"], [math.log(p) for p in JUMPS], LIKELY)
    return found.withColumn("posterior", six("posterior")).withColumn("log_likelihood", six("log_likelihood"))


@query(
    _FORWARD_BACKWARD + "SELECT d - 3 AS jump, round(n / sum(n) OVER (), 6) AS probability FROM (SELECT d, sum(list_sum(list_transform(generate_series(greatest(1, 4 - d), least(len(f.a), len(f.a) + 3 - d)), "
    f"lambda u: f.a[u] * {JUMPS}[d] * g.c[u + d - 3] * g.b[u + d - 3] / g.s))) AS n FROM f JOIN g ON g.label = f.label AND g.i = f.i + 1, (SELECT unnest(generate_series(1, 5)) AS d) GROUP BY d)"
)
def hmm_jumps(spark, sf_dir):
    cells = _scored(spark, sf_dir, _sharpened)
    moves, _ = hmm.fit_moves(spark, cells, ["label"], [math.log(p) for p in JUMPS], 1)
    return spark.createDataFrame([(k - 2, round(math.exp(m), 6)) for k, m in enumerate(moves)], "jump long, probability double")


#: Weights of the field's features (cosine, and nearness of the two places in their sequences), at which its gradient is taken.
WEIGHTS = [4.0, 2.0]
_FIELD = (
    f"WITH RECURSIVE {_POSITIONED}, na AS (SELECT label, count(*) AS n FROM pa GROUP BY label), nb AS (SELECT label, count(*) AS m FROM pb GROUP BY label), "
    "v AS (SELECT pa.label AS la, pb.label AS lb, i, j, list_cosine_similarity(x, y) AS v0, 1 - abs(i / n - j / m) AS v1 "
    "FROM pa JOIN pb ON pb.label BETWEEN pa.label AND pa.label + 1 JOIN na ON na.label = pa.label JOIN nb ON nb.label = pb.label), "
    f"c AS (SELECT la, lb, i, list(exp({WEIGHTS[0]} * v0 + {WEIGHTS[1]} * v1) ORDER BY j) AS c, list(v0 ORDER BY j) AS v0, list(v1 ORDER BY j) AS v1 FROM v GROUP BY la, lb, i), "
    "n AS (SELECT la, lb, max(i) AS last FROM c GROUP BY la, lb), "
    "f AS (SELECT la, lb, i, c, v0, v1, list_sum(c) AS s, list_transform(c, lambda x: x / list_sum(c)) AS a FROM c WHERE i = 0 UNION ALL "
    "SELECT la, lb, i, c, v0, v1, list_sum(a), list_transform(a, lambda x: x / list_sum(a)) FROM (SELECT c.la, c.lb, c.i, c.c, c.v0, c.v1, list_transform(generate_series(1, len(c.c)), "
    f"lambda k: c.c[k] * list_sum(list_transform({_NEAR}, lambda u: f.a[u] * {JUMPS}[k - u + 3]))) AS a FROM f JOIN c ON c.la = f.la AND c.lb = f.lb AND c.i = f.i + 1)), "
    "g AS (SELECT f.la, f.lb, f.i, f.c, f.s, list_transform(f.c, lambda x: 1.0::DOUBLE) AS b FROM f JOIN n ON n.la = f.la AND n.lb = f.lb AND n.last = f.i UNION ALL "
    f"SELECT c.la, c.lb, c.i, c.c, c.s, list_transform(generate_series(1, len(c.c)), lambda k: list_sum(list_transform({_NEAR}, lambda u: {JUMPS}[u - k + 3] * g.c[u] * g.b[u])) / g.s) "
    "FROM g JOIN f AS c ON c.la = g.la AND c.lb = g.lb AND c.i = g.i - 1), "
    "z AS (SELECT la, lb, sum(ln(s)) AS z FROM f GROUP BY la, lb), "
    "o AS (SELECT la, max(z) AS m, max(CASE WHEN la = lb THEN z END) AS r FROM z GROUP BY la), "
    "t AS (SELECT la, any_value(r) - any_value(m) - ln(sum(exp(z - m))) AS value, any_value(m) + ln(sum(exp(z - m))) AS whole FROM z JOIN o USING (la) WHERE r IS NOT NULL GROUP BY la), "
    "h AS (SELECT la, lb, (CASE WHEN la = lb THEN 1 ELSE 0 END) - exp(z - whole) AS share FROM z JOIN t USING (la)), "
    "e AS (SELECT la, lb, unnest([0, 1]) AS k, unnest([sum(list_sum(list_transform(generate_series(1, len(f.a)), lambda q: f.a[q] * g.b[q] * f.v0[q]))), "
    "sum(list_sum(list_transform(generate_series(1, len(f.a)), lambda q: f.a[q] * g.b[q] * f.v1[q])))]) AS e FROM f JOIN g USING (la, lb, i) GROUP BY la, lb UNION ALL "
    "SELECT f.la, f.lb, d + 1 AS k, sum(list_sum(list_transform(generate_series(greatest(1, 4 - d), least(len(f.a), len(f.a) + 3 - d)), "
    f"lambda u: f.a[u] * {JUMPS}[d] * g.c[u + d - 3] * g.b[u + d - 3] / g.s))) AS e FROM f JOIN g ON g.la = f.la AND g.lb = f.lb AND g.i = f.i + 1, (SELECT unnest(generate_series(1, 5)) AS d) GROUP BY f.la, f.lb, d) "
)


def _cosine_and_nearness(value, i, j, n, m):
    return np.stack((value, 1 - np.abs(i / n - j / m)), 2)


@query(
    _FIELD + "SELECT 'objective' AS part, 0::BIGINT AS k, round(avg(value), 6) AS value FROM t UNION ALL "
    "SELECT 'gradient', k::BIGINT, round(sum(share * e) / (SELECT count(*) FROM t), 6) FROM e JOIN h USING (la, lb) GROUP BY k"
)
def crf_gradient(spark, sf_dir):
    a, b = (timeline.with_position(x, ["label"], ["vec_id"]).where("label is not null") for x in _halves(spark, sf_dir))
    # Each label's sequence has its own partner and the next label's for candidates.
    la = a.withColumn("la", F.col("label")).withColumn("lb", F.explode(F.array(F.col("label"), F.col("label") + 1)))
    lb = b.withColumn("lb", F.col("label")).withColumn("la", F.explode(F.array(F.col("label") - 1, F.col("label"))))
    n, m = (x.groupBy("label").agg(F.count("*").alias(c)).withColumnRenamed("label", k) for x, c, k in ((a, "n", "la"), (b, "m", "lb")))
    cells = hmm.Products(la.join(n, "la").join(m, "lb"), lb, "pos", _cosine_and_nearness, ("n", "m"))
    field = crf.Field(spark, cells, ["la", "lb"], ["la"], F.col("la") == F.col("lb"), ["value", "near"])
    objective, gradient = field.climb(WEIGHTS, [math.log(p) for p in JUMPS])
    rows = [("objective", 0, round(objective, 6) + 0.0)] + [("gradient", k, round(float(g), 6) + 0.0) for k, g in enumerate(gradient)]
    return spark.createDataFrame(rows, "part string, k long, value double")


#: Overlap of words from which two lines of a conversation are a pair.
OVERLAP = 0.2
_SAID = (
    "SELECT conv_id, role, turn * 100000 + k AS id, s AS text FROM (SELECT conv_id, role, turn, unnest(ls) AS s, unnest(generate_series(0, len(ls) - 1)) AS k "
    "FROM (SELECT conv_id, role, turn, string_split(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'), '.') AS ls FROM conversations))"
)
_WORDED = "SELECT conv_id, min(id) AS id, count(*) AS n, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM said WHERE role "


@query(
    f"WITH said AS ({_SAID}), a AS ({_WORDED} = 'user' GROUP BY conv_id, text), b AS ({_WORDED} <> 'user' GROUP BY conv_id, text), "
    "p AS (SELECT a.conv_id, a.id AS i, b.id AS j, a.n AS n_i, b.n AS n_j, len(list_intersect(a.w, b.w)) AS s, len(a.w) + len(b.w) AS t, a.text AS x, b.text AS y FROM a JOIN b USING (conv_id) WHERE len(a.w) > 0 AND len(b.w) > 0) "
    "SELECT conv_id, i, j, n_i, n_j, round(s / (t - s), 6) AS jaccard, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) AS ratio, "
    f"round(greatest(s / (t - s), 1 - levenshtein(x, y) / greatest(length(x), length(y))), 6) AS score FROM p WHERE s >= {OVERLAP} * (t - s)"
)
def fuzzy_pairs(spark, sf_dir):
    # DuckDB's distance counts bytes, so letters beyond ASCII are one sign here.
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    said = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.posexplode(F.split(plain, r"\.")).alias("k", "text"))
    said = said.withColumn("id", F.col("turn") * 100_000 + F.col("k"))
    found = fuzzy.fuzzy_pairs(said.where("role = 'user'"), said.where("role != 'user'"), ["conv_id"], "id", "text", OVERLAP)
    return found.select("conv_id", "i", "j", "n_i", "n_j", *[six(c).alias(c) for c in ("jaccard", "ratio", "score")])


def _aligned(spark, sf_dir, method):
    a, b = _halves(spark, sf_dir)
    return warping.dtw(a, b, ["label"], "vec_id", "cosine", method)


_ACCUMULATED = (
    f"WITH RECURSIVE {_AB}, q AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY i) AS i, x FROM a), "
    "t AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY j) AS j, y FROM b), "
    "c AS (SELECT label, i, list(1 - list_cosine_similarity(x, y) ORDER BY j) AS c FROM q JOIN t USING (label) GROUP BY label, i), "
    "r AS (SELECT label, i, {first} AS acc FROM c WHERE i = 1 UNION ALL SELECT c.label, c.i, list_reduce(list_prepend([c.c[1] + r.acc[1]], "
    "list_transform(generate_series(2, len(c.c)), lambda k: [c.c[k], r.acc[k], r.acc[k - 1]])), lambda p, e: list_append(p, e[1] + least(e[2], e[3], p[len(p)]))) "
    "FROM r JOIN c ON c.label = r.label AND c.i = r.i + 1), "
    "d AS (SELECT label, i, unnest(acc) AS v, unnest(generate_series(1, len(acc))) AS j FROM r), "
    "ends AS (SELECT label, {end_i} AS i, {end_j} AS j FROM d GROUP BY label), "
    "w AS (SELECT label, i, j, 0 AS n FROM ends UNION ALL SELECT w.label, "
    "CASE WHEN w.i = 1 THEN 1 WHEN w.j = 1 OR least(g.v, u.v) <= l.v THEN w.i - 1 ELSE w.i END, "
    "CASE WHEN w.i = 1 THEN w.j - 1 WHEN w.j = 1 THEN 1 WHEN g.v <= u.v AND g.v <= l.v THEN w.j - 1 WHEN u.v <= l.v THEN w.j ELSE w.j - 1 END, w.n + 1 "
    "FROM w LEFT JOIN d g ON g.label = w.label AND g.i = w.i - 1 AND g.j = w.j - 1 LEFT JOIN d u ON u.label = w.label AND u.i = w.i - 1 AND u.j = w.j "
    "LEFT JOIN d l ON l.label = w.label AND l.i = w.i AND l.j = w.j - 1 WHERE {more}), "
    "path AS (SELECT label, i - 1 AS i, j - 1 AS j, (max(n) OVER (PARTITION BY label) - n) AS k FROM w), "
    "total AS (SELECT label, d.v AS distance FROM ends JOIN d USING (label, i, j)) "
)
_CLASSIC = _ACCUMULATED.format(
    first="list_reduce(list_prepend([c[1]], list_transform(generate_series(2, len(c)), lambda k: [c[k]])), lambda p, e: list_append(p, e[1] + p[len(p)]))",
    end_i="max(i)", end_j="max(j)", more="w.i > 1 OR w.j > 1",
)
_SUBSEQUENCE = _ACCUMULATED.format(first="c", end_i="max(i)", end_j="arg_min(j, (-i, v, j))", more="w.i > 1")


@query(_CLASSIC + "SELECT label, round(any_value(distance), 6) AS distance, count(*)::INTEGER AS steps FROM path JOIN total USING (label) GROUP BY label")
def dtw_distance(spark, sf_dir):
    return _aligned(spark, sf_dir, "classic").select("label", six("distance").alias("distance"), F.size("path").alias("steps"))


@query(_CLASSIC + "SELECT label, k::INTEGER AS k, i::INTEGER AS i, j::INTEGER AS j FROM path")
def dtw_path(spark, sf_dir):
    return _aligned(spark, sf_dir, "classic").select("label", F.posexplode("path").alias("k", "c")).select("label", "k", "c.i", "c.j")


@query(
    _SUBSEQUENCE + "SELECT label, round(any_value(distance), 6) AS distance, arg_min(j, k)::INTEGER AS first_j, arg_max(j, k)::INTEGER AS last_j "
    "FROM path JOIN total USING (label) GROUP BY label"
)
def dtw_subsequence(spark, sf_dir):
    found = _aligned(spark, sf_dir, "subsequence")
    return found.select("label", six("distance").alias("distance"), F.element_at("path", 1)["j"].alias("first_j"), F.element_at("path", -1)["j"].alias("last_j"))


@query(_CLASSIC + "SELECT label, k::BIGINT AS k, i, j, round(distance, 6) AS distance FROM path JOIN total USING (label)")
def dtw_tiles(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    found = tiles.dtw_tiles(a, b, ["label"], "vec_id")
    k = F.row_number().over(Window.partitionBy("label").orderBy("i", "j")) - 1
    return found.select("label", k.cast("long").alias("k"), "i", "j", six("distance").alias("distance"))


# Sprites and shots


@query("SELECT p_partkey, k AS pos, k * 24 AS frame_idx, k::DOUBLE AS ts, round(k * 24 / 23.976::DOUBLE, 6) AS ts_exact FROM (SELECT p_partkey, unnest(generate_series(0, (p_size * 30 - 1) // 24)) AS k FROM part)")
def sprite_plan_select(spark, sf_dir):
    videos = table(spark, sf_dir, "part").select("p_partkey", F.lit(23.976).alias("fps"), (F.col("p_size") * 30).cast("long").alias("n_frames"))
    found = sprites.plan_select(videos, 1.0)
    return found.select("p_partkey", "pos", "frame_idx", F.col("timestamp").alias("ts"), six("ts_exact").alias("ts_exact"))


@query("SELECT p_partkey, k AS pos, k / 2::DOUBLE AS ts FROM (SELECT p_partkey, unnest(generate_series(0, (p_size * 2)::BIGINT)) AS k FROM part)")
def sprite_plan_seek(spark, sf_dir):
    found = sprites.plan_seek(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("duration")), 2.0)
    return found.select("p_partkey", "pos", F.col("timestamp").alias("ts"))


@query(
    "SELECT p_partkey, k AS cell, k % c * (w // c) AS x1, k // c * (h // r) AS y1, (k % c + 1) * (w // c) AS x2, (k // c + 1) * (h // r) AS y2 FROM (SELECT *, unnest(generate_series(0, r * c - 1))::INTEGER AS k "
    "FROM (SELECT p_partkey, 90 + p_size AS h, 160 + 2 * p_size AS w, 1 + p_size % 4 AS r, 1 + p_size % 3 AS c FROM part))"
)
def grid_cells(spark, sf_dir):
    own = table(spark, sf_dir, "part").selectExpr("p_partkey", "90 + p_size AS h", "160 + 2 * p_size AS w", "1 + p_size % 4 AS r", "1 + p_size % 3 AS c")
    own = own.select("*", F.explode(grid.grid_cells(F.col("r"), F.col("c"))).alias("cell"))
    box = grid.cell_box(*map(F.col, ("cell", "h", "w", "r", "c")))
    return own.select("p_partkey", "cell", box.alias("b")).select("p_partkey", "cell", "b.x1", "b.y1", "b.x2", "b.y2")


@query(
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN (h * 0.5)::DOUBLE WHEN 1 THEN 270 WHEN 2 THEN h * 480 / w WHEN 3 THEN 270 ELSE h END // 1 AS height, "
    "CASE p_partkey % 5 WHEN 0 THEN w * 0.5 WHEN 1 THEN w * 270 / h WHEN 2 THEN 480 WHEN 3 THEN 480 ELSE w END // 1 AS width FROM (SELECT p_partkey, 1080 + p_size AS h, 1920 AS w FROM part)"
)
def resolve_shape(spark, sf_dir):
    k = F.col("p_partkey") % 5
    none = F.lit(None).cast("int")
    shape = grid.resolve_shape(1080 + F.col("p_size"), F.lit(1920), F.when(k.isin(1, 3), 270).otherwise(none), F.when(k.isin(2, 3), 480).otherwise(none), F.when(k == 0, 0.5))
    own = table(spark, sf_dir, "part").select("p_partkey", shape.alias("s"))
    return own.select("p_partkey", F.col("s.height").cast("long").alias("height"), F.col("s.width").cast("long").alias("width"))


ORACLES["resolve_shape"] = "SELECT p_partkey, floor(height)::BIGINT AS height, floor(width)::BIGINT AS width FROM (" + ORACLES["resolve_shape"].replace("END // 1", "END") + ")"


@query("SELECT event_id, round(value / (value + 50), 6) AS score FROM events WHERE value / (value + 50) > 0.5")
def shots(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select("event_id", (F.col("value") / (F.col("value") + 50)).alias("score"))
    return sprites.shots(frames, 0.5).select("event_id", six("score").alias("score"))


# Injected models


@query("SELECT conv_id, turn, length(text)::DOUBLE AS n_chars, (len(string_split(text, ' ')))::DOUBLE AS n_parts FROM conversations")
def embed(spark, sf_dir):
    model = lambda: lambda texts: [[len(t), len(t.split(" "))] for t in texts]
    found = models.embed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), model, "text")
    return found.select("conv_id", "turn", F.col("embedding")[0].alias("n_chars"), F.col("embedding")[1].alias("n_parts"))


@query("SELECT page_id, CASE WHEN strlen(html) % 2 = 0 THEN strlen(html) || ' bytes' END AS annotation, CASE WHEN strlen(html) % 2 = 1 THEN 'ValueError: odd' END AS error FROM pages")
def annotate(spark, sf_dir):
    def make():
        def client(prompt: str, image: bytes) -> str:
            if len(image) % 2:
                raise ValueError("odd")
            return f"{len(image)} bytes"

        return client

    own = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("frame"))
    return models.annotate(own, make).select("page_id", "annotation", "error")

"""Labelled screenplay lines to scenes, elements and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.errors import surely
from cueline.functions.text import MARKERS, clean_parenthetical, rstrip_space, split_character, split_sentences, strip_space
from cueline.schema import LABELS

#: Of a line's labels the first of these counts.
PRIORITY = ("S", "C", "U", "P", "E", "N", "T", "M", "D", "O", "A", "Y", "I", "G")
IGNORED = ("I", "G")
HEADS = ("S", "D", "A")
#: What may follow on a blank line without a break.
CONTINUES = ("S", "U", "P", "C")


def parse_lines(raw: DataFrame, on: str = "filepath", line: str = "line_idx", text: str = "raw") -> DataFrame:
    """``on``, line_idx, labels, label, content, text, starred of raw lines "LABELS|content".

    Page gaps and ignored labels go unless nothing else is left. A line without a bar, with an unknown label, or with content missing
    where its label needs some, is an error that names the line.
    """
    cut = F.split(F.col(text), r"\|", 2)
    labels = F.transform(F.split(cut[0], ","), lambda x: strip_space(x))
    kept = F.array_except(labels, F.array(*map(F.lit, IGNORED)))
    labels = F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(labels))
    known = F.array(*map(F.lit, LABELS))
    where = F.concat_ws(":", F.col(on), F.col(line).cast("string"))
    bad = F.when(F.size(cut) < 2, F.lit("no bar between labels and content")).when(F.size(F.array_except(labels, known)) > 0, F.lit("unknown label"))
    raw = surely(raw, F.when(bad.isNotNull(), F.concat(where, F.lit(": "), bad)))
    own = raw.select(on, F.col(line).alias("line_idx"), labels.alias("labels"), F.get(cut, F.lit(1)).alias("content"))
    first = F.filter(F.array(*map(F.lit, PRIORITY)), lambda p: F.array_contains("labels", p))
    trimmed = rstrip_space(F.col("content"))
    plain = strip_space(F.regexp_replace(trimmed, r"\*+$", ""))
    own = own.withColumn("label", F.element_at(first, 1))
    own = own.withColumn("text", plain).withColumn("starred", F.endswith(trimmed, F.lit("*")))
    empty = (F.col("label") != "O") & (F.col("text") == "")
    return surely(own, F.when(empty, F.concat_ws(":", F.col(on), F.col("line_idx").cast("string"), F.lit(" no content"))))


def metadata_lines(lines: DataFrame, on: str = "filepath") -> DataFrame:
    """The M lines before the first line that is neither M nor blank."""
    other = F.when(~F.col("label").isin("M", "O"), F.col("line_idx"))
    first = F.min(other).over(Window.partitionBy(on))
    return lines.withColumn("_first", first).where((F.col("label") == "M") & (F.col("_first").isNull() | (F.col("line_idx") < F.col("_first")))).drop("_first")


def _placed_lines(lines: DataFrame, on: str) -> DataFrame:
    """Metadata and body lines without blanks, each with its place: in_body, group, scene_no, element_no, kind, first, piece, depth, heading.

    ``group`` runs over headings and acts, ``scene_no`` over groups with more than an act line (it holds for lines that aren't acts), ``element_no``
    over runs of one state. All are windows in the file, so its lines are shuffled once. Metadata is in scene 0 and element 0.
    """
    w = Window.partitionBy(on).orderBy("line_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = lambda flag: F.sum(flag.cast("int")).over(upto).cast("int")
    label, before, body = F.col("label"), F.col("before"), F.col("in_body")
    begins = F.min(F.when(~label.isin("M", "O"), F.col("line_idx"))).over(Window.partitionBy(on))
    own = lines.withColumn("in_body", F.coalesce(F.col("line_idx") >= begins, F.lit(False))).withColumn("blanks", running(label == "O")).where("label != 'O'")
    inner = label.isin("P", "E", "U")
    mode = F.last(F.when(body & ~inner, label), ignorenulls=True).over(upto)
    own = own.withColumn("state", F.when(body, F.when(inner & (mode == "C"), F.lit("C")).otherwise(label)))
    own = own.withColumn("before", F.coalesce(F.lag("state").over(w), F.lit(""))).withColumn("gap", F.coalesce(F.col("blanks") > F.lag("blanks").over(w), F.lit(False)))
    scene = body & (((label == "A") & (before != "A")) | ((label == "S") & ~before.isin("A", "S")) | ((label == "D") != (before == "D")))
    element = body & ((label == "C") | (F.col("state") != before) | (F.col("gap") & ~before.isin(*CONTINUES)))
    counts = body & (label != "A") & (scene | before.isin("A", ""))
    own = own.withColumn("group", running(scene)).withColumn("scene_no", running(counts)).withColumn("element_no", running(element))

    one = Window.partitionBy(on, "element_no").orderBy("line_idx")
    so_far, whole = one.rowsBetween(Window.unboundedPreceding, Window.currentRow), one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("previous", F.lag("label").over(one)).withColumn("kind", F.first("state").over(so_far))
    own = own.withColumn("first", F.col("previous").isNull()).withColumn("turns", F.col("first") | (F.col("previous") != label))
    runs = F.sum(F.col("turns").cast("int")).over(so_far)
    talk = F.coalesce(F.col("kind") == "C", F.lit(False))
    child = talk & ~F.col("first") & (label != "E")
    own = own.withColumn("piece", F.when(child, runs).otherwise(F.lit(0))).withColumn("depth", child.cast("int"))
    own = own.withColumn("opens", F.when(child, F.col("turns")).otherwise(F.col("first")) & ~label.isin(*HEADS))
    own = own.withColumn("whole", F.struct(F.min("line_idx").over(whole).alias("start"), F.max("line_idx").over(whole).alias("stop"), F.max("starred").over(whole).alias("starred")))
    of_group = Window.partitionBy(on, "group").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return own.withColumn("heading", F.array_join(F.collect_list(F.when(label.isin("S", "D"), F.col("text"))).over(of_group), " "))


def _in_order(condition: Column, column: str) -> Column:
    """The values of ``column`` where ``condition`` holds, by line."""
    return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("line_idx", column)))), lambda x: x[column])


def _elements(placed: DataFrame, on: str) -> DataFrame:
    cleaned = F.when(F.col("label") == "P", clean_parenthetical(F.col("text"))).otherwise(F.col("text"))
    inside = placed.where(~F.col("label").isin(*HEADS)).withColumn("clean", cleaned)
    found = inside.groupBy(on, "scene_no", "element_no", "depth", "piece").agg(
        F.max("kind").alias("kind"),
        F.max("heading").alias("scene_heading"),
        F.min_by("label", "line_idx").alias("label"),
        split_character(F.max(F.when(F.col("first"), F.col("text")))).alias("name"),
        _in_order(F.col("label") == "E", "text").alias("more"),
        _in_order(F.lit(True), "clean").alias("value"),
        F.min("line_idx").alias("start"),
        F.max("line_idx").alias("stop"),
        F.bool_or("starred").alias("starred"),
        F.max("whole").alias("whole"),
    )
    talk = (F.col("kind") == "C") & (F.col("depth") == 0)
    meta = F.col("scene_no") == 0
    span = lambda part: F.when(talk, F.col(f"whole.{part}")).otherwise(F.col(part))
    order = Window.partitionBy(on).orderBy("scene_no", "element_no", "depth", "start")
    found = found.withColumn("id", F.row_number().over(order) + F.greatest(F.col("scene_no") - 1, F.lit(0)))
    found = found.withColumn("character", F.when(talk, F.col("name.name")))
    owner = F.last(F.when(F.col("depth") == 0, F.struct("id", "character")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = found.withColumn("owner", F.when(F.col("depth") == 1, owner))
    return found.select(
        on,
        "id",
        F.col("owner.id").alias("parent_id"),
        F.when(~meta, F.max("id").over(Window.partitionBy(on, "scene_no")) + 1).alias("scene_id"),
        "depth",
        F.when(meta, F.lit("metadata")).when(talk, F.lit("dialogue")).otherwise(F.col("label")).alias("type"),
        F.when(meta, F.array(F.array_join("value", "\n"))).when(~F.coalesce(talk, F.lit(False)), F.col("value")).alias("value"),
        "character",
        F.when(talk, F.concat("name.extensions", "more")).alias("extensions"),
        span("start").alias("source_line_start_idx"),
        span("stop").alias("source_line_stop_idx"),
        span("starred").alias("recently_modified"),
        F.when(~meta, F.col("scene_heading")).alias("scene_heading"),
        F.col("owner.character").alias("speaker"),
    )


def _scenes(placed: DataFrame, on: str) -> DataFrame:
    own = placed.withColumn("meta", F.max(~F.col("in_body")).over(Window.partitionBy(on)).cast("int")).where("in_body")
    head, mine = F.col("label").isin(*HEADS), F.col("label").isin("S", "D")
    inside = lambda c: F.when(~head, F.col(c))
    groups = own.groupBy(on, "group").agg(
        F.max("heading").alias("heading"),
        F.max("meta").alias("meta"),
        F.bool_or(F.col("label") == "A").alias("has_act"),
        F.array_join(_in_order(F.col("label") == "A", "text"), " ").alias("own_act"),
        F.bool_or(F.col("label") == "D").alias("deleted"),
        F.coalesce(F.min(inside("line_idx")), F.min(F.when(mine, F.col("line_idx")))).alias("source_line_start_idx"),
        F.coalesce(F.max(inside("line_idx")), F.max(F.when(mine, F.col("line_idx")))).alias("source_line_stop_idx"),
        F.coalesce(F.bool_or(inside("starred")), F.bool_or("starred")).alias("recently_modified"),
        F.bool_or(F.col("label") != "A").alias("counts"),
        F.sum(F.col("opens").cast("int")).cast("int").alias("n"),
    )
    w = Window.partitionBy(on).orderBy("group")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.withColumn("carried", F.last(F.when(F.col("has_act"), F.col("own_act")), ignorenulls=True).over(upto))
    groups = groups.withColumn("upto", F.sum("n").over(upto).cast("int")).where("counts").withColumn("scene_no", F.row_number().over(w))
    act = F.when((F.col("scene_no") == 1) & F.col("carried").isNull(), F.lit("Cold-open")).otherwise(F.coalesce("carried", F.lit("")))
    id_ = F.col("upto") + F.col("meta") + F.col("scene_no")
    return groups.select(on, id_.alias("id"), "scene_no", "heading", act.alias("act"), "deleted", "source_line_start_idx", "source_line_stop_idx", "recently_modified")


def parse_screenplay(lines: DataFrame, on: str = "filepath") -> tuple[DataFrame, DataFrame]:
    """(scenes, elements) of parsed ``lines``.

    scenes: ``on``, id, scene_no, heading, act, deleted, source_line_start_idx, source_line_stop_idx, recently_modified.
    elements: ``on``, id, parent_id, scene_id, depth, type (dialogue, metadata or a label), value, character, extensions, the same span columns,
    scene_heading and speaker (the character of the dialogue that a child is in).
    Element ids and scene ids share a counter in each file: metadata, then each scene's elements, a dialogue before its children, then the scene.
    Heading lines that follow each other are one heading. A deleted scene has its heading's span. A scene without heading and body doesn't count.
    Each table reads the lines once and shuffles them once, by file.
    """
    placed = _placed_lines(lines, on)
    return _scenes(placed, on), _elements(placed, on)


def singleton_utterances(elements: DataFrame, on: str = "filepath", markers: tuple = MARKERS) -> DataFrame:
    """One row for each sentence that a character says, numbered in each file."""
    said = elements.where("type = 'U' and parent_id is not null")
    cut = said.select("*", F.posexplode(split_sentences(F.array_join("value", " "), markers)).alias("n", "sentence"))
    order = Window.partitionBy(on).orderBy("id", "n")
    return cut.select(
        on,
        F.row_number().over(order).alias("id"),
        "scene_id",
        "scene_heading",
        F.col("speaker").alias("character"),
        F.col("sentence").alias("content"),
        "source_line_start_idx",
        "source_line_stop_idx",
        F.lit(None).cast("array<double>").alias("embedding"),
    )


def scene_trees(scenes: DataFrame, elements: DataFrame, on: str = "filepath") -> DataFrame:
    """One row for each scene with its elements nested, and their children in them, for a JSON sink."""
    spans = ["source_line_start_idx", "source_line_stop_idx", "recently_modified"]
    leaf = F.struct("id", *spans, "type", "value")
    kids = elements.where("depth = 1").groupBy(on, F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(leaf)).alias("content"))
    tops = elements.where("depth = 0 and scene_id is not null").join(kids, [on, "id"], "left")
    top = F.struct("id", *spans, "type", "value", "character", "extensions", "content")
    body = tops.groupBy(on, F.col("scene_id").alias("id")).agg(F.array_sort(F.collect_list(top)).alias("content"))
    return scenes.join(body, [on, "id"], "left").withColumn("content", F.coalesce("content", F.array().cast(body.schema["content"].dataType)))

import json

import pytest
from pyspark.sql import functions as F

from cueline.functions.layout import parse_character_line, split_simultaneous
from cueline.operators.screenplay import metadata_lines, parse_lines, parse_screenplay, scene_trees, singleton_utterances
from cueline.sources.media import read_screenplay_lines
from cueline.sources.sinks import scenes_json, write_scenes

PLAY = """M|A Quiet Harbour
M|by Nobody
O|
N|Before any heading.
S|INT. BOAT - NIGHT
S|(CONTINUED)
N,G|Waves. *
C|MARA (O.S.)
P|(low)
U|Who is there? Say it
U|again.
O|
N|Silence.
A|ACT ONE
S|EXT. QUAY - DAY
C|TOM
E|(into radio)
U|Come in!
T|CUT TO:
D|INT. CUT SCENE
D|- NIGHT
Y|Two years later
I,N|Not here"""


def parsed(spark, text=PLAY):
    raw = spark.createDataFrame([("p", i, x) for i, x in enumerate(text.split("\n"), 1)], "filepath string, line_idx int, raw string")
    return parse_lines(raw)


def test_lines(spark):
    rows = {r["line_idx"]: r for r in parsed(spark).collect()}
    assert (rows[7]["labels"], rows[7]["text"], rows[7]["starred"]) == (["N"], "Waves.", True)
    assert rows[23]["label"] == "N" and rows[3]["label"] == "O"
    assert [r["text"] for r in metadata_lines(parsed(spark)).orderBy("line_idx").collect()] == ["A Quiet Harbour", "by Nobody"]


@pytest.mark.parametrize("line, error", [("no bar", "no bar"), ("Q|x", "unknown label"), ("N|  ", "no content")])
def test_bad_lines(spark, line, error):
    with pytest.raises(Exception, match=error):
        parsed(spark, line).collect()


def test_scenes_and_elements(spark, tmp_path):
    scenes, elements = parse_screenplay(parsed(spark))
    heads = [(r["heading"], r["act"], r["deleted"]) for r in scenes.orderBy("scene_no").collect()]
    assert heads == [("", "Cold-open", False), ("INT. BOAT - NIGHT (CONTINUED)", "", False), ("EXT. QUAY - DAY", "ACT ONE", False), ("INT. CUT SCENE - NIGHT", "ACT ONE", True), ("", "ACT ONE", False)]
    own = elements.orderBy("id").collect()
    kinds = [(r["type"], r["depth"], r["character"], r["value"]) for r in own]
    assert kinds[0] == ("metadata", 0, None, ["A Quiet Harbour\nby Nobody"])
    assert ("dialogue", 0, "MARA", None) in kinds and ("P", 1, None, ["low"]) in kinds and ("U", 1, None, ["Who is there? Say it", "again."]) in kinds
    assert ("T", 0, None, ["CUT TO:"]) in kinds and ("Y", 0, None, ["Two years later"]) in kinds
    extensions = {r["character"]: r["extensions"] for r in own if r["type"] == "dialogue"}
    assert extensions["MARA"] == ["O.S."] and len(extensions["TOM"]) == 1
    ids = [r["id"] for r in own] + [r["id"] for r in scenes.collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    said = singleton_utterances(elements).orderBy("id").collect()
    assert [(r["character"], r["content"]) for r in said] == [("MARA", "Who is there?"), ("MARA", "Say it again."), ("TOM", "Come in!")]
    trees = scene_trees(scenes, elements)
    write_scenes(trees, f"{tmp_path}/scenes")
    assert spark.read.json(f"{tmp_path}/scenes").count() == 5
    assert [s["heading"] for s in json.loads(scenes_json(trees))] == [h for h, _, _ in heads]


def test_file(spark, tmp_path):
    (tmp_path / "p.txt").write_text("N|a\r\nC|B\r\nU|c.\n")
    rows = read_screenplay_lines(spark, str(tmp_path)).orderBy("line_idx").collect()
    assert [(r["line_idx"], r["raw"]) for r in rows] == [(1, "N|a"), (2, "C|B"), (3, "U|c.")]


@pytest.mark.parametrize(
    "line, found",
    [
        (None, None),
        ("   ", []),
        ("  ANN LEE (V.O.) ", [("ANN LEE", ["V.O."])]),
        ("ANN (V.O.) (LOUD)          BOB.", [("ANN", ["V.O.", "LOUD"]), ("BOB", [])]),
        ("ANN      BOB", [("ANN      BOB", [])]),
        ("A       B       C", [("A       B", []), ("C", [])]),
        ("A        B       C", [("A", []), ("B       C", [])]),
    ],
)
def test_character_lines(spark, line, found):
    own = spark.createDataFrame([(line,)], "l string").select(parse_character_line(F.col("l")).alias("c")).first()["c"]
    assert own == found if found is None else [(x["name"], x["extensions"]) for x in own] == found


def test_two_columns(spark):
    rows = [("k", 0, "alone"), ("k", 1, "left here     right one"), ("k", 2, "              still right"), ("k", 3, "  left"), ("k", 4, "a   b   c"), ("k", 5, None), ("m", 0, "                    first")]
    table = spark.createDataFrame(rows, "k string, n int, t string")
    found = [(r["left"], r["right"]) for r in split_simultaneous(table, "k", "n", "t").orderBy("k", "n").collect()]
    assert found == [("alone", ""), ("left here", "right one"), ("", "still right"), ("left", ""), ("a   b", "c"), ("", ""), ("first", "")]


@pytest.mark.parametrize("raw", ["Q|x", "no bar", "C|  "])
def test_a_bad_line_fails_a_count(spark, raw):
    lines = spark.createDataFrame([("f", 1, "N|fine"), ("f", 2, raw)], "filepath string, line_idx int, raw string")
    with pytest.raises(Exception, match="f:2"):
        parse_lines(lines).count()

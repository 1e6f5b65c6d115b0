import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
from cueline.llm import mixing, scratch
from cueline.llm.scratch import ROW, Scratch

COLUMNS = "doc_id long, text string, source string"


def test_mixing_takes_rows_with_null_and_repeated_ids(spark):
    rows = [(i % 40, f"w{i} " * (i % 9 + 1), f"s{i % 3}") for i in range(120)]
    rows += [(None, f"n{i} " * (i % 5 + 1), f"s{i % 4}" if i % 4 else None) for i in range(60)] + [(None, None, "s0"), (None, "", None)]
    rows += [(7, "equal rows", "s1")] * 5 + [(None, "equal rows", "s2")] * 5
    docs = spark.createDataFrame(rows, COLUMNS)
    found = Counter(map(tuple, mixing.mixed_documents(spark, docs).collect()))
    numbered = Scratch(spark, "test").number(docs)
    row_of = {r[ROW]: (r["doc_id"], r["text"], r["source"]) for r in numbered.collect()}
    due = Counter()
    for r in mixing.mix(spark, numbered, row=ROW).collect():
        due[row_of[r["row"]]] += r["copies"]
    assert len(row_of) == len(rows)
    assert found == +due
    assert {r[0] for r in found} == {*range(40), None}
    by_source = Counter()
    for (_, text, source), n in found.items():
        by_source[source] += n * len((text or "").split())
    targets = {r["source"]: r["target"] for r in mixing.mix(spark, docs).select("source", "target").distinct().collect()}
    assert all(abs(by_source[s] - t) <= 5 for s, t in targets.items())


def test_each_group_of_near_copies_keeps_one_row(spark):
    rng = random.Random(3)
    family = [" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(6)]
    rows = [(k, t, "a") for k, t in enumerate(family)] + [(0, family[0], "again")] * 3 + [(0, family[0] + " more", "b")]
    rows += [(None, family[1], "c")] * 4 + [(None, "only null ids here", "d")] * 5 + [(None, None, "e"), (None, "", "f"), (50, "", "g")]
    rows += [(2, "another text of the same id", "h"), (60, family[3] + " end", "i"), (None, family[4] + " end", "j")]
    docs = spark.createDataFrame(rows, COLUMNS)
    left = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    # Six families, the other text of id 2, the text of null ids only, and the empty texts.
    groups = Counter(next((k for k, f in enumerate(family) if (t or "").startswith(f)), t or "") for _, t, _ in left)
    assert groups == Counter([*range(6), "another text of the same id", "only null ids here", ""])
    assert {r[0] for r in left} == {*range(6), None, 50}


def test_the_whole_pipeline(spark, tmp_path):
    """Rows of each stage, with null and repeated ids, clashing columns, null, empty and very long texts."""
    rng = random.Random(9)
    prose = lambda n: " ".join(f"c{rng.randrange(400)}x" for _ in range(n))
    rows = [(i, prose(30 + i % 50) + (" vilest" * 6 if i % 6 == 0 else ""), f"s{i % 3}" if i % 7 else None) for i in range(240)]
    rows += [(5, rows[5][1], "s0")] * 4 + [(None, rows[7][1] + " more", "s1"), (5, "a text of its own with a repeated id", "s2"), (None, "no id but a text of its own here", None)]
    rows += [(None, None, "s1"), (900, "", "s1"), (901, prose(120_000), "s0")]
    docs = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], COLUMNS + ", copies int, row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    own, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        own = Scratch(spark, "test").save(stage(spark, own, str(tmp_path)), name)
        counts.append(own.count())
        if name != "packing":
            assert own.columns == docs.columns
    clean = [r for r in rows if "vilest" not in (r[1] or "")]
    assert counts[0] == len(clean)
    # Four repeats, one near copy, and one of the two empty texts go.
    assert counts[1] == len(clean) - 6
    assert {r["doc_id"] for r in own.select("doc_id").distinct().collect()} <= {r[0] for r in clean}
    bins = own.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] <= 2048 for r in bins) and len(bins) <= sum(r[1] for r in bins) / 2048 * 1.1 + 1
    assert own.where("doc_id is null").count() >= 1
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.drop("sequence_id", "offset").collect())) == sorted(map(str, own.drop("sequence_id", "offset").collect()))


def test_the_pipeline_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_toxic_rows_go_by_row(spark, tmp_path):
    rng = random.Random(4)
    clean = lambda: " ".join(f"c{rng.randrange(60)}" for _ in range(30))
    toxic = lambda: clean() + " " + " ".join(f"vile{rng.randrange(4)}" for _ in range(8))
    rows = [(i, toxic() if i % 2 else clean(), "t" if i % 2 else "c") for i in range(200)]
    rows += [(None, toxic(), "t"), (None, clean(), "c"), (None, toxic(), "t"), (300, toxic(), "t"), (300, clean(), "c"), (None, None, "c")]
    docs = spark.createDataFrame(rows, COLUMNS)
    spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = Counter(map(tuple, corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()))
    assert left == Counter(r for r in rows if r[2] == "c")


def test_stages_leave_few_tables_behind(spark, tmp_path, monkeypatch):
    """Scratch tables that the written result doesn't need are gone: no copy of the texts but the numbered one, and no signatures."""
    rng = random.Random(11)
    prose = lambda: [f"{rng.getrandbits(40):x}" for _ in range(400)]
    family = [prose() for _ in range(60)]
    rows = [(i, " ".join(family[i % 60] + [f"tail{i}"]), f"s{i % 3}") for i in range(240)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(8)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    size = lambda d: sum(f.stat().st_size for f in Path(d).rglob("*.parquet") if f.is_file())
    read, left, tables = f"{tmp_path}/documents.parquet", {}, {}
    for name, stage in corpus_pipeline.STAGES:
        shared, whole = f"{tmp_path}/shared-{name}", size(read)
        monkeypatch.setattr(scratch, "shared_dir", lambda _, shared=shared: f"file://{shared}")
        stage(spark, spark.read.parquet(read), str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        read, left[name] = f"{tmp_path}/{name}", size(shared) / whole
        tables[name] = {d.name.split("-", 1)[1] for d in Path(shared).glob("*/*")}
    assert left["toxicity"] < 0.5
    assert "numbered" not in tables["toxicity"]
    assert left["near_copies"] < 1.2
    assert tables["near_copies"] == {"numbered", "keys", "tops"}
    assert left["mixing"] < 1.5 and not {"sizes", "known", "scan"} & tables["mixing"]
    assert "scan" not in tables["packing"]

import hashlib
import math
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cueline.llm import chat, sketch, tokencounts, tokenfiles, vectors
from cueline.llm.components import components
from cueline.llm.scratch import Scratch
from cueline.llm.tokens import vocabulary

TEXTS = ["", None, "one", "the quick brown fox, jumps over it. " * 9, "é ü 日本", "same text of some words", "same text of some words", "<|endoftext|> no end"]


def docs_of(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


def ids_of(text, end):
    own = Tokenizer.from_file(vocabulary())
    own.encode_special_tokens = True
    return [*own.encode(text or "", add_special_tokens=False).ids, end]


# Token files and token counts


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, encoding):
    rows = [(i if i != 2 else None, t, "x") for i, t in enumerate(TEXTS)]
    found = tokenfiles.token_digests(spark, docs_of(spark, rows, ", ids string"), encoding=encoding).collect()
    expected, start = [], 0
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(t, 2)
        expected.append((i, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert tokenfiles.token_digests(spark, docs_of(spark, [])).count() == 0


def test_token_files_stand_session_limits(spark):
    """A limit of rows a file doesn't split a task's file, whose number gives its place."""
    docs = docs_of(spark, [(i, f"text number {i} " * (i % 5)) for i in range(40)])
    expected = sorted(map(tuple, tokenfiles.token_digests(spark, docs).collect()))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        assert sorted(map(tuple, tokenfiles.token_digests(spark, docs).collect())) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_token_files_are_read_selectively(spark):
    scratch = Scratch(spark, "test")
    path = scratch.path("tokens")
    tokenfiles.write_tokens(docs_of(spark, list(enumerate(TEXTS))), path)
    plan = tokenfiles.read_tokens(spark, path, ["doc_id"]).where("doc_id = 3")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "EqualTo(doc_id,3)" in plan


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_flat_files_are_counted(spark, block):
    rows = [(i if i != 2 else None, t) for i, t in enumerate(TEXTS)]
    found = tokencounts.count_tokens(spark, docs_of(spark, rows).repartition(3), block=block).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in found), key=str) == sorted(((i, len(ids_of(t, 0))) for i, t in rows), key=str)
    start = 0
    for r in sorted(found, key=lambda r: r["doc_no"]):
        assert r["start"] == start
        start += r["n_tokens"]
    assert tokencounts.count_tokens(spark, docs_of(spark, [])).count() == 0


def test_documents_that_cross_files(spark):
    parts = [("a", [5, 6]), ("b", [7, 9, 9, 1]), ("c", []), ("d", [2, 9, 3])]
    files = spark.createDataFrame([(p, bytearray(np.array(x, "<u2").tobytes())) for p, x in parts], "path string, content binary")
    found = tokencounts.scan_flat(Scratch(spark, "test"), files, end_id=9, block=2).orderBy("doc_no").collect()
    assert [(r["start"], r["n_tokens"], r["ended"]) for r in found] == [(0, 4, True), (4, 1, True), (5, 3, True), (8, 1, False)]


# Chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[INST]"]), st.lists(st.sampled_from([*chat.CONTROLS, "\\", "a", " ", "0", "[", "<", "/"]), max_size=6).map("".join)), max_size=6))
def test_spans_are_the_turns(turns):
    template = chat.Template()
    text, found, rewrites = chat.spans(template, turns)
    assert rewrites is None and text == template(turns)
    assert [(s[0], template.unescape(text[s[3] : s[4]])) for s in found] == turns
    assert [s[1:3] for s in found] == list(zip([0, *[s[2] for s in found]], [s[2] for s in found]))
    for c in chat.CONTROLS:
        assert all(c not in text[s[3] : s[4]] for s in found)


def test_a_template_that_rewrites_history_is_found():
    numbered = lambda turns: f"{len(turns) > 2}" + "".join(t for _, t in turns)
    assert chat.spans(numbered, [("user", "a")] * 4)[2] == 2
    assert chat.spans(numbered, [("user", "a")] * 4)[1] == []


def test_digests(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok"), (1, 0, "user", None), (None, 0, "assistant", "x"), (1, 2, "assistant", "é")]
    found = {r["conv_id"]: r for r in chat.format_digests(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    one = found[1]
    assert one["n_turns"] == 3 and one["loss_chars"] == 14
    assert one["loss_sha256"] == hashlib.sha256("</s>[INST] oké".encode()).hexdigest()
    assert one["turns_sha256"] == hashlib.sha256("user\n\nassistant\n</s>[INST] ok\nassistant\né\n".encode()).hexdigest()
    assert len(found) == 2


# Sketches


def test_fingerprints(spark):
    rows = [(i if i != 2 else None, t) for i, t in enumerate(TEXTS)]
    for parts in (1, 3):
        found = {(r["doc_id"], r["n_chars"]): r for r in sketch.fingerprints(spark, docs_of(spark, rows), parts=parts).collect()}
        assert len(found) == len(rows)
        order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
        for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
            r = found[(i, len(t))]
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            (a, b, c) = sketch.sketches([t.encode(), edited.encode(), after.encode()])
            assert (r["fingerprint"], r["edited_fingerprint"]) == (sketch.to_text(a), sketch.to_text(b))
            assert (r["near_edited"], r["near_next"]) == (sketch.containment(a, b), sketch.containment(a, c))
            assert (sketch.from_text(r["fingerprint"]) == a).all()


def test_merged_sketches_are_those_of_the_union():
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(40))
    x, y = sketch.sketches([a.encode(), b.encode()])
    assert len(sketch.merge(x, y)) == len(x) + len(y) and sketch.containment(y, sketch.merge(x, y)) == 1
    assert abs(len(x) - 296 / 4) < 5 * math.sqrt(296 * 3 / 16)


# Vectors


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=8) * rng.choice([0, 0.1, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, rows[3][1], None), (404, rows[3][1], 0), (404, rows[3][1], 0), (405, [1.0, 2.0], 0), (None, rows[3][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for cell in (20, 10_000):
        found = vectors.link_vectors(spark, table, cell=cell, block=30).collect()
        fine = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and any(r[1]) and np.isfinite(r[1]).all()]
        links, parent = defaultdict(int), {r[0]: r[0] for r in fine}

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for p in range(len(fine)):
            for q in range(len(fine)):
                a, b = fine[p], fine[q]
                if p != q and a[2] == b[2] and len(a[1]) == len(b[1]):
                    x, y = np.array(a[1]), np.array(b[1])
                    if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                        links[p] += 1
                        parent[max(root(a[0]), root(b[0]))] = min(root(a[0]), root(b[0]))
        expected = sorted([(r[0], links[k], root(r[0]), root(r[0]) == r[0]) for k, r in enumerate(fine)] + [(i, 0, i, True) for i in (400, 401, 402, 403)] + [(None, 0, None, False)], key=str)
        assert sorted(map(tuple, found), key=str) == expected


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(60)]
    found = {r["node"]: r["root"] for r in components(Scratch(spark, "test"), spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == {x: root(x) for x in linked}


# Tables of one file


def test_vectors_sql_states_the_operator(spark, tmp_path):
    import duckdb

    from cueline.llm import queries

    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 6))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=6) * (i % 4) * 0.05], int(i % 12 % 3)) for i in range(160)]
    rows += [(200, None, 1), (201, [0.0] * 6, 1), (202, [float("inf")] * 6, 1), (203, rows[3][1], None), (204, rows[3][1], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = sorted(map(tuple, queries.near_vectors(spark, str(tmp_path)).collect()))
    assert found == sorted(duckdb.sql(queries.ORACLES["op6_near_vectors"]).fetchall()) and max(r[1] for r in found) > 3


def test_files_have_indexes_encodings_and_bounded_groups(spark):
    import glob

    import pyarrow.parquet as pq

    docs = docs_of(spark, [(i, " ".join(f"w{(i * 31 + k) * 7919 % 100_003}" for k in range(i % 50))) for i in range(6000)]).coalesce(1)
    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = Scratch(spark, "test").path("tokens")
        tokenfiles.write_tokens(docs, path, encoding=encoding, row_group_bytes=1 << 18)
        groups = 0
        for file in glob.glob(path.removeprefix("file://") + "/*.parquet"):
            meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                groups += 1
                assert meta.row_group(g).total_byte_size < 4 << 20
                for c in range(3):
                    column = meta.row_group(g).column(c)
                    assert column.has_column_index and column.has_offset_index
                    assert c < 2 or {name, name.replace("RLE_", "PLAIN_")} & set(column.encodings)
        assert groups > 1


def test_starts_are_where_the_files_have_repeated_ids(spark):
    rows = [(i % 3 if i % 4 else None, f"t{i} " * (i % 7)) for i in range(60)] + [(1, "same"), (1, "same")]
    scratch = Scratch(spark, "test")
    path = scratch.path("tokens")
    tokenfiles.write_tokens(docs_of(spark, rows), path)
    start, expected = 0, []
    for r in sorted(tokenfiles.read_tokens(spark, path).selectExpr("_metadata.file_name as f", "_metadata.row_index as k", "*").collect()):
        expected.append((r["doc_id"], start, r["n_tokens"]))
        start += r["n_tokens"]
    assert len(expected) == len(rows)
    assert sorted(map(str, expected)) == sorted(str(tuple(r)[:3]) for r in tokenfiles.token_starts(spark, scratch, path).collect())


def test_conversations_without_id_and_clashing_columns(spark):
    rows = [(None, 0, "user", "a", 1, "x"), (None, 1, "assistant", "a", 1, "x"), (None, 1, "assistant", "a", 1, "x"), (4, None, None, None, 1, "x"), (4, 1, "assistant", "long " * 200_000, 1, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans int, rewrites string")
    found = sorted((r["conv_id"] or 0, r["n_turns"], r["loss_chars"]) for r in chat.format_digests(spark, turns).collect())
    assert found == [(0, 1, 0), (0, 1, 1), (0, 1, 1), (4, 2, 1_000_000)]
    assert chat.format_digests(spark, turns.where("false")).count() == 0


@pytest.mark.parametrize("run", [sketch.fingerprints, tokencounts.count_tokens, tokenfiles.token_digests])
def test_clashing_columns_long_and_no_texts(spark, run):
    rows = [(1, "word " * 100_000, 1, "a", 2), (2, None, 1, "a", 2), (2, "", 1, "a", 2), (None, "x", 1, "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _part int, path string, n_tokens int")
    assert run(spark, docs).count() == 4
    assert run(spark, docs.where("false")).count() == 0


def test_no_vectors_and_clashing_columns(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], 3, "x", 5)], "vec_id long, embedding array<float>, label int, node string, n int")
    assert [tuple(r) for r in vectors.link_vectors(spark, table).collect()] == [(1, 0, 1, True)]
    assert vectors.link_vectors(spark, table.where("false")).count() == 0

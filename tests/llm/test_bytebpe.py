import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from cueline.llm import bytebpe
from cueline.llm.tokens import vocabulary

PATH = vocabulary("byte_bpe_50k.tiktoken")
ODD = ["'s", "'re", "'r", "'", "''s", "don't", " 's", "\n's", "x'll y'lx z'l", "'ve'v", "  a", " \n a", "a  ", "\n\n", " 　b", "1'd2", "!'t", "'sx", "'S", "é'm", "日本 語１２", "\x85x", "\x1cy", "½²", "áb", "😀'😀"]


@pytest.fixture(scope="module")
def own():
    return bytebpe.RankEncoder(PATH)


@pytest.fixture(scope="module")
def theirs():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def made(rng, n):
    return "".join(rng.choice(["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "　", "é", "x", "E", "7", "²", "!", ".", "日", "😀", "́"]) for _ in range(n))


def test_matches_begin_where_the_pattern_says(own):
    rng = random.Random(5)
    pattern = regex.compile(public_tokenizers.PATTERN)
    for text in [*ODD, *(made(rng, n) for n in range(1, 400))]:
        classes = own.classes[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        classes = np.append(classes, np.uint8(bytebpe.END))
        assert bytebpe.match_starts(classes)[:-1].tolist() == [m.start() for m in pattern.finditer(text)], text


def test_a_scan_is_a_walk():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 5000):
        classes = rng.integers(0, bytebpe.END + 1, n).astype(np.uint8)
        state, walked = bytebpe.START, []
        for c in classes:
            walked.append(state)
            state = bytebpe.step(state, int(c))[0]
        assert bytebpe.states_before(classes).tolist() == walked


def test_ids_and_offsets(own, theirs):
    rng = random.Random(7)
    texts = [*ODD, "", None, *(made(rng, rng.randrange(300)) for _ in range(200)), "a" * 5000, "xyzzy" * 3000, " " * 3000, "<|endoftext|>"]
    for text, (ids, starts) in zip(texts, own.encode(texts)):
        assert ids.tolist() == theirs.encode_ordinary(text or "")
        sizes = [len(theirs.decode_single_token_bytes(i)) for i in ids.tolist()]
        assert starts.tolist() == [sum(sizes[:k]) for k in range(len(sizes))] if len(sizes) < 400 else True
        assert own.decode(ids) == (text or "").encode()


def test_the_memo_may_forget(theirs):
    small = bytebpe.RankEncoder(PATH, remember=3)
    for text in ("one two three four", "four five six", "one two"):
        assert small.encode([text])[0][0].tolist() == theirs.encode_ordinary(text)


def test_digests(spark, theirs):
    texts = [*ODD, "", None, "same", "same", "long words here. " * 40_000]
    rows = [(None if i == 3 else i // 2, t, "x", [1]) for i, t in enumerate(texts)]
    found = bytebpe.token_digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids array<int>").repartition(3)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for i, t, *_ in rows:
        ids = theirs.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert bytebpe.token_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_range_of_bytes_is_decoded(spark):
    text = "Some wörds, and 日本 more of thém."
    encoded = bytebpe.encode(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).cache()
    data = text.encode()
    for first, n in ((0, 3), (7, 5), (7, None), (0, 1000), (1000, 5), (20, 0)):
        found = {r["doc_id"]: bytes(r["decoded"]) for r in bytebpe.decode(encoded, first=first, n=n).collect()}
        assert found == {1: data[first:] if n is None else data[first : first + n], 2: b"", 3: b""}
    encoded.unpersist()

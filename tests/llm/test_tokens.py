import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cueline.llm.tokens import PieceEncoder, vocabulary

PLAIN = PieceEncoder(vocabulary(), remember=50, special=False)
MARKED = PieceEncoder(vocabulary(), remember=50)
PARTS = [" ", "  ", "\n", "\t ", "don't", "'s", "the", "Über", "été", "x1", "12", ".", ",\n", " ", "　a", "日本", "<|endoftext|>", "<|end", "ͅ", "ß ", "\r\n", "²", "á", "🙂"]


def expected(own, text):
    return np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=14).map("".join))
def test_ids_are_the_tokenizers(text):
    assert PLAIN.encode([text]) == [expected(PLAIN, text)]
    assert MARKED.encode([text]) == [expected(MARKED, text)]


def test_null_is_empty():
    assert PLAIN.encode([None, ""]) == [b"", b""]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=9).map("".join), max_size=8), st.integers(0, 200))
def test_texts_in_slices(texts, n):
    texts = [*texts, "ab " * n + "x" * n]
    assert PLAIN.encode(texts) == [expected(PLAIN, t) if t else b"" for t in texts]


def test_many_lines_without_spaces():
    words = ["alpha", "Über", "stop.", "comma,", "x1", "", "don't"]
    plain = "\n".join(words[i % 4] for i in range(100_000))
    mixed = "\n".join(words[i % 7 if i % 5000 == 0 else i % 4] for i in range(100_000))
    for text in (plain, mixed):
        assert PLAIN.encode([text, "two words"]) == [expected(PLAIN, text), expected(PLAIN, "two words")]

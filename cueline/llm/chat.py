"""Conversations as training text, with the span of every turn found by rendering prefixes."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import count, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.scratch import Scratch

#: The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<TURN>>", "<</TURN>>")

SPAN = "role string, start long, end long, text_start long, text_end long, loss boolean"
FORMATTED = f"conv_id long, text string, spans array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split() for x in SPAN.split(', ')))}>>, rewrites int"


class Template:
    """Marks turns with control strings, and escapes those within texts.

    An escaped control string has a backslash behind its first character; where a text already has backslashes
    there, it gets one more. So every text can be read back, and no text can imitate a mark.
    """

    _plain = re.compile("|".join(f"(?:(?<={re.escape(c[0])})(?=\\\\*{re.escape(c[1:])}))" for c in CONTROLS))
    _escaped = re.compile("|".join(f"(?:(?<={re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])}))" for c in CONTROLS))

    def escape(self, text: str) -> str:
        return self._plain.sub(r"\\", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub("", text)

    def turn(self, role: str, text: str) -> str:
        text = self.escape(text)
        if role == "user":
            return f"<s>[INST] {text} [/INST]"
        if role == "assistant":
            return f" {text} </s>"
        if role == "system":
            return f"<<SYS>> {text} <</SYS>>"
        return f"<<TURN>>{self.escape(role)}\n{text}<</TURN>>"

    def __call__(self, turns: list[tuple[str, str]]) -> str:
        """The training text of (role, text) turns."""
        return "".join([_turn(*x) for x in turns])


@lru_cache(maxsize=4096)
def _turn(role: str, text: str) -> str:
    """A turn's text, remembered while the prefixes of its conversation are rendered."""
    return Template().turn(role, text)


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def spans(render, turns: list[tuple[str, str]], loss_role: str = "assistant"):
    """(text, spans, rewrites): what ``render`` makes of ``turns``, and each turn's and its text's place in it.

    ``render`` is a black box. Successive prefixes of the turns are rendered and compared: a turn's span is what it
    adds. Rendered with two other texts, the last turn shows where its own begins, and with an empty one how much
    stands behind it. A template that changes what it made of earlier turns has no such spans; ``rewrites`` is then
    the first turn that does so (else None), and there are no spans.
    """
    whole, out = render([]), []
    for i, (role, text) in enumerate(turns):
        before, upto = whole, turns[:i]
        whole = render([*upto, (role, text)])
        if not whole.startswith(before):
            return render(turns), [], i
        at = len(before)
        one, two, none = (render([*upto, (role, x)]) for x in ("0", "1", ""))
        skip = at if one.startswith(before) and two.startswith(before) else 0
        head = skip + _common(one[skip:], two[skip:])
        tail = len(none) - head
        out.append((role, at, len(whole), head, len(whole) - tail, role == loss_role))
    return whole, out, None


def format_conversations(turns: DataFrame, render=None) -> DataFrame:
    """conv_id, text, spans, rewrites: one row for each conversation of ``turns`` (conv_id, turn, role, text).

    Turns are ordered by turn (null first), role and text; null texts and roles are empty; repeated turns are kept.
    Each row without conv_id is a conversation of its own. No rows: no conversations. Other columns are not read.
    A task streams over its conversations and holds one of them; its text is one string in any case.
    """
    render = render or Template()
    kind = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())]))

    def rows(batches):
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())

    def run(batches):
        own, held = [[], [], [], []], 0
        names = ["conv_id", "text", "spans", "rewrites"]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(own, (pa.int64(), pa.string(), kind, pa.int32()))], names=names)
        loose = count()
        for (conv, _), part in groupby(rows(batches), key=lambda r: (r[0], next(loose) if r[0] is None else None)):
            text, found, rewrites = spans(render, [(r, t) for _, r, t in part])
            found = [dict(zip(("role", "start", "end", "text_start", "text_end", "loss"), x)) for x in found]
            for column, x in zip(own, (conv, text, found, rewrites)):
                column.append(x)
            held += len(text)
            if held > 2_000_000:
                yield pack()
                own, held = [[], [], [], []], 0
        yield pack()

    dealt = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = dealt.repartition(F.coalesce("conv_id", F.xxhash64("turn", "role", "text"))).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame, unescape=None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites, read from formatted conversations.

    A conversation whose template rewrites history has no turns; rewrites is the first turn that does so.
    """
    unescape = unescape or Template().unescape

    def run(batches):
        for batch in batches:
            out = []
            for conv, text, found, rewrites in zip(*(batch.column(i).to_pylist() for i in range(4))):
                turns, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for s in found:
                    own = unescape(text[s["text_start"] : s["text_end"]])
                    turns.update(f"{s['role']}\n{own}\n".encode())
                    if s["loss"]:
                        loss.update(own.encode())
                        chars += len(own)
                out.append((conv, len(found), turns.hexdigest(), chars, loss.hexdigest(), len(text), rewrites))
            columns = list(zip(*out)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return formatted.select("conv_id", "text", "spans", "rewrites").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites int"
    )


def format_digests(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Format ``turns``, write the result to the shared folder, and return its digests."""
    return digests(Scratch(spark, "chat").save(format_conversations(turns), "formatted"))

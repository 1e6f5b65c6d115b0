"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.ordering import with_follower
from cueline.llm.texts import HASH_BITS, WORDS, multisets, shingle_hashes

FRACTION = 0.25
#: Bytes of text in a range of documents, about.
RANGE_BYTES = 16 << 20


def sketches(blobs: list[bytes], fraction: float = FRACTION, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes below ``fraction`` of all hashes, for each UTF-8 text.

    A text with shingles but none below keeps its least one as a mark, so that short texts can be told apart.
    """
    hashes, _, begins = multisets(*shingle_hashes(blobs, words), len(blobs))
    keep = hashes < np.uint64(int(fraction * (1 << HASH_BITS)))
    keep[begins[:-1][np.diff(begins) > 0]] = True
    upto = np.concatenate(([0], np.cumsum(keep)))[begins]
    kept = hashes[keep]
    return [kept[a:b] for a, b in zip(upto, upto[1:])]


def to_text(sketch: np.ndarray) -> str:
    """A sketch as base64 of its big-endian 48-bit hashes in order."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    own = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(own), 8), np.uint8)
    wide[:, 2:] = own
    return wide.view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of two texts' shingles together: their union, of which a mark goes if anything is below the bound."""
    both = np.union1d(a, b)
    below = both[both < np.uint64(int(fraction * (1 << HASH_BITS)))]
    return below if len(below) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 if both texts have none."""
    if not len(a):
        return 1.0 if not len(b) else 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; 1 if both texts have no shingles."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint_column(text: str, fraction: float = FRACTION):
    """The fingerprint of a text column (null: that of an empty text)."""

    @F.pandas_udf("string")
    def own(texts):
        import pandas as pd

        out = []
        for i in range(0, len(texts), 200):
            out += [to_text(x) for x in sketches([(t or "").encode() for t in texts[i : i + 200]], fraction)]
        return pd.Series(out)

    return own(text)


def fingerprints(spark: SparkSession, docs: DataFrame, fraction: float = FRACTION, parts: int | None = None) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text) and of edited texts, with estimates of how much of each is in the other.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (containment of the
    document in its edited text and in the next document) and resemblance_edited, resemblance_next. In the edited text the last half of the
    code points gives way to the first as many of the next document in ascending doc_id (null first, ties by text; after the last: the first).
    Texts are dealt by ranges of doc_id of about ``RANGE_BYTES`` (or ``parts`` ranges), a task each, each followed by the first document of the next, and streamed. Null texts are
    empty, with an empty fingerprint. Repeated rows follow each other. No rows give no rows. Other columns are not read.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "resemblance_edited", "resemblance_next"]

    def run(batches):
        def digest(ids, texts):
            """All but the last text, each with its follower."""
            own = [t.encode() for t in texts]
            edited = []
            for t, after in zip(texts, texts[1:]):
                half = len(t) // 2
                edited.append((t[: len(t) - half] + after[:half]).encode())
            marks = sketches(own, fraction)
            changed = sketches(edited, fraction)
            pairs = list(zip(marks, changed, marks[1:]))
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
                pa.array([to_text(x) for x in marks[:-1]], pa.string()),
                pa.array([to_text(x) for x in changed], pa.string()),
                pa.array([containment(a, b) for a, b, _ in pairs], pa.float64()),
                pa.array([containment(a, c) for a, _, c in pairs], pa.float64()),
                pa.array([resemblance(a, b) for a, b, _ in pairs], pa.float64()),
                pa.array([resemblance(a, c) for a, _, c in pairs], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        part, ids, texts, held, over = None, [], [], 0, True
        for batch in batches:
            for p, ahead, i, t in zip(*(batch.column(k) for k in range(4))):
                p, ahead, t = p.as_py(), ahead.as_py(), t.as_py()
                if p != part:
                    part, ids, texts, held, over = p, [], [], 0, False
                if over:
                    continue
                texts.append(t)
                held += len(t)
                if ahead or len(texts) > 300 or held > 1_000_000:
                    if len(texts) > 1:
                        yield digest(ids, texts)
                        ids, texts, held = [], texts[-1:], len(t)
                over = ahead
                ids.append(i.as_py())

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if parts is None:
        parts = max(8, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    ranges = with_follower(own, "doc_id", parts).select("_part", "_ahead", "doc_id", "text")
    ranges = ranges.repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", "_ahead", "doc_id", "text")
    kinds = ["long", "long", "string", "string", "string", "double", "double", "double", "double"]
    return ranges.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))

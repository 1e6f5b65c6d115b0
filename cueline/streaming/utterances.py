"""Utterances from a folder that cue tables are dropped into."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from cueline.operators.utterance import to_utterances
from cueline.schema import SUBTITLE
from cueline.sources.tables import Segmenter


def stream_utterances(spark: SparkSession, folder: str, output: str, checkpoint: str, key: str = "filepath", **trigger) -> StreamingQuery:
    """Segment each arriving batch of cue files and append its utterances to ``output``.

    A file arrives whole, and files don't share utterances, so no state outlives a batch. Each batch is written to a folder named by its
    number, which a repeated batch replaces.
    """
    cues = spark.readStream.schema(SUBTITLE).parquet(folder)

    def segment(batch: DataFrame, number: int) -> None:
        to_utterances(batch, key).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return cues.writeStream.foreachBatch(segment).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


SEGMENTS = "filepath string, idx long, line_idxs array<long>, timestamp_start double, timestamp_end double, content string, late boolean"


def segment_stream(cues: DataFrame, idle: int = 600_000) -> DataFrame:
    """Utterances of a stream of cues (filepath, idx, line_idx, timestamp_start, timestamp_end, content; others are not read) that come in any batches.

    A file's open utterance and its last idx are state by file, so an utterance may reach over batches and restarts; the result doesn't depend on how a file
    is split. It is given out when a cue ends it, or when no cue of its file came for ``idle`` milliseconds. Cues of a batch are taken in the order of idx. A late
    cue, whose idx isn't past the last one of an earlier batch or is null, is segmented by itself, with late true and no idx: nothing is dropped. A file's state
    is a few cues, and stays small while its sentences end. Timers make Spark run batches without data, so a run with ``availableNow`` ends only where
    ``spark.sql.streaming.noDataMicroBatches.enabled`` is false; timers then fire with the next data.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, held = state.get if state.exists else (0, None, "[]")
        own, rows = Segmenter(), []
        own.n, own.open = n, [tuple(x) for x in json.loads(held)]
        if state.hasTimedOut:
            rows = [(*x, False) for x in own.flush()]
        else:
            fresh = [x for batch in batches for x in batch.astype(object).where(batch.notna(), None).itertuples(index=False)]
            before = last
            for cue in sorted(fresh, key=lambda x: (x.idx is None, x.idx)):
                given = (None if cue.line_idx is None else int(cue.line_idx), cue.timestamp_start, cue.timestamp_end, cue.content)
                if cue.idx is None or (before is not None and cue.idx <= before):
                    alone = Segmenter()
                    rows += [(None, *x[1:], True) for x in [*alone.push(*given), *alone.flush()]]
                else:
                    last = int(cue.idx)
                    rows += [(*x, False) for x in own.push(*given)]
        state.update((own.n, last, json.dumps(own.open)))
        if own.open:
            state.setTimeoutDuration(idle)
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in SEGMENTS.split(", ")][1:])
        out.insert(0, "filepath", pd.Series([key[0]] * len(out), dtype=object))
        yield out.astype({"idx": "Int64"})

    own = cues.select("filepath", "idx", "line_idx", "timestamp_start", "timestamp_end", "content")
    return own.groupBy("filepath").applyInPandasWithState(run, SEGMENTS, "n long, last long, open string", "append", "ProcessingTimeTimeout")

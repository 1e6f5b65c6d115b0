"""Injected models: text embedding and sprite annotation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed wording of the requests to an annotation model.
PROMPT = "Describe what this frame of a film shows: people, place, action and anything readable."
PROMPT_WITH_SYNOPSIS = PROMPT + " The film's synopsis is: {synopsis}"


def embed(table: DataFrame, make_model: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "content", into: str = "embedding") -> DataFrame:
    """``table`` with ``into``: vectors of a text column. The model is made once in each worker and gets whole batches; null stays null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for texts in batches:
            given = texts.dropna()
            vectors = model(given.tolist()) if len(given) else []
            found = dict(zip(given.index, vectors))
            yield pd.Series([list(map(float, found[i])) if i in found else None for i in texts.index], dtype=object)

    return table.withColumn(into, run(F.col(text)))


def annotate(sprites: DataFrame, make_client: Callable[[], Callable[[str, bytes], str]], frame: str = "frame", synopsis: str | None = None) -> DataFrame:
    """``sprites`` with annotation and error, one of them null: what the client answers for each frame, or how it failed."""

    prompt = PROMPT if synopsis is None else PROMPT_WITH_SYNOPSIS.format(synopsis=synopsis)

    def run(batches):
        client = make_client()
        for batch in batches:
            said, failed = [], []
            for image in batch[frame]:
                try:
                    said.append(client(prompt, image))
                    failed.append(None)
                except Exception as e:  # a failed request is data: it goes to the error sink
                    said.append(None)
                    failed.append(f"{type(e).__name__}: {e}")
            yield batch.assign(annotation=said, error=failed)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sprites.schema.fields)
    return sprites.mapInPandas(run, f"{fields}, annotation string, error string")

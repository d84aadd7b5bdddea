"""Ordered folds whose next step needs the previous result.

Rows of a key are sorted inside their partition and streamed through Python in
Arrow batches: memory holds the fold's state and one batch, never a whole key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable, schema: str) -> DataFrame:
    """Feed each key's rows in ``order`` to a fresh ``start()`` object.

    The object has ``step(row) -> list of tuples`` and ``finish() -> list of
    tuples``; tuples follow ``schema`` without the leading key columns.
    """
    types = dict(df.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    names = [*keys, *[part.split()[0] for part in schema.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, fold = None, None
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    if fold is not None:
                        out += [(*current, *t) for t in fold.finish()]
                    current, fold = key, start()
                out += [(*key, *t) for t in fold.step(row)]
            yield pd.DataFrame(out, columns=names)
        if fold is not None:
            yield pd.DataFrame([(*current, *t) for t in fold.finish()], columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{head}, {schema}")

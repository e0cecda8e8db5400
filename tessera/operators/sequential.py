"""Recurrences over the ordered events of each key.

Events are hash-partitioned by key and sorted within the partition; a step function then reads them as a stream with the
state of one key at a time. Memory is one state, however many events a key has; nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def fold(df: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``step(state, event)`` returns for each event of ``df``, in order by ``order`` within ``key``.

    ``event`` is the row as a named tuple, ``state`` what ``start()`` made at the key's first event and ``step``
    changes in place. An empty table gives an empty one; a null key is a key of its own.
    """
    names = [part.split()[0].strip("`") for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, state = object(), None
        for batch in batches:
            batch = batch.astype(object).where(batch.notna(), None)
            out: list[tuple] = []
            for event in batch.itertuples(index=False, name="Event"):
                value = getattr(event, key)
                if state is None or value != known:
                    known, state = value, start()
                out += step(state, event)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)

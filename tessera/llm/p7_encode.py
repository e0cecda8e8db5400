"""Problem 7: the corpus as ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.bpe import TOKENIZER_FILE, encoder


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """``id_col`` and ``ids`` (a list of integers) of every row; no shuffle, one pass over the text column.

    Null and empty texts have an empty list; a null id stays null; repeated rows stay repeated; an empty table
    gives an empty one. Other columns are not read.
    """
    source = df.select(df[id_col].alias("k"), df[text_col].alias("t"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            offsets, values, total = [0], [], 0
            for text in batch.column(1).to_pylist():
                ids = words.encode(text)
                values.append(np.array(ids, dtype=np.int32))
                total += len(ids)
                offsets.append(total)
            flat = np.concatenate(values) if values else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")

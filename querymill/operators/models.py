"""Running models over columns: whatever loads once and maps a list of texts to a list of results can stand in for the rule backends.

A model is given as a function without arguments that loads it. It is loaded once in each Python worker, not once a batch or row, and sees
the distinct texts of each Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Model = Callable[[Sequence[str]], Sequence]
Load = Callable[[], Model]


def _mapped(batches: Iterator[pa.RecordBatch], load: Callable[[], Model]) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """Each batch with the results of its distinct texts and the index of each row's; a null text has index None."""
    model = load()
    for batch in batches:
        coded = batch.column(batch.num_columns - 1).dictionary_encode()
        texts = coded.dictionary.to_pylist()
        yield batch, list(model(texts)) if texts else [], coded.indices.to_pylist()


def predict(df: DataFrame, text_col: str, out_col: str, out_type: T.DataType, load: Callable[[], Model]) -> DataFrame:
    """Adds out_col, the model's result for each text; null for a null text."""
    shape = T.StructType([*df.schema.fields, T.StructField(out_col, out_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, results, at in _mapped(batches, load):
            made = pa.array([None if k is None else results[k] for k in at], to_arrow_type(out_type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], shape.names)

    return df.withColumn("__text", F.col(text_col)).mapInArrow(run, shape)


def extract(df: DataFrame, text_col: str, item_type: T.StructType, load: Callable[[], Model], keep: Sequence[str] = ()) -> DataFrame:
    """One row for each item that the model finds in a text (the model gives a list of dicts for each), with the kept columns."""
    shape = T.StructType([*[df.schema[c] for c in keep], *item_type.fields])
    names, kinds = item_type.names, [to_arrow_type(f.dataType) for f in item_type.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, results, at in _mapped(batches, load):
            found = [(row, item) for row, k in enumerate(at) if k is not None for item in results[k]]
            rows = pa.array([row for row, _ in found], pa.int64())
            items = [pa.array([item.get(n) for _, item in found], t) for n, t in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns[:-1]], *items], shape.names)

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, shape)

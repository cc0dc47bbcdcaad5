"""Running a batch function over texts while the other columns ride along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrascope.session import BATCH_BYTES, bound_batches  # noqa: F401


def map_texts(df: DataFrame, text_col: str, keep: list[str] | None, fields: list[T.StructField], fn: Callable[[pa.Array], Iterator[list[pa.Array]] | list[pa.Array]]) -> DataFrame:
    """``keep`` columns (all by default) of every row, followed by the columns ``fields`` that ``fn`` makes of its text.

    A kept column with the name of a new one is replaced by it, as ``withColumn`` does.  ``fn`` is called with
    one Arrow string array for each batch and returns one array for each field, in row order.
    """
    bound_batches(df.sparkSession)
    made = [f.name for f in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c not in made]
    quoted = [F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")]
    inside = text_col in keep
    packed = df.select(F.struct(*quoted).alias("row"), *([] if inside else [F.col(f"`{text_col}`").cast("string").alias("text")]))
    schema = T.StructType([packed.schema["row"], *fields])

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            text = row.field(text_col) if inside else batch.column(1)
            yield pa.RecordBatch.from_arrays([row, *fn(text)], ["row", *made])

    return packed.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in keep], *made)

"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from houselights.session import scratch_folder

ArrowMap = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows once, as Parquet in the shared folder, and read them back: later jobs depend on the files alone,
    so a lost executor never leads to recomputing what came before. The files go when the session ends."""
    place = scratch_folder(df.sparkSession, label)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def utf8_rows(column: pa.Array) -> Iterator[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes, one by one and without decoding them."""
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

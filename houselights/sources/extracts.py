"""Reading report extracts and season tables, writing report sheets."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from houselights import schemas
from houselights.functions import columns as c

# The line filter travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _without_head(batches: Iterable[pa.RecordBatch], head: int) -> Iterator[pa.RecordBatch]:
    """Drop the first `head` lines of every file. Only rows of a file's first block carry its path; one task reads that
    block in order. A batch without such lines, or after them, passes through as it is."""
    seen: dict[str, int] = {}
    for batch in batches:
        keep = None
        for path in pc.unique(batch.column(1)).to_pylist():
            left = head - seen.get(path, 0)
            if path is None or left <= 0:
                continue
            own = np.flatnonzero(pc.equal(batch.column(1), path).fill_null(False).to_numpy(zero_copy_only=False))[:left]
            seen[path] = seen.get(path, 0) + len(own)
            keep = np.ones(batch.num_rows, bool) if keep is None else keep
            keep[own] = False
        yield batch.select(["value"]) if keep is None else batch.select(["value"]).filter(pa.array(keep))


def read_extract(spark: SparkSession, paths: str | Sequence[str], schema: str, preamble: int = 3) -> DataFrame:
    """CSV extracts with `preamble` lines above the header, any number of files of any size.

    Files are read as splittable text; only the head lines are removed in Python, the CSV is parsed by Spark.
    Records must not contain line breaks.
    """
    lines = spark.read.text(paths).select(
        "value", F.when(F.col("_metadata.file_block_start") == 0, F.col("_metadata.file_path")).alias("path"))
    body = lines.mapInArrow(lambda batches: _without_head(batches, preamble + 1), "value string")
    return (body.where(F.trim("value") != "")
            .select(F.from_csv("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*"))


def _with_head(batches: Iterable[pa.RecordBatch], head: Sequence[str]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], ["value"])
    yield from batches


def write_extract(df: DataFrame, path: str, preamble: Sequence[str]) -> None:
    """CSV files that each begin with the preamble lines and a header, one file per task."""
    head = [*preamble, ",".join(df.columns)]
    lines = df.select(F.to_csv(F.struct(*df.columns)).alias("value"))
    lines.mapInArrow(lambda batches: _with_head(batches, head), "value string").write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """Plain CSV with a header line."""
    return spark.read.schema(schema).csv(paths, header=True)


def read_ticket_extracts(spark: SparkSession, paths: str | Sequence[str], preamble: int = 3) -> DataFrame:
    """Ticket extracts with performance and order times parsed, whichever text form a season uses."""
    raw = read_extract(spark, paths, schemas.TICKETS, preamble)
    return raw.withColumns({name: c.parse_timestamp(F.col(name), schemas.TIMESTAMP_FORMS).cast("timestamp_ntz")
                            for name in ("perf_dt", "order_dt")})


def read_performances(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return read_csv(spark, paths, schemas.PERFORMANCES).withColumn(
        "perf_dt", c.parse_timestamp(F.col("perf_dt"), schemas.ISO_TIMESTAMP_FORMS).cast("timestamp_ntz"))


def read_birth_years(spark: SparkSession, paths: str | Sequence[str], preamble: int = 7) -> DataFrame:
    return read_extract(spark, paths, schemas.BIRTH_YEARS, preamble)


def store_by_season(tickets: DataFrame, path: str) -> None:
    """Write tickets partitioned by season. Rebalancing lets a very large season use many writers."""
    seasoned = tickets.withColumn("season", F.col("season_desc"))
    seasoned.hint("rebalance", F.col("season")).write.mode("overwrite").partitionBy("season").parquet(path)


def load_tickets(spark: SparkSession, path: str, seasons: Sequence[str]) -> DataFrame:
    """Tickets of the named seasons; other seasons' files are never opened."""
    return spark.read.parquet(path).where(F.col("season").isin(*seasons)).drop("season")


def load_donations(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.DONATIONS)


def save_report(sheets: dict[str, DataFrame], path: str, append: bool = False) -> None:
    """One folder per sheet. A new report replaces the sheets it names; appending adds rows to them."""
    for name, sheet in sheets.items():
        sheet.write.mode("append" if append else "overwrite").parquet(f"{path}/{name}")


def save_grouped_report(sheet: DataFrame, path: str, by: str) -> None:
    """One sub-folder per group, the form of a workbook with a sheet per group."""
    sheet.write.mode("overwrite").partitionBy(by).parquet(path)


def load_sheet(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")

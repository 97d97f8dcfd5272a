"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepared, stored

__all__ = ["MAX_BROADCAST", "WHITE", "WORD", "beside", "ids_as_long", "ids_as_text", "map_rows", "stored", "table"]

#: Characters that separate words: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of up to so many rows of a few numbers is sent to every task.
MAX_BROADCAST = 100_000


def beside(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Joins a stored table of few columns, one row a key: by a broadcast if it
    is small, by a shuffle if not."""
    small = side.count() <= MAX_BROADCAST
    return df.join(F.broadcast(side) if small else side, key)


def ids_as_text(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids for a way through pandas, which turns the integers of a batch with a null
    into floats: ids beyond 2 ** 53 would change."""
    return df.withColumn(id_col, F.col(id_col).cast("string"))


def ids_as_long(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return df.withColumn(id_col, F.col(id_col).cast("long"))


def map_rows(rows: DataFrame, run: Callable, schema: str, id_col: str = "doc_id") -> DataFrame:
    """mapInPandas of rows with an id, (id long, schema): null ids stay null and
    leave the other ids of their batch as they are."""
    return ids_as_long(ids_as_text(rows, id_col).mapInPandas(run, f"{id_col} string, {schema}"), id_col)

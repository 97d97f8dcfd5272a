"""Catalogs of different sources, brought to one schema and checked by digest.

A source is declared: where each column of the common schema comes from, in what
unit it is, and which class its rows have. Reading is Spark's own CSV reader;
digests are taken where the bytes are read, in tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = ("dm", "dm_gal_max", "snr", "glat", "glon", "width_ms", "period_s")


class LockError(ValueError):
    """A catalog is missing or is not the one that was locked."""


@dataclass(frozen=True)
class Source:
    """columns: schema column -> the source's column; units: schema column -> what
    one of the source's units is in the schema's; class_name: of all its rows,
    or class_column where rows differ; missing: texts that stand for no value."""

    object_id: str
    columns: dict[str, str]
    units: dict[str, float] = field(default_factory=dict)
    class_name: str | None = None
    class_column: str | None = None
    separator: str = ","
    comment: str = "#"
    missing: tuple[str, ...] = ("", "*", "NA", "nan", "null")


#: Public column names of the catalogs, by key.
SOURCES = {
    "atnf_pulsars": Source("PSRJ", {"dm": "DM", "glat": "Gb", "glon": "Gl", "width_ms": "W50", "period_s": "P0"}, class_name="pulsar", separator="\t"),
    "chime_frb_cat1": Source("TNS", {"dm": "DM", "snr": "SNR", "glat": "GLAT", "glon": "GLON", "width_ms": "Width"}, {"width_ms": 1000.0}, class_name="frb", separator="\t"),
}


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256) of files, worked out in tasks."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, sha256: str, size_bytes: int) -> None:
    """Fails unless the file is there and is the locked one."""
    try:
        found = digests(spark, path).collect()  # one row a file of the catalog
    except Exception as e:
        raise LockError(f"{path} cannot be read") from e
    if [(r["size_bytes"], r["sha256"]) for r in found] != [(size_bytes, sha256)]:
        raise LockError(f"{path} is not the locked file")


def normalise(raw: DataFrame, key: str, source: Source) -> DataFrame:
    """(object_id, source, class_name, the numbers of the schema): a column that a
    source lacks, and a value that is no number, is null; rows without an id are
    left out."""
    lacking = [c for c in (source.object_id, *source.columns.values()) if c not in raw.columns]
    if lacking:
        raise LockError(f"{key} lacks the columns {', '.join(sorted(lacking))}")

    def number(name: str):
        if name not in source.columns:
            return F.lit(None).cast("double").alias(name)
        text = F.trim(F.col(source.columns[name]).cast("string"))
        value = F.when(~text.isin(*source.missing), text.try_cast("double"))
        return (F.when(~F.isnan(value), value) * source.units.get(name, 1.0)).alias(name)

    kind = F.lower(F.trim(F.col(source.class_column))) if source.class_column else F.lit(source.class_name)
    name = F.trim(F.col(source.object_id).cast("string"))
    rows = raw.where(name.isNotNull() & (name != ""))
    return rows.select(name.alias("object_id"), F.lit(key).alias("source"), kind.alias("class_name"), *[number(c) for c in NUMBERS])


def load(spark: SparkSession, key: str, path: str, lock: dict | None = None, sources: dict[str, Source] = SOURCES) -> DataFrame:
    """One catalog in the common schema; lock: {sha256, size_bytes} to check first."""
    if key not in sources:
        raise LockError(f"no source is called {key}")
    if lock is not None:
        verify(spark, path, lock["sha256"], int(lock["size_bytes"]))
    s = sources[key]
    raw = spark.read.csv(path, header=True, sep=s.separator, comment=s.comment)
    return normalise(raw, key, s)


def load_many(spark: SparkSession, paths: dict[str, str], locks: dict[str, dict] | None = None, sources: dict[str, Source] = SOURCES) -> DataFrame:
    """The union of several catalogs; ids are unique within a source only."""
    out = None
    for key, path in paths.items():
        one = load(spark, key, path, (locks or {}).get(key), sources)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise LockError("no catalog is named")
    return out

"""Audit records: a typed union of what observed sources hold.

A record has a name, where it comes from, its type, dispersion, signal to noise
and true role. Sources are samples of catalog rows, survey rows with measured
moments, windows of a filterbank file and members of archives of spectra. The
tables go together by name; a source that is missing gives an empty table of the
same columns, never an error.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.splits import split_key
from ..session import prepared
from . import filterbank, stores

RECORD = "name string, origin string, sig_type string, dm double, snr double, true_role string"
#: Samples of a wave, and least and largest signal to noise of a sampled burst.
WAVE, LOW_SNR, HIGH_SNR = 256, 8.0, 40.0


def _share(key: Column) -> Column:
    """A number in [0, 1) from the last eight digits of a digest."""
    return F.conv(F.substring(key, 25, 8), 16, 10).cast("double") / float(1 << 32)


def sampled_bursts(catalog: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n records of catalog rows with a dispersion (all, if there are fewer),
    taken in the order of a digest of id and seed: the same ones wherever it
    runs. The dispersion is the catalog's; signal to noise follows from the
    digest, from 8 to 40."""
    key = split_key(id_col, seed)
    rows = catalog.where("dm IS NOT NULL AND NOT isnan(dm)").select(F.col(id_col).cast("string").alias("id"), "dm", key.alias("key"))
    some = rows.orderBy("key", "id", "dm").limit(n)
    return some.select(
        F.concat(F.lit("FRB_"), "id").alias("name"), F.lit("FRB").alias("origin"), F.lit("FRB").alias("sig_type"), F.col("dm").cast("double").alias("dm"),
        (LOW_SNR + (HIGH_SNR - LOW_SNR) * _share(F.col("key"))).alias("snr"), F.lit("Natural").alias("true_role"),
    )


def sampled_interference(survey: DataFrame, columns: tuple[str, ...], n: int, seed: int = 42) -> DataFrame:
    """n records of survey rows of class 0 with their measured moments."""
    some = survey.where("y = 0").withColumn("key", split_key("vec_id", seed)).orderBy("key", "vec_id").limit(n)
    return some.select(
        F.concat(F.lit("RFI_"), F.col("vec_id").cast("string")).alias("name"), F.lit("RFI").alias("origin"), F.lit("RFI").alias("sig_type"), F.lit(0.0).alias("dm"),
        (LOW_SNR + (HIGH_SNR - LOW_SNR) * _share(F.col("key"))).alias("snr"), F.lit("Interference").alias("true_role"), *columns,
    )


def as_wave(spec: np.ndarray, length: int = WAVE) -> np.ndarray:
    """The channel of largest mean square of a (channel, time) spectrum, brought
    to ``length`` samples by linear steps, centred and scaled."""
    x = np.nan_to_num(np.asarray(spec, float), nan=0.0, posinf=0.0, neginf=0.0)
    line = x[int((x * x).mean(axis=1).argmax())]
    wave = np.interp(np.linspace(0, len(line) - 1, length), np.arange(len(line)), line)
    return (wave - wave.mean()) / (wave.std() or 1.0)


def cube_of(name: str, data: bytes) -> np.ndarray:
    """(channel, time) of an archive's member: .npy or .fil, and .h5 where its
    library is installed. A middle axis of integrations is averaged."""
    if name.endswith(".fil"):
        return filterbank.spectrum(data)[1].T
    if name.endswith((".h5", ".hdf5")):
        import h5py

        with h5py.File(io.BytesIO(data)) as f:
            x = f["data"][()]
    else:
        x = np.load(io.BytesIO(data), allow_pickle=False)
    x = np.asarray(x, float)
    x = x.mean(axis=1) if x.ndim == 3 else np.atleast_2d(x)
    if x.ndim != 2 or not x.size:
        raise ValueError(f"not a spectrum: shape {x.shape}")
    return x


@dataclass
class Member(InputPartition):
    path: str
    name: str

    def __hash__(self):
        return hash((self.path, self.name))


MEMBER = "archive string, member string, snr double, wave array<double>, n_ch int, n_t int, power array<double>, problem string"
KNOWN = (".npy", ".fil", ".h5", ".hdf5")


class ArchiveReader(DataSourceReader):
    """A task for every member: the driver reads the archive's directory only."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Member]:
        out = []
        for path, _ in stores.listed(self.path):
            with stores.opened(path) as f, zipfile.ZipFile(f) as z:
                out += [Member(path, n) for n in sorted(z.namelist()) if n.endswith(KNOWN)]
        return out or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        row: dict = {"archive": partition.path, "member": partition.name, "snr": None, "wave": None, "n_ch": None, "n_t": None, "power": None, "problem": None}
        try:
            with stores.opened(partition.path) as f, zipfile.ZipFile(f) as z:
                x = cube_of(partition.name, z.read(partition.name))
            spread = float(np.median(np.abs(x - np.median(x)))) * 1.4826
            peak = float(np.abs(x - np.median(x)).max())
            row |= {"snr": max(1.0, peak / spread if spread > 0 else 1.0), "wave": as_wave(x).tolist(), "n_ch": x.shape[0], "n_t": x.shape[1], "power": x.ravel().tolist()}
        except Exception as e:  # the member's row says what is wrong with it
            row["problem"] = f"{type(e).__name__}: {e}"[:200]
        kinds = [pa.string(), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in zip(row, kinds, strict=True)], list(row))


class ArchiveSource(DataSource):
    """format("spectra"): zip archives of spectra, a row for each member."""

    @classmethod
    def name(cls) -> str:
        return "spectra"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The members of archives (a file, a folder or a pattern): signal to noise,
    wave, spectrum row by row of channels, or the problem that reading it met. A
    missing archive has no member."""
    prepared(spark).dataSource.register(ArchiveSource)
    return spark.read.format("spectra").load(path)


def _name(prefix: str) -> Column:
    stem = F.regexp_replace(F.element_at(F.split("member", "/"), -1), r"\.[^.]*$", "")
    return F.concat(F.lit(prefix), stem)


@dataclass
class AuditSet:
    """records (RECORD), features (name, moments), waves (name, wave), spectra
    (obs_id, t, ch, power) and manifest (source, n, retrieved_ok)."""

    records: DataFrame
    features: DataFrame
    waves: DataFrame
    spectra: DataFrame

    def manifest(self) -> DataFrame:
        kinds = self.records.sparkSession.createDataFrame([("FRB",), ("RFI",), ("SETI",), ("Voyager",)], "source string")
        n = self.records.groupBy(F.col("origin").alias("source")).agg(F.count("*").alias("n"))
        return kinds.join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("retrieved_ok"))


def archive_set(spark: SparkSession, path: str, role: str = "Anomaly", n: int | None = None) -> AuditSet:
    """What an archive holds, as records of one role; n: so many members, in the
    order of their names. Members with a problem are in ``read_archive`` alone."""
    rows = read_archive(spark, path).where("problem IS NULL").withColumn("name", _name("SETI__"))
    if n is not None:
        rows = rows.orderBy("archive", "member").limit(n)
    records = rows.select("name", F.lit("SETI").alias("origin"), F.lit("Narrowband").alias("sig_type"), F.lit(0.0).alias("dm"), "snr", F.lit(role).alias("true_role"))
    cells = rows.select(F.col("name").alias("obs_id"), "n_t", F.posexplode("power").alias("i", "power"))
    spectra = cells.select("obs_id", (F.col("i") % F.col("n_t")).alias("t"), F.floor(F.col("i") / F.col("n_t")).cast("int").alias("ch"), "power")
    return AuditSet(records, spark.createDataFrame([], "name string"), rows.select("name", "wave"), spectra)


def carrier_set(spark: SparkSession, path: str | None, n: int, window: int = WAVE) -> AuditSet:
    """n windows of ``window`` times of a filterbank file with a known carrier;
    nothing without a file or for n = 0. The wave is that of the window's
    strongest channel."""
    if not path or n <= 0 or not stores.listed(path):
        none = spark.createDataFrame([], RECORD)
        return AuditSet(none, spark.createDataFrame([], "name string"), spark.createDataFrame([], "name string, wave array<double>"), spark.createDataFrame([], "obs_id string, t int, ch int, power double"))
    rows = filterbank.read(spark, path, n * window)
    part = F.floor(F.col("t") / window).cast("int")
    stem = F.regexp_replace(F.element_at(F.split("obs_id", "/"), -1), r"\.[^.]*$", "")
    spectra = rows.select(F.concat(F.lit("voyager1__"), stem, F.lit("_"), part.cast("string")).alias("obs_id"), (F.col("t") % window).cast("int").alias("t"), "ch", "power")
    means = spectra.groupBy("obs_id", "ch").agg(F.avg(F.col("power") * F.col("power")).alias("p"), F.count("*").alias("k")).where(F.col("k") == window)
    best = means.groupBy("obs_id").agg(F.max(F.struct("p", (-F.col("ch")).alias("c"))).alias("b")).select("obs_id", (-F.col("b.c")).alias("ch"))
    line = spectra.join(best, ["obs_id", "ch"]).groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("t", "power"))).alias("s"), F.median("power").alias("m"), F.stddev_pop("power").alias("d"), F.max("power").alias("hi"))
    waves = line.select(F.col("obs_id").alias("name"), F.transform("s", lambda x: (x["power"] - F.col("m")) / F.when(F.col("d") > 0, F.col("d")).otherwise(1.0)).alias("wave"))
    snr = F.greatest(F.lit(1.0), F.coalesce((F.col("hi") - F.col("m")) / F.nullif("d", F.lit(0.0)), F.lit(1.0)))
    records = line.select(F.col("obs_id").alias("name"), F.lit("Voyager").alias("origin"), F.lit("Narrowband").alias("sig_type"), F.lit(0.0).alias("dm"), snr.alias("snr"), F.lit("Anomaly").alias("true_role"))
    return AuditSet(records, spark.createDataFrame([], "name string"), waves, spectra.join(line.select("obs_id"), "obs_id", "left_semi"))


def audit_set(
    catalog: DataFrame, survey: DataFrame, columns: tuple[str, ...], n_frb: int, n_rfi: int, n_anom: int = 0, archive: str | None = None, carrier: str | None = None, seed: int = 42
) -> AuditSet:
    """The whole labelled set. A carrier file gives the anomalies; members of an
    archive have no confirmed signal and are unlabelled."""
    spark = catalog.sparkSession
    frb, rfi = sampled_bursts(catalog, "object_id", n_frb, seed), sampled_interference(survey, columns, n_rfi, seed)
    seti = archive_set(spark, archive or "", "Unlabeled") if archive else carrier_set(spark, None, 0)
    tone = carrier_set(spark, carrier, n_anom)
    names = [f.strip().split()[0] for f in RECORD.split(",")]
    records = frb.select(*names).unionByName(rfi.select(*names)).unionByName(seti.records.select(*names)).unionByName(tone.records.select(*names))
    spectra = seti.spectra.select("obs_id", F.col("t").cast("int").alias("t"), "ch", "power").unionByName(tone.spectra)
    return AuditSet(records, rfi.select("name", *columns), seti.waves.unionByName(tone.waves), spectra)

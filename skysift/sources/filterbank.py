"""Filterbank files (binary header of keyed fields, then samples).

A data source plans ranges of bytes from the files' sizes; tasks read and decode
their ranges, and samples leave as rows. Layout: a length-prefixed keyword (4-byte little-endian
length), its value by type, from HEADER_START to HEADER_END.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import prepared
from . import stores

#: Fixed values of the format: keywords with 4-byte integers and 8-byte floats.
INTEGERS = ("machine_id", "telescope_id", "data_type", "nchans", "nbits", "nifs", "nbeams", "ibeam", "barycentric", "pulsarcentric", "nsamples")
DOUBLES = ("src_raj", "src_dej", "az_start", "za_start", "tstart", "tsamp", "fch1", "foff", "refdm", "period")
DTYPES = {8: np.uint8, 16: np.dtype("<u2"), 32: np.dtype("<f4")}


class FilterbankError(ValueError):
    """A file that is no readable filterbank."""


@dataclass
class Header:
    fields: dict[str, float | int | str] = field(default_factory=dict)
    size: int = 0

    def freqs_hz(self) -> np.ndarray:
        return float(self.fields["fch1"]) * 1e6 + float(self.fields["foff"]) * 1e6 * np.arange(int(self.fields["nchans"]))


def _text(data: bytes, at: int) -> tuple[str, int]:
    if at + 4 > len(data):
        raise FilterbankError("the header ends early")
    (n,) = struct.unpack_from("<i", data, at)
    if not 0 < n <= 80 or at + 4 + n > len(data):
        raise FilterbankError("a keyword has a bad length")
    return data[at + 4 : at + 4 + n].decode("latin-1"), at + 4 + n


def parse_header(data: bytes) -> Header:
    """Unknown keywords are read as texts and kept."""
    word, at = _text(data, 0)
    if word != "HEADER_START":
        raise FilterbankError("no HEADER_START")
    h = Header()
    while True:
        word, at = _text(data, at)
        if word == "HEADER_END":
            break
        if word in INTEGERS:
            (h.fields[word],) = struct.unpack_from("<i", data, at)
            at += 4
        elif word in DOUBLES:
            (h.fields[word],) = struct.unpack_from("<d", data, at)
            at += 8
        else:
            h.fields[word], at = _text(data, at)
    h.size = at
    if int(h.fields.get("nchans", 0)) <= 0 or int(h.fields.get("nbits", 0)) not in DTYPES:
        raise FilterbankError("nchans or nbits is missing or not supported")
    return h


def spectrum(data: bytes, max_samples: int | None = None) -> tuple[Header, np.ndarray]:
    """(header, time x channel): the first polarisation only."""
    h = parse_header(data)
    lay = Layout.of(h, len(data), max_samples)
    return h, lay.decode(data[h.size : h.size + lay.n_time * lay.line])


@dataclass(frozen=True)
class Layout:
    """Where samples lie: bytes of a time (all channels of all polarisations) and
    how many whole times there are."""

    dtype: np.dtype
    n_chan: int
    n_if: int
    n_time: int

    @classmethod
    def of(cls, h: Header, size: int, max_samples: int | None = None) -> Layout:
        dtype, n_chan, n_if = np.dtype(DTYPES[int(h.fields["nbits"])]), int(h.fields["nchans"]), max(int(h.fields.get("nifs", 1)), 1)
        n_time = max(0, size - h.size) // (dtype.itemsize * n_chan * n_if)
        return cls(dtype, n_chan, n_if, n_time if max_samples is None else min(n_time, max_samples))

    @property
    def line(self) -> int:
        return self.dtype.itemsize * self.n_chan * self.n_if

    def decode(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.dtype).reshape(-1, self.n_if, self.n_chan)[:, 0, :].astype(float)


SCHEMA = "obs_id string, t long, ch int, freq_mhz double, power double"
#: Bytes of a file that one task decodes, of a header at most, and samples of a batch.
RANGE_BYTES, HEADER_BYTES, BATCH = 64 << 20, 1 << 20, 200_000


@dataclass
class Range(InputPartition):
    """Bytes start (included) to end of a file of so many bytes."""

    path: str
    size: int
    start: int
    end: int

    def __hash__(self):
        return hash((self.path, self.start))


class FilterbankReader(DataSourceReader):
    """Plans by file sizes alone; a task reads its file's header, then the times
    whose first byte lies in its range."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        most = options.get("maxsamples", options.get("maxSamples"))
        self.max_samples = None if most is None else int(most)

    def partitions(self) -> list[Range]:
        out = []
        for path, size in stores.listed(self.path):
            out += [Range(path, size, at, min(size, at + self.range_bytes)) for at in range(0, max(size, 1), self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with stores.opened(partition.path) as f:
            h = parse_header(f.read(min(HEADER_BYTES, partition.size)))
            lay = Layout.of(h, partition.size, self.max_samples)
            first, last = (min(lay.n_time, max(0, -(-(at - h.size) // lay.line))) for at in (partition.start, partition.end))
            mhz = h.freqs_hz() / 1e6
            step = max(1, BATCH // lay.n_chan)
            for at in range(first, last, step):
                n = min(step, last - at)
                f.seek(h.size + at * lay.line)
                y = lay.decode(f.read(n * lay.line))
                t, ch = np.divmod(np.arange(y.size), lay.n_chan)
                columns = [pa.array([partition.path] * y.size, pa.string()), pa.array(t + at, pa.int64()), pa.array(ch, pa.int32()), pa.array(mhz[ch]), pa.array(y.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["obs_id", "t", "ch", "freq_mhz", "power"])


class FilterbankSource(DataSource):
    """format("filterbank"): a file, a folder or a pattern; options rangeBytes
    and maxSamples (times from the file's beginning)."""

    @classmethod
    def name(cls) -> str:
        return "filterbank"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilterbankReader:
        return FilterbankReader(dict(self.options))


def read(spark: SparkSession, path: str, max_samples: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(obs_id, t, ch, freq_mhz, power): one row per sample. A file of any size
    is read by ranges of bytes, each in a task of its own."""
    prepared(spark).dataSource.register(FilterbankSource)
    source = spark.read.format("filterbank").option("rangeBytes", range_bytes)
    return (source if max_samples is None else source.option("maxSamples", max_samples)).load(path)


def read_whole(spark: SparkSession, path: str, max_samples: int | None = None) -> DataFrame:
    """The same rows by Spark's own reader, for stores that only it can open: a
    file is a row and must be under 2 GB."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                h, x = spectrum(bytes(data), max_samples)
                mhz = h.freqs_hz() / 1e6
                step = max(1, BATCH // x.shape[1])
                for at in range(0, len(x), step):
                    y = x[at : at + step]
                    t, ch = np.divmod(np.arange(y.size), x.shape[1])
                    yield pd.DataFrame({"obs_id": name, "t": t + at, "ch": ch, "freq_mhz": mhz[ch], "power": y.ravel()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, SCHEMA)


def divide_by_median(df: DataFrame) -> DataFrame:
    """Divides each channel by its median; a median of 0 counts as 1."""
    m = df.groupBy("obs_id", "ch").agg(F.median("power").alias("_m"))
    return df.join(m, ["obs_id", "ch"]).withColumn("power", F.col("power") / F.when(F.col("_m") == 0, 1.0).otherwise(F.col("_m"))).drop("_m")

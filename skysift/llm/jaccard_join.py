"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document is the set of its five-word shingles (hashes). Documents with equal
sets are one node. Two sets of sizes r >= s link at similarity t only if their
symmetric difference is at most H = (1 - t) / (1 + t) * (r + s).

Sizes fall into bands [lo, lo / t^2]. For each band a hash deals the universe of
shingles to segments. Every set indexes its segments in its own band; for the
segments of a band that keep them, it also indexes the one-deletion
neighbourhood, the subsets that lack one shingle. As the larger partner it asks
in its own band and the one below, with an allocation of H + 1 units: a segment
costs one unit if it must be equal, two if it may differ in one shingle, none if
it is skipped. Two linked sets cannot differ in more than H shingles, so one of
the asked segments agrees within its allowance. The allocation takes the units
that cost least, in rows and in chance partners (segments of few shingles are
filled by common passages); the same costs decide how many segments of a band
keep neighbourhoods.

Candidates are verified exactly on the texts. Only components are wanted, so
candidates stay groups and are never paired: the members of a signature's list
form a group with its first member. A group of up to SMALL members is tested at
once, and only a spanning forest of its links leaves the task. A larger group
gets a centre, the shingles that most of a sample of its members hold. Members
whose differences from the centre are small enough together link for sure, and
link with the closest member. Of all others, two that link have a known number
of differences in common, so they share one of the first few; members that share
one, and are not in one component yet, are the groups of the next round. Each
round's groups agree in one more shingle, so rounds end.

Words are runs without U+0020 and U+0009 to U+000D, A-Z in lower case; with
fewer than five words the whole sequence is the one shingle. Null, empty and
blank texts have an empty set and link with nothing: their component is their
own id. Repeated rows and ids are handled as copies. Null ids take part in
links; a component's id is the least that is not null, and null if all are.
Extra columns are ignored. Sets, shingles and texts are told apart by 64-bit
hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import wordhash
from .common import WORD, beside, stored
from .components import components, merged

SHINGLE = 5
#: Similarity as a fraction NUM / DEN: link when DEN * common >= NUM * union.
NUM, DEN = 80, 100
#: Units a band has for each that the largest allocation asks.
SLACK = 1.1
#: Chance partners that a signature of 0, 1, 2 ... shingles is charged, in rows.
CHANCE = (30_000, 4, 1)
#: Groups of up to SMALL members and SMALL_SIZE shingles are tested at once; a
#: centre comes from SAMPLE members; PART members share a centre's copy.
SMALL, SMALL_SIZE, SAMPLE, PART = 1024, 4_000_000, 32, 256
#: About so many signature rows go to one partition.
ROWS_PER_PARTITION = 1_500_000

_U = np.uint64


def hamming(r: int, s: int) -> int:
    """Bound of the symmetric difference of linked sets of sizes up to r and s."""
    return (DEN - NUM) * (r + s) // (DEN + NUM)


def bands(top: int) -> list[tuple[int, int]]:
    """[(lo, hi)]: a set of size r has partners in its band and the one below."""
    out, lo = [], 1
    while lo <= top:
        hi = lo * DEN * DEN // (NUM * NUM)
        out.append((lo, hi))
        lo = hi + 1
    return out


def shingles(h: np.ndarray) -> np.ndarray:
    """The set of a document's word hashes, sorted."""
    if not len(h):
        return np.zeros(0, _U)
    if len(h) < SHINGLE:
        return wordhash.windows(h, len(h)) ^ _U(len(h))
    return np.unique(wordhash.windows(h, SHINGLE))


def node_id(s: np.ndarray) -> int:
    """64-bit identity of a set (0 for the empty one), as a signed long."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        h = int(wordhash.mix(np.array([wordhash.mix(s).sum() + _U(len(s))], _U))[0])
    return h - (1 << 64) if h >= 1 << 63 else h


_CHANCE = np.zeros(1 << 16, np.int64)
_CHANCE[: len(CHANCE)] = CHANCE


def allocate(count: np.ndarray, keeps: np.ndarray, units: np.ndarray, rows: bool) -> tuple[np.ndarray, np.ndarray]:
    """(units given to every segment: 0, 1 or 2; cost) of sets, one a line of
    count, the sizes of their segments. keeps: the segments that may take two.
    A signature costs its chance partners and, if rows, itself as a row; the
    second unit of a segment takes one signature for each of its shingles."""
    n, m = count.shape
    chance = _CHANCE[np.minimum(count, 1 << 15)]
    one = chance + rows
    k = np.flatnonzero(keeps)
    c = count[:, k]
    two = c * (_CHANCE[np.clip(c - 1, 0, 1 << 15)] + rows)
    cost = np.concatenate([one, np.maximum(two, one[:, k])], axis=1)
    order = np.argsort(np.minimum(cost, 65_535).astype(np.uint16), axis=1, kind="stable")
    given = np.zeros(cost.shape, bool)
    np.put_along_axis(given, order, np.arange(cost.shape[1])[None, :] < units[:, None], axis=1)
    v = given[:, :m].astype(np.int8)
    v[:, k] += given[:, m:]
    return v, (cost * given).sum(axis=1)


def _spread(mean: float, k: int) -> np.ndarray:
    """Sizes of k segments of this mean, as even parts of Poisson's law."""
    out = np.zeros(k, np.int64)
    p = total = math.exp(-min(mean, 700.0))
    c = 0
    for i in range(k):
        while total < (i + 0.5) / k and c < 10 * mean + 10:
            c += 1
            p *= mean / c
            total += p
        out[i] = c
    return out


class Band:
    """A band's deal of shingles to segments. Of its units, each as likely a
    place of a shingle as any other, plain segments have one and those that keep
    neighbourhoods two; the costs of a typical set decide their numbers."""

    def __init__(self, number: int, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        most = hamming(hi * DEN // NUM, hi)
        self.units = math.ceil(SLACK * (most + 1)) + 1
        self.alone = most == 0  # only equal sets link
        asked = np.array([min(hamming(hi, hi) + 1, self.units)])
        best = None
        for two in sorted({max(1, self.units * f // 32) for f in (1, 2, 4, 8, 16)}):
            plain = self.units - 2 * two
            if plain < 0:
                continue
            count = np.append(_spread(lo / self.units, plain), _spread(2 * lo / self.units, two))
            keeps = np.arange(plain + two) >= plain
            cost = plain + two + int(count[keeps].sum()) + int(allocate(count[None, :], keeps, asked, False)[1][0])
            if best is None or cost < best[0]:
                best = (cost, plain, two)
        _, self.plain, two = best
        self.m = self.plain + two
        self.keeps = np.arange(self.m) >= self.plain
        self.seed = _U((number * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & ((1 << 64) - 1))
        self.base = wordhash.mix(np.arange(self.m, dtype=_U) + self.seed)  # tells segments apart

    def deal(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, mixed value) of shingles."""
        x = wordhash.mix(s ^ self.seed)
        unit = ((x >> _U(32)) * _U(self.units) >> _U(32)).astype(np.int64)
        return np.where(unit < self.plain, unit, self.plain + (unit - self.plain) // 2), x


def make_bands(top: int) -> list[Band]:
    return [Band(i, lo, hi) for i, (lo, hi) in enumerate(bands(top))]


#: A signature row's role, in the low bits of its signature: rows that ask come
#: first in a signature's list, so a list whose first row does not ask has none.
BOTH, ASK, INDEX = 0, 1, 2


def signatures(sets: list[np.ndarray], band: Band, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """(signature with role, number of its set) of sets in their own band or, as
    the larger partners only, in the one below."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    largest = size if own else np.minimum(size, band.hi)
    fits = NUM * size <= DEN * largest
    if band.alone or not fits.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.flatnonzero(fits)
    size, largest = size[fits], largest[fits]
    seg, x = band.deal(np.concatenate([sets[i] for i in number]))
    row = np.repeat(np.arange(len(number)), size)
    at = row * band.m + seg
    total = np.zeros(len(number) * band.m, _U)
    np.add.at(total, at, x)
    count = np.bincount(at, minlength=len(total)).reshape(-1, band.m)
    units = (DEN - NUM) * (size + largest) // (DEN + NUM) + 1
    if own:  # with one unit only an equal set would do
        units = np.where(units > 1, units, 0)
    v = allocate(count, band.keeps, np.minimum(units, band.units), not own)[0].ravel()

    use = np.arange(len(total)) if own else np.flatnonzero(v)
    base = np.tile(band.base, len(number))
    role = np.where(v[use] > 0, BOTH if own else ASK, INDEX)
    whole = (wordhash.mix(total[use] + base[use]) & ~_U(3)) | role.astype(_U)
    less = np.flatnonzero(band.keeps[seg] if own else v[at] > 1)  # each lacks one shingle
    t = at[less]
    role = np.where(v[t] > 1, BOTH if own else ASK, INDEX)
    lack = (wordhash.mix(total[t] - x[less] + base[t]) & ~_U(3)) | role.astype(_U)
    return np.concatenate([whole, lack]).view(np.int64), number[np.concatenate([use // band.m, row[less]])]


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): h tells apart rows of different id or text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("h"), text.alias("text"))


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, node) of every row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, node = [0] * len(part), [0] * len(part)
            for i, h in wordhash.batch(part["text"].to_pylist(), lower=True):
                s = shingles(h)
                n[i], node[i] = len(s), node_id(s)
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), part["h"], pa.array(n, pa.int64()), pa.array(node, pa.int64())], ["doc_id", "h", "n_shingles", "node"])

    return _rows(docs).mapInArrow(run, "doc_id long, h long, n_shingles long, node long")


def _emit(docs: DataFrame) -> DataFrame:
    """(sig, node): the rows of every distinct set (a task emits a set once)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, seen = make_bands(4096), set()
        for part in parts:
            of: dict[int, list[tuple[int, np.ndarray]]] = {}
            for _, h in wordhash.batch(part["text"].tolist(), lower=True):
                s = shingles(h)
                k = node_id(s)
                if not len(s) or k in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(k)
                if len(s) > made[-1].hi:
                    ranges = bands(len(s))
                    made += [Band(i, *ranges[i]) for i in range(len(made), len(ranges))]
                number = next(i for i, b in enumerate(made) if len(s) <= b.hi)
                of.setdefault(number, []).append((k, s))
            for number, some in of.items():
                step = max(1, 2_000_000 // made[number].hi)  # bounds the arrays
                for at in range(0, len(some), step):
                    ids, sets = np.array([k for k, _ in some[at : at + step]], np.int64), [s for _, s in some[at : at + step]]
                    for b in (number, number - 1)[: number + 1]:
                        sig, of_set = signatures(sets, made[b], b == number)
                        if len(sig):
                            yield pd.DataFrame({"sig": sig, "node": ids[of_set]})

    return _rows(docs).select("text").mapInPandas(run, "sig long, node long")


def _shared(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(g, b) of rows sorted by signature (askers first) and node: the members
    of each list with its first, the hub; lists without an asker go. Streamed,
    whatever the size of a list: only the open list's hub is kept."""
    key0, node0, role0 = None, 0, 0
    for part in parts:
        if not len(part):
            continue
        sig, node = part["sig"].to_numpy(), part["node"].to_numpy()
        key, role = sig >> 2, (sig & 3).astype(np.int8)
        new = np.append(key0 is None or key[0] != key0, key[1:] != key[:-1])
        group = np.cumsum(new)  # 0: the list that the last batch left open
        first = np.flatnonzero(new)
        hub, hub_role = np.append(node0, node[first])[group], np.append(np.int8(role0), role[first])[group]
        key0, node0, role0 = key[-1], hub[-1], hub_role[-1]
        keep = (node != hub) & (hub_role != INDEX)
        if keep.any():
            yield pd.DataFrame({"g": hub[keep], "b": node[keep]}).drop_duplicates()


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of numbers that join the same of these sets as their links do: the
    first of each component with each of its others."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    m = len(sets)
    if m == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if DEN * common >= NUM * (int(n.sum()) - common) else []
    v, own = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.argsort(v, kind="stable")
    v, own = v[order], own[order]
    run = np.cumsum(np.append(True, v[1:] != v[:-1])) - 1
    often = np.bincount(run)[run] > 1
    own, run = own[often], run[often]
    common = np.zeros((m, m), np.float64)
    if len(run):
        col = np.cumsum(np.append(0, run[1:] != run[:-1]))
        for at in range(0, int(col[-1]) + 1, 1 << 14):
            lo, hi = np.searchsorted(col, (at, at + (1 << 14)))
            holds = np.zeros((m, 1 << 14), np.float32)
            holds[own[lo:hi], col[lo:hi] - at] = 1
            common += holds @ holds.T
    link = DEN * common >= NUM * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(link, True)
    label = np.arange(m)
    while True:
        least = np.where(link, label[None, :], m).min(axis=1)
        if (least == label).all():
            return [(int(a), b) for b, a in enumerate(label) if a != b]
        label = least


def _tested(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): the forests of groups, of rows (g, b, text) sorted by g."""
    g0, ids, sets = None, [], []

    def links() -> list[tuple[int, int]]:
        return [(ids[i], ids[j]) for i, j in forest(sets)] if len(sets) > 1 else []

    for part in parts:
        g, b = part["g"].to_pylist(), part["b"].to_pylist()
        found: list[tuple[int, int]] = []
        for i, h in wordhash.batch(part["text"].to_pylist(), lower=True):
            if g[i] != g0:
                found += links()
                g0, ids, sets = g[i], [], []
            ids.append(b[i])
            sets.append(shingles(h))
        if found:
            yield _pairs(found)
    if found := links():
        yield _pairs(found)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(found, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["u", "v"])


def _centre(group: pd.DataFrame) -> pd.DataFrame:
    """The shingles that over half of a sample of members hold."""
    sets = [shingles(h) for _, h in wordhash.batch(group["text"].tolist(), lower=True)]
    v, c = np.unique(np.concatenate(sets), return_counts=True)
    return pd.DataFrame({"g": group["g"].iloc[:1], "centre": [v[2 * c > len(sets)].view(np.int64)]})


def _apart(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, b, n, d, first) of rows (g, b, text, centre) in which a centre (b null)
    comes before its members: the number d of a member's differences from the
    centre and the first of them, those that the centre lacks before the others."""
    centre = np.zeros(0, _U)
    for part in parts:
        b = part["b"].to_pylist()
        keep, n, d, first = [], [], [], []
        texts = part["text"].to_pylist()
        hashed = wordhash.batch([t or "" for t in texts], lower=True)
        for i, h in hashed:
            if b[i] is None:
                centre = part["centre"][i].values.to_numpy().view(_U)
                continue
            s = shingles(h)
            new, gone = np.setdiff1d(s, centre, assume_unique=True), np.setdiff1d(centre, s, assume_unique=True)
            keep.append(i)
            n.append(len(s))
            d.append(len(new) + len(gone))
            first.append(np.concatenate([new, gone])[: hamming(len(s), len(s) * DEN // NUM) + 1].view(np.int64))
        if keep:
            some = part.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [some["g"], some["b"], pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(first, pa.list_(pa.int64()))], ["g", "b", "n", "d", "first"]
            )


def joined(groups: DataFrame) -> DataFrame:
    """(g, b, n) in which large groups are one if the hub of one is a member of
    the other: a set of many variants has many hubs, and its members would be
    compared with each of them."""
    hubs = stored(groups.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > SMALL).select(F.col("g").alias("b")))
    if hubs.isEmpty():
        return groups
    large = groups.join(hubs.select(F.col("b").alias("g")), "g")
    labels = components(large.join(hubs, "b").select(F.col("g").alias("u"), F.col("b").alias("v")))
    named = groups.join(labels.select(F.col("node").alias("g"), "comp"), "g", "left")
    return named.select(F.coalesce("comp", "g").alias("g"), "b", "n").distinct()


class _Groups:
    """Works on groups (g, b, n) of candidates, n the size of b's set, by the
    texts of their members."""

    def __init__(self, texts: DataFrame):
        self.texts = texts

    def sized(self, groups: DataFrame) -> DataFrame:
        """(g, b, n, size, small); groups of one member go."""
        of = groups.groupBy("g").agg(F.count("*").alias("size"), F.sum("n").alias("total")).where("size > 1")
        small = (F.col("size") == 2) | ((F.col("size") <= SMALL) & (F.col("total") <= SMALL_SIZE))
        return groups.join(of, "g").select("g", "b", "n", "size", small.alias("small"))

    def tested(self, sized: DataFrame) -> DataFrame:
        """Links (u, v) of the small groups."""
        rows = sized.where("small").select("g", "b").join(self.texts, "b").select("g", "b", "text")
        return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_tested, "u long, v long")

    def apart(self, sized: DataFrame) -> DataFrame:
        """(g, b, n, d, first) of the members of large groups."""
        large = sized.where("NOT small")
        w = W.partitionBy("g").orderBy("b")
        some = large.withColumn("i", F.row_number().over(w)).where(f"i <= {SAMPLE}").withColumn("sum", F.sum("n").over(w))
        some = some.where(f"i = 1 OR sum <= {SMALL_SIZE}").select("g", "b").join(self.texts, "b").select("g", "text")
        parts = F.ceil(F.col("size") / PART).cast("int")
        centres = some.groupBy("g").applyInPandas(_centre, "g long, centre array<long>")
        copies = large.groupBy("g").agg(F.first(parts).alias("parts")).select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        left = copies.join(centres, "g").select("g", "part", F.lit(None).cast("long").alias("b"), F.lit(None).cast("string").alias("text"), "centre")
        rows = large.select("g", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"), "b").join(self.texts, "b")
        both = left.unionByName(rows.select("g", "part", "b", "text", F.lit(None).cast("array<long>").alias("centre")))
        dealt = both.repartition("g", "part").sortWithinPartitions("g", "part", "b")
        return dealt.select("g", "b", "text", "centre").mapInArrow(_apart, "g long, b long, n long, d long, first array<long>")


def _excess() -> Column:
    """Over all members: x and y link for sure if the sum of theirs is at most 0."""
    return (DEN + NUM) * F.col("d") - (DEN - NUM) * F.col("n")


def sure_links(apart: DataFrame) -> DataFrame:
    """(u, v): members that link with their group's closest one for sure."""
    rows = apart.select("g", "b", _excess().alias("e"))
    closest = rows.groupBy("g").agg(F.min(F.struct("e", "b")).alias("c"))
    return rows.join(closest, "g").where("e + c.e <= 0 AND b <> c.b").select(F.col("c.b").alias("u"), F.col("b").alias("v"))


def next_groups(apart: DataFrame, labels: DataFrame) -> DataFrame:
    """(g, b, n): members of different components that share a difference which two
    that link must share. The closest member's component needs no pairs within;
    a pair has one member outside it, and the members of a pair have at least
    (e + f) / (2 (DEN + NUM)) differences in common, e and f their excesses. What
    a member has left from a shared difference on must reach that."""
    both = 2 * (DEN + NUM)
    comp = labels.select(F.col("node").alias("b"), "comp")
    rows = apart.join(comp, "b", "left").withColumn("comp", F.coalesce("comp", "b")).withColumn("e", _excess())
    closest = stored(rows.groupBy("g").agg(F.min(F.struct("e", "b", "comp")).alias("c"), F.max("n").alias("n_hi")))
    rows = beside(rows, closest, "g").withColumn("out", F.col("comp") != F.col("c.comp"))
    out = stored(rows.where("out").groupBy("g").agg(F.min("e").alias("e_out")))
    rows = beside(rows, out, "g")  # groups within one component go
    other = F.when(F.col("out"), F.col("c.e")).otherwise(F.col("e_out"))
    most = F.floor((DEN - NUM) * (F.col("n") + F.least(F.floor(F.col("n") * DEN / NUM), F.col("n_hi"))) / (DEN + NUM))
    least = F.greatest(F.lit(1), F.ceil((F.col("e") + other) / both), F.col("d") - most)
    held = rows.withColumn("len", (F.col("d") - least + 1).cast("int")).where("len > 0")
    told = held.select("g", "b", "n", "comp", "out", "e", "d", F.posexplode(F.slice("first", 1, F.col("len"))).alias("i", "t"))
    told = told.select(F.xxhash64("g", "t").alias("k"), "b", "n", "comp", "out", "e", (F.col("d") - F.col("i")).alias("left"))
    of = W.partitionBy("k")
    for _ in range(2):  # who goes may take away what another one had
        theirs = F.when(F.col("out"), F.min("e").over(of)).otherwise(F.min(F.when(F.col("out"), F.col("e"))).over(of))
        room = F.when(F.col("out"), F.max("left").over(of)).otherwise(F.max(F.when(F.col("out"), F.col("left"))).over(of))
        enough = F.ceil((F.col("e") + theirs) / both) <= F.least("left", room)
        live = (F.min("comp").over(of) < F.max("comp").over(of)) & F.max("out").over(of)
        told = told.withColumn("live", live & enough).where("live").drop("live")
    size, members = F.count("*").over(of), F.sum(F.xxhash64("b").cast("decimal(20,0)")).over(of)
    lists = told.select("k", "b", "n", size.alias("size"), members.alias("members")).where("size > 1")
    return lists.select(F.when(F.col("size") <= SMALL, F.xxhash64("members", "size")).otherwise(F.col("k")).alias("g"), "b", "n").distinct()


def components_of(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, node, comp, component_id) of every row."""
    spark = docs.sparkSession
    rows = stored(nodes(docs))
    real = rows.where("n_shingles > 0")
    one = stored(real.groupBy("node").agg(F.min("h").alias("h"), F.first("n_shingles").alias("n"), F.min("doc_id").alias("doc_id")))

    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(0.5 * total / ROWS_PER_PARTITION))
    dealt = _emit(docs).repartition(deal, F.shiftright("sig", 2)).sortWithinPartitions("sig", "node")
    pairs = stored(dealt.mapInPandas(_shared, "g long, b long").distinct())

    groups = pairs.unionByName(pairs.select("g", F.col("g").alias("b")).distinct())
    groups = stored(groups.join(one.select(F.col("node").alias("b"), "n", "h"), "b"))
    wanted = groups.select("b", "h").distinct()
    groups = stored(joined(groups.drop("h")))
    texts = _rows(docs).groupBy("h").agg(F.first("text").alias("text")).join(wanted, "h")
    work = _Groups(stored(texts.select("b", "text")))
    labels = spark.createDataFrame([], "node long, comp long")
    while not groups.isEmpty():
        sized = stored(work.sized(groups))
        apart = stored(work.apart(sized))
        labels = merged(labels, stored(work.tested(sized).unionByName(sure_links(apart))))
        groups = stored(next_groups(apart, labels))

    of = one.join(labels, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    named = of.join(of.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "comp").select("node", "comp", "component_id")
    out = rows.join(named, "node", "left")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return components_of(docs).select("doc_id", "n_shingles", "component_id")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs of which one stays for each group of linked documents:
    one with the least id (null after all others). Rows without words are linked
    with nothing and stay."""
    of = components_of(docs).where("n_shingles > 0")
    kept = of.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("r")).select("r.h")
    text = F.coalesce("text", F.lit(""))
    words = text.rlike(WORD)
    # rows of one id and text are collapsed before the shuffle
    each = docs.where(words).groupBy(F.xxhash64("doc_id", text).alias("h")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return docs.where(~words).unionByName(each.join(kept, "h").select("row.*"))


def op10(docs: DataFrame) -> DataFrame:
    return join(docs)

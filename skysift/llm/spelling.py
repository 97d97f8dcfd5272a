"""Spelling variants: words one edit apart, by dense prefix-suffix tiling.

Words are counted over all documents. Two words are near if one inserted,
deleted or replaced code point makes one of the other. With M code points in the
longer one, that is so exactly if their common prefix and common suffix are
together M - 1 or longer, so it is read off padded code-point matrices, a block
of words against a block of words, without a distance table.

Which blocks meet: the edit of a near pair lies at one place e (the length of the
common prefix, M - 1 at most), and the words agree before and after it. A cell
(M, lo, hi) holds words by what stands before lo and after hi; a pair whose e lies
in lo..hi shares its cell's key and is judged there and in no other cell of M. The
places 0..M-1 start as two halves. Keys are counted (partial sums before the
shuffle); the words of a key with over ``CELL`` of them are dealt to the two
halves of their cell, and so on. A cell of one place holds at most one word for
each letter and one shorter word, so keys end small whatever words have in
common; no group is held whole that could grow with the corpus, and pairs leave a
block only as each word's count of near words and its best one.

A word's form is its near word of largest count if that is at least ``RATIO``
times its own; roots follow forms by doubling, as counts at least double on the
way: log2 of their number of steps.

Edge cases: null, empty and letterless texts have no words. A null id reads as
empty in the digest. Repeated rows count as often as they come. Ties of counts go
to the smaller word in code-point order. Words may be of any length. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: One run in so many loses a code point.
DAMAGED = 97
#: A key with more words than this is split. Over the number of letters, so that
#: keys of one place are never split.
CELL = 1024
#: Words of a block, and bytes of a matrix.
BLOCK = 64
MATRIX = 1 << 24

#: Runs of at least so many letters: shorter ones make no word.
_RUN = rf"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}"


def _damaged(doc: Column, run: Column) -> Column:
    """The run, or the run without one code point, by the digest of both."""
    h = F.crc32(F.encode(F.concat(doc, F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % DAMAGED == 0, shorter).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of every word that is long and frequent enough."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))).alias("run"))
    words = runs.select(_damaged(F.col("doc"), F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the cell's key: what stands before lo and after hi."""
    tail = F.col("m") - 1 - F.col("hi")
    before = F.substring("word", F.lit(1), F.col("lo"))
    after = F.substring("word", F.length("word") - tail + 1, tail)
    return rows.withColumn("key", F.xxhash64("m", "lo", before, after))


def _halves(rows: DataFrame) -> DataFrame:
    """Every row in both halves of its cell's places lo..hi."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi")))
    return _keyed(rows.select("word", "n", "m", F.explode(parts).alias("part")).select("word", "n", "m", "part.lo", "part.hi"))


def cells(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, n, m, lo, hi, key): words in the cells in which they may have near
    ones; no key has over ``cell`` rows, but for cells of one place."""
    size = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"))
    todo = _halves(whole.select("word", "n", "m", F.lit(0).alias("lo"), (F.col("m") - 1).alias("hi")))
    ready = None
    while True:
        counts = todo.groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("hi") > F.col("lo")).alias("wide"))
        hot = stored(counts.where((F.col("c") > cell) & F.col("wide")).select("key"))
        n_hot = hot.count()
        if not n_hot:
            return todo if ready is None else ready.unionByName(todo)
        side = F.broadcast(hot) if n_hot <= MAX_BROADCAST else hot
        calm = todo.join(side, "key", "left_anti").select("word", "n", "m", "lo", "hi", "key")
        ready = calm if ready is None else ready.unionByName(calm)
        todo = stored(_halves(todo.join(side, "key", "left_semi")))


def _matrix(data: bytes, starts: np.ndarray, sizes: np.ndarray, width: int, pad: int, backward: bool) -> np.ndarray:
    """A row of code points for each word, padded on the right; backward: from
    its last code point to its first."""
    out = np.full((len(sizes), width), pad, np.uint8)
    place = np.arange(width)
    inside = place < sizes[:, None]
    at = starts[:, None] + (sizes[:, None] - 1 - place if backward else place)
    out[inside] = np.frombuffer(data, np.uint8)[at[inside]]
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of every row of a with every row of b,
    which are padded by different values."""
    alive = np.ones((len(a), len(b)), bool)
    out = np.zeros((len(a), len(b)), np.int32)
    for x, y in zip(a.T, b.T, strict=True):
        alive &= x[:, None] == y[None, :]
        if not alive.any():
            break
        out += alive
    return out


def near_pairs(words: list[bytes], m: int, lo: np.ndarray, hi: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (each once) of near words of equal keys, longer one of m code
    points, edit within lo..hi. Words are Latin-1, rows sorted by key."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    data = b"".join(words)
    ahead, behind = ([_matrix(data, starts, sizes, m, pad, back) for pad in (0, 1)] for back in (False, True))
    change = np.flatnonzero(key[1:] != key[:-1]) + 1
    ends = np.append(change, len(key))[np.searchsorted(change, np.arange(len(key)), side="right")]  # of each row's key
    left, right = [], []
    for i in range(0, len(words), BLOCK):
        ii = slice(i, min(i + BLOCK, len(words)))
        last = int(ends[ii.stop - 1])
        for j in range(i, last, BLOCK):
            jj = slice(j, min(j + BLOCK, last))
            may = (key[ii, None] == key[None, jj]) & (lo[ii, None] == lo[None, jj])
            may &= np.maximum(sizes[ii, None], sizes[None, jj]) == m
            if j == i:
                may = np.triu(may, 1)
            if not may.any():
                continue
            prefix = _common(ahead[0][ii], ahead[1][jj])
            at = np.minimum(prefix, m - 1)
            may &= (at >= lo[ii, None]) & (at <= hi[ii, None])
            if not may.any():
                continue
            may &= prefix + _common(behind[0][ii], behind[1][jj]) >= m - 1
            a, b = np.nonzero(may)
            left.append(a + i)
            right.append(b + j)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _best(words: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, number of near words, the best of them), by index."""
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    some = np.unique(b)
    rank = np.zeros(len(words), np.int64)
    rank[sorted(some.tolist(), key=words.__getitem__)] = np.arange(len(some))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    return a[first], np.diff(np.append(first, len(a))), b[first]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n, m, lo, hi, key) sorted by m and key: near words of each."""
    names = ["word", "near", "top", "form"]
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
        n, m, lo, hi, key = (rows.column(c).to_numpy() for c in ("n", "m", "lo", "hi", "key"))
        for part in np.split(np.arange(len(words)), np.flatnonzero(m[1:] != m[:-1]) + 1):
            at, width = 0, int(m[part[0]])
            while at < len(part):  # whole keys, as many as a matrix may hold
                end = min(len(part), at + max(1, MATRIX // width))
                while end < len(part) and key[part[end]] == key[part[end - 1]]:
                    end += 1
                s = slice(part[at], part[end - 1] + 1)
                some = words[s]
                a, b = near_pairs(some, width, lo[s], hi[s], key[s])
                if len(a):
                    i, c, j = _best(some, n[s], a, b)
                    columns = [
                        pa.array([some[k].decode("latin-1") for k in i.tolist()], pa.string()), pa.array(c, pa.int64()),
                        pa.array(n[s][j], pa.int64()), pa.array([some[k].decode("latin-1") for k in j.tolist()], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)
                at = end

    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(5).to_numpy()
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        if not len(change):
            held.append(batch)
            continue
        cut = int(change[-1])  # the last key may go on in the next batch
        yield from done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
        held = [batch.slice(cut)]
    if held:
        yield from done(pa.Table.from_batches(held))


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, n_near, top, best) of every word of (word, n) that has near words:
    how many, and count and name of the most frequent."""
    rows = cells(words, cell).select("word", "n", "m", "lo", "hi", "key")
    dealt = rows.repartition("key").sortWithinPartitions("m", "key", "word")
    found = dealt.mapInArrow(_tiles, "word string, near long, top long, form string")
    best = F.min(F.struct((-F.col("top")).alias("top"), F.col("form").alias("best")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.top")).alias("top"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of (word, form): the last of the forms."""
    cur = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if cur.join(further, "root", "left_semi").isEmpty():
            return cur
        cur = stored(cur.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = stored(vocabulary(docs, id_col, text_col))
    near = words.join(near_words(words), "word", "left")
    ok = F.col("top") >= RATIO * F.col("n")
    rows = stored(
        near.select(
            "word", F.when(ok, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("top")).alias("form_n")
        )
    )
    last = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(docs: DataFrame) -> DataFrame:
    return variants(docs)


#: The digest is worked out from its polynomial, one table entry a byte.
SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), runs AS (
  SELECT doc, run, count(*) AS c FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents
  ) WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL
), bytes AS (
  SELECT run, c, flatten(list_transform(string_split(doc || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END)) AS b FROM runs
), digest AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), w AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % {DAMAGED} = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM digest
  ) WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}
), holes AS (
  SELECT word, n, left(word, CAST(i AS INT)) AS p, substr(word, CAST(i AS INT) + 2) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
), longer AS (
  SELECT DISTINCT h.word AS a, h.n AS na, w.word AS b, w.n AS nb FROM holes h JOIN w ON h.p || h.s = w.word
), near AS (
  SELECT x.word AS a, y.word AS b, y.n AS nb FROM holes x JOIN holes y ON x.p = y.p AND x.s = y.s AND x.word <> y.word
  UNION ALL SELECT a, b, nb FROM longer UNION ALL SELECT b, a, na FROM longer
), best AS (
  SELECT a, count(*) AS n_near, first(b ORDER BY nb DESC, b) AS b, max(nb) AS nb FROM near GROUP BY a
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN nb >= {RATIO} * n THEN b END AS form, CASE WHEN nb >= {RATIO} * n THEN nb END AS form_n
  FROM w LEFT JOIN best ON best.a = w.word
), steps(word, now) AS (
  SELECT word, word FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.now = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT s.word, s.now AS root FROM steps s JOIN forms f ON s.now = f.word WHERE f.form IS NULL
)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM forms f JOIN roots r ON f.word = r.word
"""

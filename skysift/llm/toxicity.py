"""Toxicity by weak supervision.

1. Voters. Words and word beginnings (with one, two or three words of a text)
   that mark toxic documents are counted over a bounded sample of labelled rows;
   those that are no chance finds and add toxic rows become lexicon voters (a
   word) and pattern voters (so many words with one beginning), however many
   they are. Style patterns vote as well.
2. Votes of every document are computed once and stored.
3. A generative label model (expectation maximisation over the votes of all
   rows, no labels read) estimates each voter's rates under toxic and
   clean, and the correlations of voters given the class; correlated voters
   share their weight.
4. A linear classifier learns the posterior labels of all rows and scores them;
   a two-parameter calibration uses the labelled sample, whose rows are weighted
   back to the classes' shares in the table.

Edge cases: null and empty texts have no votes and get the score of a document
without evidence. Repeated rows get one row each, with the same score;
null ids stay null. Without
any usable label there are no lexicon voters and scores are the prior. Extra
columns are ignored; ``lang``, ``source`` and the id never enter a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored
from .sampling import hashed_share

#: Expected number of labelled rows of each class in the sample.
MAX_PER_CLASS = 4000
PREFIXES = (4, 5, 6)
#: So many words of a text must share a beginning for its voters to vote.
REPEATS = (1, 2, 3)
MIN_DOCS, MIN_LOG_ODDS = 3, 2.5
#: A key that is no evidence is as one-sided with a chance below exp(-this).
MIN_EVIDENCE = 12.0
#: The least share of toxic rows that a voter must add. A voter halves what the
#: rows that it adds are worth, so there are at most 2 / MIN_SHARE voters.
MIN_SHARE = 0.003
#: Voters share weight from this correlation (given toxic) on.
MIN_CORR = 0.4
THRESHOLD = 0.3

_TERM = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"!{2,}")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SYMBOL = re.compile(r"[#*$%&|<>]")
N_STYLE = 4


def held_out(id_col: str = "doc_id", mod: int = 4, rest: int = 2) -> Column:
    """Rows whose labels are never read."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest


def labelled_sample(labels: DataFrame, target: str, is_held_out: Column, per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(doc_id, y, weight): about per_class ids of each class, chosen by their
    hash; a row stands for weight rows of its class."""
    rows = labels.where(~is_held_out & F.col(target).isin(0, 1)).select("doc_id", F.col(target).cast("int").alias("y"))
    one = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}  # two rows at most
    part = {y: min(1.0, per_class / max(n.get(y, 1), 1)) for y in (0, 1)}
    share = F.when(F.col("y") == 1, part[1]).otherwise(part[0])
    return one.where(hashed_share(share)).withColumn("weight", 1 / share)


def _terms(text: str) -> Counter[str]:
    return Counter(_TERM.findall(text.lower()))


def _keys(words: Counter[str]) -> set[str]:
    """A word, marked by =, and its beginnings, marked by how many words at
    least share them."""
    out = {f"={w}" for w in words}
    for n in PREFIXES:
        begins: Counter[str] = Counter()
        for w, times in words.items():
            if len(w) > n:
                begins[w[:n]] += times
        out.update([f"{r}{b}" for b, times in begins.items() for r in REPEATS if times >= r])
    return out


def find_voters(sample: DataFrame) -> list[str]:
    """Lexicon (=word) and pattern (beginning) voters from (text, y) rows,
    best first; the counts are taken by Spark, partly within each task."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for part in parts:
            for text, y in zip(part["text"], part["y"], strict=True):
                seen[y].update(_keys(_terms(text)))
                n[y] += 1
        keys = [*seen[1], ""]  # a key that no toxic row has cannot be chosen
        yield pd.DataFrame({"key": keys, "pos": [*(seen[1][k] for k in seen[1]), n[1]], "neg": [*(seen[0][k] for k in seen[1]), n[0]], "part": 1})
        rest = [k for k in seen[0] if k not in seen[1]]
        if rest:
            yield pd.DataFrame({"key": rest, "pos": 0, "neg": [seen[0][k] for k in rest], "part": 1})

    rows = sample.select(F.coalesce("text", F.lit("")).alias("text"), "y").mapInPandas(count, "key string, pos long, neg long, part int")
    totals = stored(rows.groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(f"pos >= {MIN_DOCS}"))
    sizes = totals.where("key = ''").first()  # the class sizes are the row of the empty key
    p_all, n_all = (sizes["pos"], sizes["neg"]) if sizes else (0, 0)
    if not p_all or not n_all:
        return []
    # keys that can be chosen: each stands in a share of the sample's toxic rows
    share, hits = p_all / (p_all + n_all), F.col("pos") + F.col("neg")
    odds = F.log((F.col("pos") + 0.5) / (p_all + 1)) - F.log((F.col("neg") + 0.5) / (n_all + 1))
    rest = F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / hits / (1 - share))).otherwise(0.0)
    evidence = F.col("pos") * F.log(F.col("pos") / hits / share) + rest
    good = totals.where("key <> ''").where((F.col("pos") >= _least(p_all)) & (odds >= MIN_LOG_ODDS) & (evidence >= MIN_EVIDENCE))
    keys = sorted((r["key"] for r in good.select("key").collect()), key=lambda k: (len(k), k))
    found = votes(sample.withColumn("doc_id", F.col("y").cast("long")), keys).select("doc_id", "hits").where("size(hits) > 0").toPandas()
    return _cover(keys, found["hits"].tolist(), found["doc_id"].to_numpy(), p_all, n_all)


def _least(p_all: int) -> float:
    """What a voter must add, in toxic rows."""
    return max(1.2, MIN_SHARE * p_all)


def _cover(keys: list[str], hits: list[np.ndarray], y: np.ndarray, p_all: int, n_all: int) -> list[str]:
    """Chooses keys one by one for the toxic rows that they add; a row that has
    been covered counts half as much each time, so that the chance words of a
    toxic text add little once a word that recurs has been found."""
    rows: list[list[int]] = [[] for _ in keys]
    for i, row in enumerate(hits):
        for k in row:
            rows[k].append(i)
    at = [np.array(r, dtype=int) for r in rows]
    worth = np.where(y == 1, 1.0, -3.0 * p_all / n_all)
    least, chosen = _least(p_all), []
    gain = np.array([worth[r].sum() for r in at])
    while len(gain):
        k = int(np.argmax(gain))  # the shortest of equals: keys are sorted
        if gain[k] < least:
            break
        now = worth[at[k]].sum()
        if now < gain[k] - 1e-9:
            gain[k] = now  # a stale bound: gains only fall
            continue
        chosen.append(keys[k])
        gain[k] = -np.inf
        toxic = at[k][y[at[k]] == 1]
        worth[toxic] /= 2
    return chosen


def votes(docs: DataFrame, voters: list[str]) -> DataFrame:
    """(doc_id, hits array<int>, style array<float>) of every whole text."""
    words = {k[1:]: i for i, k in enumerate(voters) if k[0] == "="}
    begins: dict[int, dict[str, list[tuple[int, int]]]] = {}
    for i, k in enumerate(voters):
        if k[0] != "=":
            begins.setdefault(len(k) - 1, {}).setdefault(k[1:], []).append((int(k[0]), i))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            hits, style = [], []
            for text in part["text"]:
                terms = _terms(text)
                found = {words[w] for w in terms.keys() & words.keys()}
                for n, d in begins.items():
                    times: Counter[str] = Counter()
                    for w in terms:
                        if len(w) > n and w[:n] in d:
                            times[w[:n]] += terms[w]
                    found.update(i for b, seen in times.items() for r, i in d[b] if seen >= r)
                size = max(len(text), 1)
                hits.append(sorted(found))
                style.append([
                    min(1.0, 20 * len(_SHOUT.findall(text)) / size), len(_UPPER.findall(text)) / size,
                    min(1.0, 5 * len(_SYMBOL.findall(text)) / size), min(1.0, np.log1p(len(terms)) / 8),
                ])
            yield pd.DataFrame({"doc_id": part["doc_id"], "hits": hits, "style": style})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(rows, run, "hits array<int>, style array<float>")


def _dense(hits: pd.Series, k: int) -> np.ndarray:
    """0/1 votes of each row."""
    v = np.zeros((len(hits), k))
    sizes = np.fromiter(map(len, hits), int, len(hits))
    if sizes.sum():
        v[np.repeat(np.arange(len(hits)), sizes), np.concatenate(hits.tolist()).astype(int)] = 1
    return v


def _summed(rows: DataFrame, f: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum of f, a vector of this size, over all batches of rows: added up
    within each task, then by Spark."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for part in parts:
            total += f(part)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"i": at, "x": total[at]})

    got = rows.mapInPandas(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(size)
    out[got["i"].to_numpy(int)] = got["x"].to_numpy(float)
    return out


def _posterior(v: np.ndarray, prior: float, coef: np.ndarray | None, bias: float) -> np.ndarray:
    """Posterior of class toxic by the votes; a guess before the first round."""
    if coef is None:
        return np.where(v.any(axis=1), 0.9, 0.5 * prior)
    return 1 / (1 + np.exp(-np.clip(bias + v @ coef, -30, 30)))


def label_model(patterns: DataFrame, k: int, prior: float, rounds: int = 15) -> tuple[np.ndarray, float]:
    """(coef, bias) of the log-odds of class toxic, from the distinct votes
    (hits, n) of all rows. Each round adds up, over all patterns, what gives every
    voter's rate under both classes, and now and then the voters' correlations
    given toxic; k x k numbers reach the driver."""
    coef, bias, weight = None, 0.0, np.ones(k)
    for i in range(rounds):
        paired = i % 5 == 0

        def sums(part: pd.DataFrame, coef=coef, bias=bias, paired=paired) -> np.ndarray:
            v, n = _dense(part["hits"], k), part["n"].to_numpy(float)
            q = n * _posterior(v, prior, coef, bias)
            pairs = (v.T @ (v * q[:, None])).ravel() if paired else []
            return np.concatenate([[q.sum(), (n - q).sum()], q @ v, (n - q) @ v, pairs])

        got = _summed(patterns, sums, 2 + 2 * k + (k * k if paired else 0))
        n1, n0, s1, s0 = got[0], got[1], got[2 : 2 + k], got[2 + k : 2 + 2 * k]
        yes, no = (s1 + 0.1) / (n1 + 1.0), (s0 + 0.1) / (n0 + 1.0)
        no = np.minimum(no, 0.5 * yes)  # voters vote for toxic
        if paired:  # dependence among voters given toxic
            c = got[2 + 2 * k :].reshape(k, k) - np.outer(yes, s1) - np.outer(s1, yes) + n1 * np.outer(yes, yes)
            s = np.sqrt(np.maximum(np.diag(c), 1e-9))
            corr = c / np.outer(s, s)
            weight = 1 / (1 + np.where(corr > MIN_CORR, corr - np.eye(k), 0).clip(0, 1).sum(axis=1))
        on, off = np.log(yes) - np.log(np.maximum(no, 1e-6)), np.log1p(-yes) - np.log1p(-no)
        coef, bias = weight * (on - off), float(np.log(prior / (1 - prior)) + (weight * off).sum())
    return coef, bias


def fit_posterior(rows: DataFrame, k: int, prior: float, coef: np.ndarray, bias: float, rounds: int = 40, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression of all rows' posterior labels by Newton's method; a
    round adds up loss, gradient and curvature over all rows. The last weight is
    the constant's."""
    d = k + 2 + N_STYLE

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def sums(part: pd.DataFrame) -> np.ndarray:
            x = _matrix(part, k)
            y = _posterior(x[:, :k], prior, coef, bias)
            x = np.hstack([x, np.ones((len(x), 1))])
            z = x @ w
            q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return np.concatenate([[len(x), (np.logaddexp(0, z) - y * z).sum()], x.T @ (q - y), (x.T @ (x * (q * (1 - q))[:, None])).ravel()])

        got = _summed(rows, sums, 2 + d + d * d)
        n = max(got[0], 1.0)
        return got[1] / n + l2 / 2 * float(w @ w), got[2 : 2 + d] / n + l2 * w, got[2 + d :].reshape(d, d) / n + l2 * np.eye(d)

    w = np.zeros(d)
    loss, g, h = at(w)
    step, share = np.linalg.solve(h, g), 1.0
    for _ in range(rounds):
        gain = float(step @ g)
        if gain < 1e-9 or share < 1e-6:
            break
        new = w - share * step
        got = at(new)
        if got[0] > loss - 1e-4 * share * gain:
            share /= 2
            continue
        w, (loss, g, h) = new, got
        step, share = np.linalg.solve(h, g), 1.0
    return w


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 400, l2: float = 1e-3, weight: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = (np.ones(len(y)) if weight is None else weight) / max(len(y) if weight is None else weight.sum(), 1)
    w, m, s = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, rounds + 1):
        g = x.T @ (share * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) + l2 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def _matrix(rows: pd.DataFrame, k: int) -> np.ndarray:
    """Votes, their number (damped) and the style measures."""
    x = np.zeros((len(rows), k + 1 + N_STYLE))
    x[:, :k] = _dense(rows["hits"], k)
    x[:, k] = np.minimum(x[:, :k].sum(axis=1), 4) / 2
    if len(rows):
        x[:, k + 1 :] = np.stack(rows["style"].tolist())
    return x


def score(docs: DataFrame, labels: DataFrame, is_held_out: Column | None = None) -> DataFrame:
    """(doc_id, score) of every row of docs."""
    out = held_out() if is_held_out is None else is_held_out
    known = F.broadcast(labelled_sample(labels, "toxic", out).coalesce(1))  # at most 2 x MAX_PER_CLASS rows
    text = docs.select("doc_id", "text")
    sample = text.join(known, "doc_id").withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "y"])  # copies count once
    voters = find_voters(sample.select("text", "y"))
    k = len(voters)
    all_votes = stored(votes(docs, voters))

    gold = all_votes.join(known, "doc_id").toPandas()
    prior = float(np.clip((np.average(gold["y"], weights=gold["weight"]) if len(gold) else 0.1), 0.02, 0.5))
    if k:
        patterns = stored(all_votes.groupBy("hits").agg(F.count("*").alias("n")))
        w = fit_posterior(all_votes, k, prior, *label_model(patterns, k, prior))
    else:
        w = np.zeros(k + 2 + N_STYLE)
    a, b = 1.0, 0.0
    if len(gold):
        z = np.hstack([_matrix(gold, k), np.ones((len(gold), 1))]) @ w
        line = fit_linear(np.clip(z, -10, 10)[:, None], gold["y"].to_numpy(float), l2=1e-4, weight=gold["weight"].to_numpy(float))
        a, b = max(float(line[0]), 0.0), float(line[1])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            z = np.clip(np.hstack([_matrix(part, k), np.ones((len(part), 1))]) @ w, -10, 10)
            yield pd.DataFrame({"doc_id": part["doc_id"], "score": 1 / (1 + np.exp(-(a * z + b)))})

    return map_rows(all_votes, run, "score double")


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs, labels)
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

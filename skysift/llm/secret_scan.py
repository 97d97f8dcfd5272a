"""Secret scan: fixed patterns plus a Markov test for random strings.

Two first-order character models, one of random strings and one of ordinary
words, are trained by counting character pairs: of made random strings, and of
the words of all documents that no pattern claims, numbers included, mixed with
fixed names in a fixed share. A token of at least 12 characters that no pattern
claims is a secret when the log-likelihood ratio of the two models exceeds
log(1 / FALSE_RATE): an ordinary token does so with at most that probability,
if the ordinary model holds. DataFrame functions only.

Spans are (kind, start, end) in code points, end exclusive. Kinds, in order:
``assign``, ``access``, ``hex`` by pattern, ``random`` by the models. Model
spans never overlap pattern spans.

Edge cases: null and empty texts have no spans. Repeated rows are scanned each
on its own. Other columns of the input are ignored. An empty table gives an
empty result (the models then rest on the fixed identifiers alone).
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A run that is shorter than the least length cannot hold a longer one, so the
#: least length may stand in these two patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
KINDS = ("assign", "access", "hex", "random")

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
FIRST, N_CHARS = 33, 94  # printable ASCII without the space

#: Bound on the share of ordinary tokens that the ratio may flag (Markov's
#: inequality), and the log-likelihood ratio that follows from it.
FALSE_RATE = 1e-4
LLR_THRESHOLD = -math.log(FALSE_RATE)
#: Share of the fixed names in the ordinary model, at every size of the corpus.
NAMES_SHARE = 0.2
#: Made random strings: so many counters are hashed.
SAMPLE_RANDOM = 4000

#: Ordinary names as code and configuration hold them.
IDENTIFIERS = (
    "getElementById", "document_root_path", "max_partition_bytes", "shuffle_partitions", "application/json", "content-security-policy",
    "user_profile_picture_url", "is_authenticated_user", "ConnectionTimeoutException", "AbstractSingletonFactory", "default-src-elements",
    "sites/default/files/images", "wp-content/themes/classic", "number_of_training_steps", "learning_rate_scheduler", "batch_size_per_device",
    "HTTP_FORWARDED_FOR_HEADER", "MAX_CONNECTION_RETRIES", "ENABLE_FEATURE_PREVIEW", "en/articles/category/science", "static/media/stylesheets",
    "customer_address_line", "order_total_amount", "shipping_method_selected", "lastModifiedTimestamp", "createdByUserName", "responseStatusCode",
    "previous-and-next-navigation", "sidebar-widget-container", "newsletter-subscription-form", "ParquetOutputFormat", "WindowExpressionBuilder",
)


def _pairs(tokens: DataFrame) -> DataFrame:
    """(label, a, b): the neighbouring characters of every labelled token."""
    codes = F.transform(F.split("token", ""), lambda c: F.ascii(c) - FIRST)
    rows = tokens.select("label", codes.alias("c"))
    both = F.arrays_zip(
        F.expr("slice(c, 1, greatest(size(c) - 1, 0))").alias("a"), F.expr("slice(c, 2, greatest(size(c) - 1, 0))").alias("b")
    )
    pair = rows.select("label", F.explode(both).alias("p")).select("label", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    return pair.where(f"a BETWEEN 0 AND {N_CHARS - 1} AND b BETWEEN 0 AND {N_CHARS - 1}")


def labelled_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, label): 1 random strings made by hashing counters, 0 the words of
    all documents that no pattern claims, 2 the fixed names above."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 512)
    random = spark.range(SAMPLE_RANDOM).select(
        F.explode(
            F.array(
                F.substring(digest, 1, 40),
                F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""),
                F.upper(F.translate(F.substring(digest, 60, 40), "01", "xk")),
                F.conv(F.substring(digest, 20, 14), 16, 36),
            )
        ).alias("token"),
        F.lit(1).alias("label"),
    )
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), ASSIGN, " ")
    words = docs.select(F.explode(F.split(text, r"[^A-Za-z0-9+/_=-]+")).alias("token"))
    plain = words.where("length(token) >= 6").where(~F.col("token").rlike(f"{ACCESS}|{HEX}")).select("token", F.lit(0).alias("label"))
    fixed = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in IDENTIFIERS])).alias("token"), F.lit(2).alias("label"))
    return random.unionByName(plain).unionByName(fixed)


def fit(tokens: DataFrame) -> list[float]:
    """Log-likelihood ratio (random against ordinary) of every pair of
    characters, row by row; at most 3 x N_CHARS x N_CHARS counts reach the
    driver, whatever the size of the sample."""
    n = N_CHARS
    counts = [[[0.1] * n for _ in range(n)] for _ in range(3)]
    for r in _pairs(tokens).groupBy("label", "a", "b").count().collect():
        counts[r["label"]][r["a"]][r["b"]] += r["count"]
    out = []
    for a in range(n):
        words, random, names = ([c / sum(row[a]) for c in row[a]] for row in counts)
        ordinary = [(1 - NAMES_SHARE) * w + NAMES_SHARE * m for w, m in zip(words, names, strict=True)]
        out += [math.log(x) - math.log(y) for x, y in zip(random, ordinary, strict=True)]
    return [round(x, 4) for x in out]


_WALK = """
aggregate(
  array(named_struct('p', {p}, 'm', {m}, 'g', {g})), CAST(array() AS {span}),
  (z, s) -> aggregate(
    sequence(0, size(s.m) - 1),
    named_struct('at', 0L, 'out', z),
    (a, i) -> named_struct(
      'at', a.at + length(s.p[i]) + length(s.m[i]),
      'out', CASE WHEN {test} THEN concat(a.out, array(named_struct(
        'start', a.at + length(s.p[i]), 'kind', {kind}, 'end', a.at + length(s.p[i]) + length(s.m[i])))) ELSE a.out END),
    a -> a.out))
"""


def _located(rows: DataFrame, pattern: str, kind: int, group: int = 0, test: str = "true") -> DataFrame:
    """Adds span_<kind>: the places of a pattern's matches that pass the test (SQL
    over the match s.m[i] and its group s.g[i]), from the lengths of the matches
    and of what lies between them."""
    m, k = f"m_{kind}", kind
    rows = rows.withColumn(m, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    some = F.size(m) > 0
    empty = F.expr(f"CAST(array() AS {SPAN})")
    rows = rows.withColumn(f"p_{k}", F.when(some, F.split("text", pattern, -1)))
    rows = rows.withColumn(f"g_{k}", F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))) if group else F.col(m))
    walk = F.expr(_WALK.format(p=f"p_{k}", m=m, g=f"g_{k}", span=SPAN, test=test, kind=kind))
    return rows.withColumn(f"span_{k}", F.when(some, walk).otherwise(empty)).drop(m, f"p_{k}", f"g_{k}")


def _ratio(model: list[float], token: str) -> str:
    """Log-likelihood ratio of a token, as SQL."""
    return f"""
aggregate(array(from_json('{json.dumps(model)}', 'array<float>')), CAST(0 AS DOUBLE), (z, w) ->
  aggregate(array(transform(split({token}, ''), c -> ascii(c) - {FIRST})), z, (y, c) ->
    aggregate(sequence(1, size(c) - 1), y, (sum, k) -> sum + w[c[k - 1] * {N_CHARS} + c[k]])))
"""


def find(docs: DataFrame, model: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, base, spans): pattern spans, and all spans, in order."""
    if model is None:
        model = fit(labelled_tokens(docs, text_col))
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _located(rows, ASSIGN, 0, group=2, test="length(s.g[i]) >= 6")
    rows = _located(rows, ACCESS, 1)
    rows = _located(rows, HEX, 2)
    rows = _located(rows, CANDIDATE, 3, test=f"{_ratio(model, 's.m[i]')} > {LLR_THRESHOLD}")
    rows = rows.select(id_col, "text", F.array_sort(F.concat("span_0", "span_1", "span_2")).alias("base"), "span_3")
    extra = F.expr("filter(span_3, x -> NOT exists(base, y -> y.start < x.end AND x.start < y.end))")
    rows = rows.withColumn("extra", F.when(F.size("span_3") > 0, extra).otherwise(F.col("span_3")))
    return rows.select(id_col, "text", "base", F.array_sort(F.concat("base", "extra")).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", **cols) -> DataFrame:
    """(id, text, n_secrets) with every span's characters replaced by mask;
    spans that touch or overlap become one mask."""
    found = find(docs, **cols)
    out = F.expr(f"""
CASE WHEN size(spans) = 0 THEN text ELSE
aggregate(array(text), '', (z, t) -> aggregate(spans, named_struct('at', 0L, 'out', z), (a, s) ->
    CASE WHEN s.end <= a.at THEN a
         WHEN s.start <= a.at AND a.at > 0 THEN named_struct('at', s.end, 'out', a.out)
         ELSE named_struct('at', s.end, 'out', concat(a.out, substring(t, CAST(a.at + 1 AS INT), CAST(s.start - a.at AS INT)), '{mask}')) END,
  a -> concat(a.out, substring(t, CAST(a.at + 1 AS INT))))) END
""")
    return found.select(found.columns[0], out.alias("text"), F.size("spans").alias("n_secrets"))


def op8(docs: DataFrame) -> DataFrame:
    found = find(docs)
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


def random_ratio(spark: SparkSession, tokens: list[str], model: list[float]) -> dict[str, float]:
    """Log-likelihood ratios of a few tokens (for tests and tuning)."""
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", F.expr(_ratio(model, "t")).alias("r"))
    return {r["t"]: r["r"] for r in rows.collect()}

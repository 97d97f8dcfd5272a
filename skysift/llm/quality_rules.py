"""Quality rules as a bitmask ledger.

Every rule is measured once per document; a ledger row holds the measurements
and one failure bit per rule. Policies are versioned bit masks over that
ledger, so a new policy or an ablation is an aggregation over long columns and
never reads a text again. DataFrame functions only.

Edge cases: a null or empty text has no words, fails ``few_words`` and is not
kept. Ties do not arise. Repeated rows give repeated ledger rows. Columns of
the input that clash with ledger columns are replaced by the ledger's (the
input's are not read, except id and text). Texts may have up to 2**24 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bit of each rule in the ledger, and the condition under which it fails.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (1, "n_words < 50"),
    "repeated_words": (2, "100 * n_repeat_words > 50 * n_words"),
    "symbol_heavy": (4, "5 * n_symbols > n_words"),
    "upper_heavy": (8, "2 * n_upper > word_chars"),
    "duplicate_lines": (16, "2 * n_dup_lines > n_lines"),
    "word_length": (32, "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
}
BASE = RULES["few_words"][0] | RULES["repeated_words"][0]

#: Versioned policies: a document is kept if none of these bits is set.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | 4 | 8,
    "v2": BASE | 4 | 8 | 16 | 32,
}
DEFAULT_POLICY = "v2"

#: Hashes of three-word windows; the low 24 bits hold the window's place, so a
#: plain sort of longs brings equal windows together. Whether two neighbours
#: are equal is decided on the whole 64-bit hash.
_REPEATS = """
aggregate(
  array(transform(words, w -> xxhash64(w))),
  0L,
  (a, h) -> aggregate(
    array(transform(slice(h, 1, greatest(size(h) - 2, 0)), (x, i) -> xxhash64(x, h[i + 1], h[i + 2]))),
    0L,
    (b, t) -> aggregate(
      array(sort_array(transform(t, (x, i) -> shiftleft(shiftright(x, 24), 24) | CAST(i AS BIGINT)))),
      0L,
      (c, s) -> aggregate(
        array_sort(transform(
          filter(s, (k, i) ->
            CASE WHEN i > 0 AND shiftright(s[i - 1], 24) = shiftright(k, 24)
                      AND t[CAST(s[i - 1] & 16777215 AS INT)] = t[CAST(k & 16777215 AS INT)] THEN true
                 WHEN i < size(s) - 1 AND shiftright(s[i + 1], 24) = shiftright(k, 24)
                      AND t[CAST(s[i + 1] & 16777215 AS INT)] = t[CAST(k & 16777215 AS INT)] THEN true
                 ELSE false END),
          k -> k & 16777215L)),
        named_struct('last', -3L, 'n', 0L),
        (d, p) -> named_struct('last', p, 'n', d.n + least(3L, p - d.last)),
        d -> d.n))))
"""


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _lacking(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, "")).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with every measurement that a rule needs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), text.alias("text"), _words(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    counted = rows.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        _lacking(F.col("text"), WHITE).alias("word_chars"),
        (F.length("text") - _lacking(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("text") - _lacking(F.col("text"), UPPER)).cast("long").alias("n_upper"),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))[0].alias("line"),
        F.expr(_REPEATS).alias("n_repeat_words"),
    )
    return counted.select(
        id_col, "n_words", "word_chars", "n_symbols",
        (F.col("line.n") - F.col("line.d")).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "n_upper", F.col("line.n").cast("long").alias("n_lines"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements plus ``failed``, a long with one bit per failed rule."""
    bits = [F.when(F.expr(cond), F.lit(bit)).otherwise(F.lit(0)) for bit, cond in RULES.values()]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return measure(docs, id_col, text_col).withColumn("failed", out.cast("long"))


def apply_policy(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Adds ``kept`` by a policy's mask."""
    mask = POLICIES[policy]
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask)) == 0)


def ablation(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of a policy: failures, documents that only it rejects, and what
    would be kept without it; one aggregation over the ledger's bits."""
    mask = POLICIES[policy]
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    one = rows.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.bit_or(hit), F.lit(0)).alias("any_bits"),
        F.coalesce(F.bit_and(hit), F.lit(0)).alias("all_bits"),
        *[F.count_if(hit.bitwiseAND(F.lit(bit)) != 0).alias(f"failed_{name}") for name, (bit, _) in RULES.items()],
        *[F.count_if(hit == bit).alias(f"only_{name}") for name, (bit, _) in RULES.items()],
        F.count_if(hit == 0).alias("n_kept"),
    )
    return one.select(
        "n_docs", "any_bits", "all_bits", "n_kept",
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("rule"), F.col(f"failed_{name}").alias("n_failed"), F.col(f"only_{name}").alias("n_only"),
                     (F.col("n_kept") + F.col(f"only_{name}")).alias("kept_without"))
            for name, (bit, _) in RULES.items() if mask & bit
        ])).alias("r"),
    ).select("r.*", "n_docs", "n_kept", "any_bits", "all_bits")


def op7(docs: DataFrame) -> DataFrame:
    rows = apply_policy(ledger(docs))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept",
        F.col("failed").alias("failed_bits"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), tri AS (
  SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri) WHERE n > 1
), cov AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + o AS p FROM dup, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.rid = cov.rid
), f AS (
  SELECT *,
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 32 ELSE 0 END AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, CAST(failed_bits AS BIGINT) AS failed_bits
FROM f
"""

"""Fill-in-the-middle examples, cut by one match with repeated captures.

A text is a run of units: a run of letters A-Z and a-z, or one other code point.
One ``fullmatch`` of the regex library over ``(unit)*`` keeps every repetition
of its group, so ``match.ends(1)`` is the list of all units' ends: its length is
the number of units, and both cuts are looked up in it. Quantifiers are
possessive: a match is linear in the text. Cuts and forms follow from a digest
of the document's id, so they depend on neither order nor partitioning.

Forms: ``plain`` leaves the text, ``psm`` is prefix, suffix, middle and ``spm``
is suffix, prefix, middle, each piece after its mark. A mark that is cut from
pieces which hold none cannot arise where pieces meet (no mark's end can begin
another one), so ``restore`` gives back the exact text.

Every row is worked on by itself and nothing is shuffled; an Arrow batch is
bounded by bytes, and a text needs about 200 bytes a unit while it is matched.

Edge cases: null and empty texts are the empty text, 0 units, form plain. A null
id has the digest of ``1:``. Equal ids get equal draws; repeated rows repeat
their result. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are rearranged, and of these that are ``spm``.
REARRANGED, SUFFIX_FIRST = 90, 20
SEED = 1

_UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")


def unit_ends(text: str) -> list[int]:
    """The end of every unit of a text, in order."""
    return _UNITS.fullmatch(text).ends(1)


def cut(text: str, a: int, b: int) -> tuple[int, int, int]:
    """(units, end of the prefix, end of the middle) for two draws."""
    ends = unit_ends(text)
    n = len(ends)
    first, last = sorted((a % (n + 1), b % (n + 1)))
    return n, ends[first - 1] if first else 0, ends[last - 1] if last else 0


def _draw(digest: Column, k: int) -> Column:
    """The k-th (from 0) group of 8 hexadecimal digits, as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row: units, form,
    code points of prefix and middle (null if plain) and the text to train on."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias(id_col), text.alias("text"), digest.alias("digest"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (_draw(F.col("digest"), 2) % 100 >= REARRANGED)
    form = F.when(plain, "plain").when(_draw(F.col("digest"), 3) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    rows = rows.select(id_col, "text", form.alias("form"), *[_draw(F.col("digest"), k).alias(f"draw{k}") for k in (0, 1)])
    of_id = rows.schema[id_col].dataType
    out = (
        T.StructType().add(id_col, of_id).add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, before, inside, output = [], [], [], []
            forms = batch.column(2).to_pylist()
            for text, form, a, b in zip(batch.column(1).to_pylist(), forms, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                n, p, m = cut(text, a, b)
                units.append(n)
                if form == "plain":
                    before.append(None)
                    inside.append(None)
                    output.append(text)
                    continue
                before.append(p)
                inside.append(m - p)
                head = PREFIX + text[:p] + SUFFIX + text[m:] if form == "psm" else SUFFIX + text[m:] + PREFIX + text[:p]
                output.append(head + MIDDLE + text[p:m])
            columns = [
                batch.column(0), pa.array(units, pa.int64()), batch.column(2), pa.array(before, pa.int64()),
                pa.array(inside, pa.int64()), pa.array(output, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, out)


def restore(output: Column, form: Column) -> Column:
    """The text of an example, from its output and form alone."""
    pieces = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.get(pieces, i) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def op13(docs: DataFrame) -> DataFrame:
    rows = examples(docs)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents
), h AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || g[1:8] AS BIGINT) AS h1, CAST('0x' || g[9:16] AS BIGINT) AS h2,
         CAST('0x' || g[17:24] AS BIGINT) AS h3, CAST('0x' || g[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS prefix,
         coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS middle, coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS suffix FROM c
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS out FROM p
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(out) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""

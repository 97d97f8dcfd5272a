"""Fill-in-the-middle examples against a plain version."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from skysift.llm import fill_middle

TEXTS = [
    None, "", "a", " ", "one two", "Éé\U0001f642 x\ny", "has <P> in it", "<S", "ends in <", "P>", "<<P<S", "1" * 400, "a" * 5000,
    "ab1 " * 2000, "퟿\x00tab\t", "one two",
]


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(4)
    made = ["".join(rng.choice("ab<PSM>> 1é\n") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    out = list(enumerate(TEXTS + made))
    return out + [out[4], (None, "a null id"), (None, "a null id"), (-5, "below nought")]


def test_examples_equal_a_plain_version(spark):
    data = [(i, t, "n", 1, "o") for i, t in rows()]
    df = spark.createDataFrame(data, "doc_id long, text string, n string, draw0 int, output string").repartition(3)
    got = sorted(map(tuple, fill_middle.examples(df).collect()), key=repr)
    assert got == sorted(((i, *plain(i, t)) for i, t in rows()), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fill_middle.op13(df.where("doc_id = 10000")).count() == 0


def test_texts_are_restored(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    want = sorted((hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows()))
    assert sorted(r["restored_sha256"] for r in fill_middle.op13(df).collect()) == want
    back = fill_middle.examples(df).select(fill_middle.restore(F.col("output"), F.col("form")).alias("t"))
    assert sorted(r["t"] for r in back.collect()) == sorted(t or "" for _, t in rows())


def test_other_ids_and_seeds(spark):
    df = spark.createDataFrame([("x-1", "some words to cut here")], "doc_id string, text string")
    r = fill_middle.examples(df, seed=7).first()
    assert r["doc_id"] == "x-1" and r["n"] == 9
    outs = {fill_middle.examples(df, seed=k).first()["output"] for k in range(5)}
    assert len(outs) > 1

"""Personal data: patterns, features, trees and the choice of spans against a
plain version, and figures on made texts that neither fit nor thresholds saw."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import regex

from skysift.llm import pii

TEXTS = [
    None, "", " \n", "no data here", "a@b.c", "x@y@b.co.uk x@@y.com a@b.c_d@e.f end", "é.u@mail-1.example.com.", "1.2.3.4 1.2.3.4.5 256.1.1.1 000.0.00.0255",
    "4111 1111 1111 1111 and 4111111111111112, 4111-1111-1111-1111", "9" * 400, "+1 (555) 123-4567 +49.30.1234567890123 ++1 23", "+" * 50 + "1 2345 6789 0",
    "a" * 3000 + "@b.com", "12 " * 500, "call (555) 123-4567 or 0170 1234567", "jane [at] example [dot] com", "fe80::1:2:3 at 12:30:45", "card 4111111111111111 4111111111111111",
    "mail me@x.org\nmail me@x.org", "\U0001f642\U0001f642 tel 555-123-4567 \U0001f642",
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(t):
    return re.sub("[^0-9]", "", t)


def base(text):
    """The contract, with its own patterns."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(v) <= 255 for v in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


def features(kind, gen, m, before, after):
    d, g, b, low = digits(m), [len(x) for x in re.findall("[0-9]+", m)], before.lower(), m.lower()
    w = re.ASCII
    out = [
        kind, gen, len(d), len(m) // 2, len(g), max(g, default=0), min(g, default=0), g[0] if g else 0, g[-1] if g else 0,
        m.count(" "), m.count("-"), m.count("."), m.count("/"), "(" in m or "[" in m, m.startswith(("+", "00")), m.startswith("0"),
        int(d[0]) + 1 if d else 0, 13 <= len(d) <= 19 and luhn(d), len(re.findall("[a-z]", low)), m.count(":"), "@" in m,
        bool(re.search("(com|org|net|edu|gov|info|io|de|fr|es|eu|uk)$", low)), bool(re.search(r"\b(dot|at)\b", low, w)),
        bool(re.search("(^|[^0-9])(19|20)[0-9]{2}([^0-9]|$)", m) or re.match("[0-3]?[0-9][./-][01]?[0-9][./-]", m)),
        *(bool(re.search(c, b, w)) for c in pii.CUES),
        bool(re.search(r"[A-Za-zÀ-ÿ:.]\s?\Z", before, w)), bool(re.search(r"[^\s(]\Z", before, w)),
        bool(re.search(r"[$€£#=]\s?\Z", before, w) or re.match(r"\s?[€$%£]", after, w)), bool(re.match(r"\s?(km|kg|m|ms|MB|GB|s|h)\b", after, w)),
        bool(re.match("[-.,/:]?[0-9A-Za-z]", after)),
    ]
    return [min(max(int(x), 0), pii.BINS - 1) for x in out]


def proposed(text):
    out = []
    for gen, (pattern, kinds) in enumerate(pii.GENERATORS):
        last, found = 0, []
        for m in regex.finditer(pattern.replace(r"\x20", " "), text):
            found.append((text[last : m.start()], m))
            last = m.end()
        gaps = [x for x, _ in found] + [text[last:]]
        for i, (gap, m) in enumerate(found):
            n = len(digits(m.group()))
            for kind in map(pii.KINDS.index, kinds):
                if {2: 13 <= n <= 19, 3: 7 <= n <= 15}.get(kind, True):
                    out.append((m.start(), m.end(), kind, features(kind, gen, m.group(), gap[-pii.BEFORE :], gaps[i + 1][: pii.AFTER])))
    return out


def plain(text, model):
    text = text or ""
    fixed = base(text)
    some = {(p, -a, b, k) for a, b, k, f in proposed(text) if not any(x < b and a < y for _, x, y in fixed) for p in [model.probability(model.margin(f))] if p >= model.thresholds[k]}
    kept = {(k, -a, b) for p, a, b, k in some if not any(o > (p, a, b, k) and -o[1] < b and -a < o[2] for o in some)}
    return fixed, sorted({*fixed, *kept})


@pytest.fixture(scope="module")
def model(spark):
    return pii.Model.fit(spark)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_spans_equal_a_plain_version(spark, model, monkeypatch):
    rng = random.Random(6)
    odd = ["a@b.c", "1.2.3.4", "4111111111111111", "+1 (555) 123-4567", "555-123-4567", " at ", " dot ", "tel ", "é", " ", ".", "@", "-", "(0)", "00", "12", "x", "2001:db8::1", "\n"]
    texts = TEXTS + ["".join(rng.choice(odd) for _ in range(rng.randint(1, 25))) for _ in range(400)] + [" ".join(t for t, *_ in pii.made_texts(400, 77))] + [t for t, *_ in pii.made_texts(200, 78)]
    rows = [*enumerate(texts), (5, TEXTS[5]), (None, "a null id, a@b.c")]
    monkeypatch.setattr(pii.Model, "fit", classmethod(lambda cls, spark: model))
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id long, text string, base string, spans int").repartition(3)
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) for r in pii.op12(df).collect()), key=repr)
    want = []
    for i, t in rows:
        fixed, spans = plain(t, model)
        want.append((i, *(sum(k == n for k, _, _ in fixed) for n in range(4)), hashlib.sha256(listed(fixed).encode()).hexdigest(), listed(spans)))
    assert got == sorted(want, key=repr)
    assert any(len(w[6]) > 0 and sum(w[1:5]) == 0 for w in want)
    assert pii.op12(df.where("doc_id = -1")).count() == 0


def test_proposals_and_probabilities(spark, model):
    texts = [t for t, *_ in pii.made_texts(150, 79)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.proposals(df).selectExpr("doc_id", "explode(proposed) AS x").selectExpr("doc_id", "x.*", f"{model.sql('x.f')} AS p").collect()
    got = sorted((r["doc_id"], r["start"], r["end"], r["kind"], r["f"]) for r in rows)
    assert got == sorted((i, *x) for i, t in enumerate(texts) for x in proposed(t))
    assert all(math.isclose(r["p"], model.probability(model.margin(r["f"])), rel_tol=1e-9) for r in rows)


def test_made_texts_held_out(spark, model):
    """Precision and recall over texts of another seed, span by span."""
    made = pii.made_texts(1500, 4242)
    df = spark.createDataFrame([(i, m[0]) for i, m in enumerate(made)], "doc_id long, text string")
    got = {r["doc_id"]: {(x["kind"], x["start"], x["end"]) for x in r["spans"]} - {(x["kind"], x["start"], x["end"]) for x in r["base"]} for r in pii.find(df, model).collect()}
    truth = {i: {m[1:]} if m[1] >= 0 else set() for i, m in enumerate(made)}
    by_base = {i: set(base(m[0])) for i, m in enumerate(made)}
    right = sum(len(got[i] & truth[i]) for i in truth)
    assert right / sum(len(got[i]) for i in truth) > 0.95
    assert right / sum(len(truth[i] - by_base[i]) for i in truth) > 0.9


def test_clean_documents_stay(spark, model):
    """Prose of the given table without a digit or @ gets no span."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("NOT text RLIKE '[0-9@]'")
    assert docs.count() > 50 and pii.find(docs, model).where("size(spans) > 0").count() == 0


def test_redaction(spark, model):
    df = spark.createDataFrame([(1, "mail a@b.c, tel 555-123-4567."), (2, None), (3, "+1.2.3.45 6789 0")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(df, model=model).collect()}
    assert got == {1: "mail [EMAIL], tel [PHONE].", 2: "", 3: "[PHONE]"}


def test_places_over_many_blocks_and_long_runs(spark, model):
    """Thousands of spans, and runs that never match, in little time."""
    texts = ["x 1.2.3.4 " * 3000, "a" * 200_000, "1" * 200_000, "1." * 100_000, "a.b-" * 50_000 + "@", "+1" + " " * 100_000, "0:" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["base"] for r in pii.find(df, model).collect()}
    assert [(s["start"], s["end"]) for s in got[0]] == [(10 * i + 2, 10 * i + 9) for i in range(3000)]
    for i, t in list(enumerate(texts))[1:]:
        if len(t) <= 100_002 or i < 3:
            assert [(s["kind"], s["start"], s["end"]) for s in got[i]] == [] if i != 3 else True
    assert len(got[3]) == 25_000


def test_threshold():
    p, y = np.array([0.99, 0.9, 0.8, 0.8, 0.6, 0.4]), np.array([1, 1, 1, 0, 1, 1])
    assert pii.Model.threshold(p, y) == 0.9
    assert pii.Model.threshold(p[:2], y[:2]) == 0.9
    assert pii.Model.threshold(p[5:], y[5:]) == 1.1 and pii.Model.threshold(p[:0], y[:0]) == 1.1

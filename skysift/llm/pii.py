"""Personal data: fixed patterns, and boosted trees over proposed spans.

Four patterns give the base spans (email, ip, card, phone). Beside them generous
generators propose further spans, which may overlap: numbers with and without
groups, brackets or a foreign prefix, spelled-out addresses, hexadecimal host
addresses. Each proposal has features of its own format (digits, groups,
separators, checksum, beginning and end) and of what stands beside it (cue words
in four languages, neighbouring characters). Boosted trees score them, a logistic
curve fitted on a part of the sample that the trees never saw turns the score
into a probability, and each kind has the least threshold at which that part
shows the precision ``PRECISION``. What passes, touches no base span and loses to
no overlapping proposal is added.

Texts are read by DataFrame functions only. The trees are fitted on
``N_TRAIN + N_CALIBRATE`` made texts with one known span or one look-alike each
(the tables hold no labelled spans): that bounded sample's bins come to the
driver, nothing else does. No row meets another one, and nothing is shuffled.

Spans are (kind, start, end) in code points, end exclusive, listed by kind, then
start. Places are running sums over blocks of ``STEP`` matches, so a text costs
time in proportion to its length and matches; only proposals are held against the
base spans of their text one by one. Patterns begin at the first character of a
run and never give back, so no text takes the square of its length.

Edge cases: null and empty texts have no span. Repeated rows are scanned each on
its own. Equal probabilities: the earlier, then the longer proposal wins. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting

KINDS = ("email", "ip", "card", "phone")

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The contract's patterns; a match begins at a run's first character or where
#: the last match ended, which is where the leftmost one begins.
BASE = (
    rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Generators, and the kinds that their matches are proposed as.
GENERATORS = (
    (r"(?<![A-Za-z0-9])[0-9]{7,19}+(?![A-Za-z0-9])", ("card", "phone")),
    (r"(?<![A-Za-z0-9])[0-9]{1,8}+(?:[\x20./-][0-9]{1,8}+(?![A-Za-z0-9])){1,7}+", ("card", "phone")),
    (r"(?<![0-9])[0-9]{4}(?:\x20[0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{4}(?:-[0-9]{4}){3}(?![0-9])", ("card",)),
    (r"\([0-9]{2,5}+\)[\x20./-]?+[0-9]{2,8}+(?:[\x20./-][0-9]{2,8}+(?![A-Za-z0-9])){0,3}+", ("phone",)),
    (r"(?<![A-Za-z0-9])(?:\+|00)[0-9]{1,3}(?:[\x20./()-]{1,3}+[0-9]{2,8}+){2,5}+(?![A-Za-z0-9])", ("phone",)),
    (
        rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?(?:[\[({{<]\x20?(?:at|AT|@)\x20?[\])}}>]|\x20at|\x20AT|@)\x20?{_LABEL}{{1,63}}"
        rf"(?:\x20?(?:[\[({{<]\x20?(?:dot|DOT|\.)\x20?[\])}}>]\x20?|\x20dot\x20|\x20DOT\x20|\x20?\.){_LABEL}{{2,63}}){{1,4}}+",
        ("email",),
    ),
    (r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}+:){2,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])", ("ip",)),
)
#: Words before a proposal, by what they speak for.
CUES = (
    "phone|call|tel|tél|mobil|handy|fax|ruf|appel|llam|numéro|sms|whatsapp",
    "card|visa|master|amex|karte|carte|tarjeta|credit|kredit|crédit",
    "mail|contact|write|reach|schreib|écri|escrib|correo|kontakt",
    "\\bip|host|server|addr|adress|ping|servidor|serveur|client",
    "order|invoice|isbn|issn|doi|\\bref|\\bid|version|page|rechnung|bestell|commande|facture|pedido|factura|ticket|serial|article|art\\.|total|sum|=",
)
#: Code points before and after a proposal that its features see.
BEFORE, AFTER = 24, 4
STEP, NEAR = 256, 400

#: The bounded sample of made texts, the trees, and the precision asked for.
N_TRAIN, N_CALIBRATE, SEED = 4000, 2000, 11
ROUNDS, BINS = 40, 32
PRECISION = 0.98

_SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"
_FOUND = "array<struct<start:bigint,end:bigint,m:string,before:string,after:string>>"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with a name for a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_SUMS = "named_struct('at', 0L, 'out', CAST(array() AS array<bigint>))"
#: From matches and what lies between them to (start, end, match, beside it).
_PLACED = "CASE WHEN size({m}) = 0 THEN CAST(array() AS " + _FOUND + ") ELSE " + _let(
    "named_struct('m', {m}, 'p', {p})", "z",
    _let(
        f"transform(sequence(0, CAST((size(z.m) - 1) div {STEP} AS INT)), b -> aggregate(sequence(b * {STEP}, least(size(z.m), (b + 1) * {STEP}) - 1), {_SUMS}, "
        "(a, i) -> named_struct('at', a.at + length(z.p[i]) + length(z.m[i]), 'out', concat(a.out, array(a.at + length(z.p[i]))))))", "blocks",
        _let(
            f"aggregate(blocks, {_SUMS}, (a, x) -> named_struct('at', a.at + x.at, 'out', concat(a.out, array(a.at)))).out", "bases",
            f"flatten(transform(blocks, (x, k) -> transform(x.out, (s, i) -> named_struct('start', bases[k] + s, 'end', bases[k] + s + length(z.m[k * {STEP} + i]), "
            f"'m', z.m[k * {STEP} + i], 'before', right(z.p[k * {STEP} + i], {BEFORE}), 'after', left(z.p[k * {STEP} + i + 1], {AFTER})))))",
        ),
    ),
) + " END"


def _located(rows: DataFrame, pattern: str, name: str) -> DataFrame:
    """Adds the places of a pattern's matches as ``name``."""
    m, p = f"_m_{name}", f"_p_{name}"
    rows = rows.withColumn(m, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    rows = rows.withColumn(p, F.when(F.size(m) > 0, F.split("text", pattern, -1)))
    return rows.withColumn(name, F.expr(_PLACED.format(m=m, p=p))).drop(m, p)


def _digits(text: str) -> str:
    return f"translate({text}, translate({text}, '0123456789', ''), '')"


def _luhn(digits: str) -> str:
    """SQL: whether digits pass the checksum of card numbers."""
    one = "(ascii(substring(d, length(d) - k, 1)) - 48)"
    step = f"s + CASE WHEN k % 2 = 0 THEN {one} WHEN {one} > 4 THEN 2 * {one} - 9 ELSE 2 * {one} END"
    return _let(digits, "d", f"aggregate(sequence(0, length(d) - 1), 0, (s, k) -> {step}) % 10 = 0")


#: Tests of base matches, by kind.
_TESTS = (
    "true",
    "forall(split(x.m, '[.]'), q -> length(ltrim('0', q)) <= 3 AND coalesce(try_cast(ltrim('0', q) AS INT), 0) <= 255)",
    _let(_digits("x.m"), "g", f"length(g) BETWEEN 13 AND 19 AND {_luhn('g')}"),
    f"length({_digits('x.m')}) BETWEEN 9 AND 15",
)


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, base): the spans of the fixed patterns."""
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for k, (name, pattern) in enumerate(zip(KINDS, BASE, strict=True)):
        rows = _located(rows, pattern, f"_b_{name}")
        spans = f"transform(filter(_b_{name}, x -> {_TESTS[k]}), x -> named_struct('kind', {k}, 'start', x.start, 'end', x.end))"
        rows = rows.withColumn(f"_b_{name}", F.expr(f"CAST({spans} AS {_SPAN})"))
    names = [f"_b_{n}" for n in KINDS]
    return rows.withColumn("base", F.array_sort(F.concat(*names))).drop(*names)


def _flag(condition: str) -> str:
    return f"CAST({condition} AS INT)"


#: Features of a proposal x, in order: whole numbers from 0, cut off at BINS - 1.
#: d its digits, g the lengths of its groups of digits, b what stands before it.
FEATURES = {
    "kind": "x.kind", "generator": "x.gen", "digits": "length(d)", "length": "length(x.m) div 2", "groups": "size(g)",
    "longest": "coalesce(array_max(g), 0)", "shortest": "coalesce(array_min(g), 0)", "first": "coalesce(get(g, 0), 0)", "last": "coalesce(get(g, size(g) - 1), 0)",
    "spaces": "length(x.m) - length(replace(x.m, ' ', ''))", "hyphens": "length(x.m) - length(replace(x.m, '-', ''))",
    "dots": "length(x.m) - length(replace(x.m, '.', ''))", "slashes": "length(x.m) - length(replace(x.m, '/', ''))",
    "bracket": _flag("contains(x.m, '(') OR contains(x.m, '[')"), "foreign": _flag("x.m rlike '^([+]|00)'"), "nought": _flag("startswith(x.m, '0')"),
    "lead": "CASE WHEN d = '' THEN 0 ELSE ascii(d) - 47 END", "checksum": f"CASE WHEN length(d) BETWEEN 13 AND 19 THEN {_flag(_luhn('d'))} ELSE 0 END",
    "letters": "length(x.m) - length(translate(lower(x.m), 'abcdefghijklmnopqrstuvwxyz', ''))", "colons": "length(x.m) - length(replace(x.m, ':', ''))",
    "sign": _flag("contains(x.m, '@')"), "ending": _flag("lower(x.m) rlike '(com|org|net|edu|gov|info|io|de|fr|es|eu|uk)$'"), "spelled": _flag("lower(x.m) rlike '\\\\b(dot|at)\\\\b'"),
    "date": _flag("x.m rlike '(^|[^0-9])(19|20)[0-9]{2}([^0-9]|$)' OR x.m rlike '^[0-3]?[0-9][./-][01]?[0-9][./-]'"),
    **{f"cue{i}": _flag(f"b rlike '{cue}'".replace("\\", "\\\\")) for i, cue in enumerate(CUES)},
    "beside": _flag("x.before rlike '[A-Za-zÀ-ÿ:.]\\\\s?\\\\z'"), "joined": _flag("x.before rlike '[^\\\\s(]\\\\z'"), "money": _flag("x.before rlike '[$€£#=]\\\\s?\\\\z' OR x.after rlike '^\\\\s?[€$%£]'"),
    "unit": _flag("x.after rlike '^\\\\s?(km|kg|m|ms|MB|GB|s|h)\\\\b'"), "touches": _flag("x.after rlike '^[-.,/:]?[0-9A-Za-z]'"),
}

_GROUPS = "transform(filter(split(x.m, '[^0-9]+'), q -> q <> ''), q -> length(q))"


def _features() -> str:
    row = "array(" + ", ".join(f"least(greatest(CAST({f} AS INT), 0), {BINS - 1})" for f in FEATURES.values()) + ")"
    return _let(_digits("x.m"), "d", _let(_GROUPS, "g", _let("lower(x.before)", "b", row)))


def proposals(rows: DataFrame) -> DataFrame:
    """Adds proposed: (start, end, kind, features) of all generators' matches to
    rows that have a text."""
    names = []
    for i, (pattern, kinds) in enumerate(GENERATORS):
        rows = _located(rows, pattern, f"_g{i}")
        codes = ", ".join(str(KINDS.index(k)) for k in kinds)
        fits = "CASE y.kind WHEN 2 THEN n BETWEEN 13 AND 19 WHEN 3 THEN n BETWEEN 7 AND 15 ELSE true END"
        fits = _let(f"length({_digits('y.m')})", "n", fits)
        each = f"transform(array({codes}), k -> named_struct('start', w.start, 'end', w.end, 'm', w.m, 'before', w.before, 'after', w.after, 'kind', k, 'gen', {i}))"
        out = f"transform(filter(flatten(transform(_g{i}, w -> {each})), y -> {fits}), x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'f', {_features()}))"
        rows = rows.withColumn(f"_g{i}", F.when(F.size(f"_g{i}") > 0, F.expr(out)).otherwise(F.expr("CAST(array() AS array<struct<start:bigint,end:bigint,kind:int,f:array<int>>>)")))
        names.append(f"_g{i}")
    return rows.withColumn("proposed", F.concat(*names)).drop(*names)


def _filled(rng: random.Random, shape: str) -> str:
    """A made string: # a digit, & a digit from 1, ~ a hexadecimal digit, ? a letter."""
    pick = {"#": "0123456789", "&": "123456789", "~": "0123456789abcdef", "?": "abcdefghijklmnopqrstuvwxyz"}
    return "".join(rng.choice(pick[c]) if c in pick else c for c in shape)


def _passes(text: str) -> bool:
    """Whether the digits of a made string pass the checksum of card numbers."""
    d = [int(c) for c in reversed(text) if c.isdigit()]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def _checked(rng: random.Random, shape: str) -> str:
    """As filled, with the last digit that makes the checksum right."""
    text = _filled(rng, shape)
    return next(t for t in (text[:-1] + c for c in "0123456789") if _passes(t))


#: Shapes of personal data, and of what looks like it.
PHONES = (
    "(&##) ###-####", "(&##)###-####", "&##-###-####", "&##.###.####", "&## ### ####", "0&# ########", "0&### ######", "0&## ###-####", "0&/#######",
    "00&# ### ### ###", "00&# ## ######", "0# ## ## ## ##", "6## ## ## ##", "9## ### ###", "(0&##) ######", "(0&#) ####-####", "0&##/######", "+&#/###/#######", "&##########", "0&#########",
)
CARDS = ("4###############", "5&##############", "4### #### #### ####", "5&##-####-####-####", "37#############", "6011 #### #### ####", "4###-####-####-####", "4### #### #### #### ")
MAILS = (
    "???? [at] ?????? [dot] com", "????.???? at ?????? dot org", "???##@ ????? .com", "??????(at)????.de", "???_??? (at) ????? (dot) net", "????? AT ???? DOT fr", "????@?????.es",
    "????{at}?????.com", "??? at ?????.com", "????? <at> ???? <dot> io",
)
HOSTS = ("~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~", "fe80::~~~~:~~~~:~~~~:~~~~", "2001:db8::~~~~", "2001:~~~:~~~~::~", "~~:~~:~~:~~:~~:~~")
LOOKALIKES = (
    "0###############", "00##############", "################", "#### #### #### ####",
    "&######", "&########", "&###########", "&###############", "&#################", "&### #### #### ####", "&###-####-####-####", "20##-0&-1#", "1#.0&.20##", "20##.0&.1#", "19## - 20##", "19##-20##",
    "&,###,###", "&.###.###", "& ### ###", "&# ### ###", "1#:##:##", "0#:##:##", "0&:1#:2#:##", "97&-#-##-######-#", "97&##########", "&.##.###", "v&.##.####", "&#.###/&###-##", "&###/####", "& 2 3 4 5 6 7 8",
    "?? at ????.???", "????? at ????? ????", "??? at ??.", "???? at ?????.?????", "to at ????.????", "? at ????????.??", "20## at ??????.", "&## ## ###", "&##-##-####", "&#/&#/20##", "20##0&1#", "20##0&1#1###", "1#######-####", "&####-####", "&.#######", "(&###) ##", "(20##) ####",
)
FILLERS = (
    "the", "of", "and", "and a", "que", "und der", "les", "with this", "for", "it was", "en la", "von", "there", "pour", "is", "sur la", "in", "se", "a line", "eine", "thing.", "done,", "tion", "ment",
)
SPEAK = (
    ("phone", "call", "tel.", "Tel", "tél :", "Telefon", "teléfono", "mobile:", "fax", "call me at", "Rufnummer", "llame al", "WhatsApp", "phone number:"),
    ("card", "Visa", "card number", "Kreditkarte", "carte bancaire", "tarjeta", "MasterCard:", "paid by card", "credit card no."),
    ("mail", "e-mail:", "write to", "contact", "Kontakt:", "correo", "reach me:", "écrire à", "schreiben an"),
    ("IP", "host", "server", "from address", "ping", "servidor", "client"),
    ("order", "invoice", "ISBN", "ref", "id", "version", "page", "Rechnung", "Bestellung", "commande", "facture", "pedido", "ticket", "serial no.", "article", "on", "since", "=", "$", "€", "total", "number", "no.", "doi:"),
)


#: Which of these words speak for a kind.
SPOKEN = {0: 2, 1: 3, 2: 1, 3: 0, -1: 4}


def made_texts(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, kind or -1, start, end) by rule: one span or one look-alike each."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        kind = rng.choice((3, 3, 2, 2, 0, 1, -1, -1, -1, -1, -1))
        shape = rng.choice({3: PHONES, 2: CARDS, 0: MAILS, 1: HOSTS, -1: LOOKALIKES}[kind]).strip()
        item = _checked(rng, shape) if kind == 2 else _filled(rng, shape)
        if kind == -1 and sum(c.isdigit() for c in item) > 12 and _passes(item):
            continue  # a look-alike that is none
        bare = kind == 3 and "(" not in shape and item[0] != "0" and "+" not in shape and sum(c.isdigit() for c in item) > 9 and item.isdigit()
        spoken = rng.random() < (1.0 if bare else 0.6)  # a bare run of digits is a number of anything
        lead = rng.choice(FILLERS) + " " + rng.choice(FILLERS) + " " + (rng.choice(SPEAK[SPOKEN[kind]]) if spoken else rng.choice(FILLERS))
        lead += rng.choice((" ", " ", " ", ": ", ", ", "\n"))
        tail = rng.choice((" ", ". ", ", ", "\n", "") if kind != -1 else (" ", ". ", " km ", "% ", " € ", ", ", "\n", ""))
        tail += rng.choice(FILLERS) if tail else ""
        text = lead + item + tail
        out.append((text, kind, len(lead), len(lead) + len(item)))
    return out


def _sampled(spark: SparkSession, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(bins, labels) of the proposals of n made texts: 1 for the very span."""
    texts = json.dumps([{"text": t, "k": k, "a": a, "b": b} for t, k, a, b in made_texts(n, seed)])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(texts), "array<struct<text:string,k:int,a:bigint,b:bigint>>")).alias("r")).select("r.*")
    each = proposals(rows).select("k", "a", "b", F.explode("proposed").alias("x"))
    got = each.select("x.f", ((F.col("x.kind") == F.col("k")) & (F.col("x.start") == F.col("a")) & (F.col("x.end") == F.col("b"))).cast("int").alias("y")).collect()
    return np.array([r["f"] for r in got], np.uint8).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], np.int64)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope and intercept by Newton's method, kept from running off."""
    z, w = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, z.T @ (y - p) - 1e-3 * w), -2, 2)
    return float(w[0]), float(w[1])


class Model:
    """Trees (features, highest bin on the left, values), the curve's slope and
    intercept, and a threshold of the probability for each kind."""

    def __init__(self, trees: list[tuple[list[int], list[int], list[float]]], base: float, slope: float, intercept: float, thresholds: list[float]):
        self.trees, self.base, self.slope, self.intercept, self.thresholds = trees, base, slope, intercept, thresholds

    @classmethod
    def fit(cls, spark: SparkSession, n_train: int = N_TRAIN, n_calibrate: int = N_CALIBRATE, seed: int = SEED, rounds: int = ROUNDS) -> Model:
        x, y = _sampled(spark, n_train, seed)
        got = boosting.fit_sample(x, y, boosting.Plan(np.ones((1, 1), bool), 2, rate=0.2, l2=1.0, least=5, depth=3), rounds, BINS)
        # two classes mirror each other: the margin is the difference of their scores
        trees = [(f[0, 1].tolist(), c[0, 1].tolist(), [round(float(b - a), 6) for a, b in zip(v[0, 0], v[0, 1], strict=True)]) for f, c, v in zip(got.feature, got.bin, got.value, strict=True)]
        model = cls(trees, round(float(got.base[0, 1] - got.base[0, 0]), 6), 1.0, 0.0, [1.1] * len(KINDS))
        x, y = _sampled(spark, n_calibrate, seed + 1)
        margin = np.array([model.margin(row) for row in x.tolist()])
        model.slope, model.intercept = (round(v, 6) for v in _logistic(margin, y))
        p = np.array([model.probability(m) for m in margin])
        model.thresholds = [cls.threshold(p[x[:, 0] == k], y[x[:, 0] == k]) for k in range(len(KINDS))]
        return model

    @staticmethod
    def threshold(p: np.ndarray, y: np.ndarray) -> float:
        """The least probability, a half or more, at which the precision of what
        reaches it is as asked for; over 1 if there is none."""
        order = np.argsort(-p, kind="stable")
        p, right = p[order], np.cumsum(y[order]) / np.arange(1, len(p) + 1)
        last = np.append(p[1:] != p[:-1], True)  # ties go together
        ok = np.flatnonzero(last & (right >= PRECISION) & (p >= 0.5))
        return float(p[ok[-1]]) if len(ok) else 1.1

    def margin(self, x: list[int]) -> float:
        out = self.base
        for f, c, v in self.trees:
            node, depth = 0, int(math.log2(len(v)))
            for level in range(depth):
                at = node + (1 << level) - 1
                node = 2 * node + int(x[f[at]] > c[at])
            out += v[node]
        return out

    def probability(self, margin: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * margin + self.intercept))))

    def sql(self, x: str) -> str:
        """The probability of a proposal's features, as SQL."""
        trees = json.dumps([{"f": f, "c": c, "v": v} for f, c, v in self.trees])
        step = "2 * {n} + CAST({x}[t.f[{n} + {o}]] > t.c[{n} + {o}] AS INT)"
        leaf = _let(step.format(n="0", x="r", o=0), "n1", _let(step.format(n="n1", x="r", o=1), "n2", _let(step.format(n="n2", x="r", o=3), "n3", "t.v[n3]")))
        total = f"aggregate(from_json('{trees}', 'array<struct<f:array<int>,c:array<int>,v:array<double>>>'), CAST({self.base} AS DOUBLE), (s, t) -> s + {leaf})"
        z = f"greatest(-30D, least(30D, {self.slope}D * {_let(x, 'r', total)} + {self.intercept}D))"
        return f"1D / (1D + exp(-({z})))"


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, base, spans): base spans, and all spans, by kind and start."""
    model = model or Model.fit(docs.sparkSession)
    rows = proposals(base_spans(docs, id_col, text_col))
    limits = "array(" + ", ".join(f"{t}D" for t in model.thresholds) + ")"
    free = "filter(proposed, x -> NOT exists(base, y -> y.start < x.end AND x.start < y.end))"
    scored = f"transform({free}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'p', {model.sql('x.f')}))"
    passed = f"array_distinct(array_sort(filter({scored}, x -> x.p >= {limits}[x.kind])))"
    better = "y.start < x.end AND x.start < y.end AND named_struct('p', y.p, 's', -y.start, 'e', y.end, 'k', y.kind) > named_struct('p', x.p, 's', -x.start, 'e', x.end, 'k', x.kind)"
    kept = _let(passed, "a", f"transform(filter(a, (x, i) -> NOT exists(slice(a, greatest(i - {NEAR}, 0) + 1, 2 * {NEAR} + 1), y -> {better})), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))")
    rows = rows.withColumn("extra", F.when(F.size("proposed") > 0, F.expr(kept)).otherwise(F.expr(f"CAST(array() AS {_SPAN})")))
    return rows.select(id_col, "text", "base", F.array_sort(F.concat("base", "extra")).alias("spans"))


def redact(docs: DataFrame, **cols) -> DataFrame:
    """(id, text, n_spans): every span's characters replaced by its kind in
    brackets; of spans that overlap the first one names the replacement."""
    found = find(docs, **cols)
    order = "array_sort(transform(spans, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))"
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    text = f"""
CASE WHEN size(spans) = 0 THEN text ELSE {_let("text", "t", f'''aggregate({order}, named_struct('at', 0L, 'out', CAST(array() AS array<string>)), (a, s) ->
  CASE WHEN s.start < a.at THEN named_struct('at', greatest(a.at, s.end), 'out', a.out)
       ELSE named_struct('at', s.end, 'out', concat(a.out, array(substring(t, CAST(a.at + 1 AS INT), CAST(s.start - a.at AS INT)), {names}[s.kind]))) END,
  a -> concat(array_join(a.out, ''), substring(t, CAST(a.at + 1 AS INT))))''')} END"""
    return found.select(found.columns[0], F.expr(text).alias("text"), F.size("spans").alias("n_spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op12(docs: DataFrame) -> DataFrame:
    found = find(docs)
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = {k})) AS BIGINT) AS n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))

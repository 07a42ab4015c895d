"""Personal data: four fixed formats, and boosted trees over further candidates, in DataFrame expressions only.

Generators of high recall propose spans in the whole text, which may overlap each other and the fixed formats; each
gets format features (length, digits, letters, groups, separators, alternations, checksum) and context features (a word
for or against it before it, a quote); small boosted trees, trained here on a bounded synthetic sample (`SAMPLE`
candidates of each kind, look-alikes and ambiguous contexts included), score them; a threshold for each kind, the least
that has the wanted precision on a second sample, selects. Spans of the four fixed formats always stay; a selected
span inside one of them adds nothing and is left out. Selected spans may overlap; a redaction covers their union.

Positions are code points, end exclusive. The regular expressions are those of the formats with possessive loops and
a guard against starting inside a run, so that they stay linear and need no deep stack on very long texts. Null text
counts as empty: no spans. Repeated rows get equal spans; spans of equal places are in the order of KINDS; an empty
table gives no rows. Carried columns must not be named `base`, `spans`, `_texted` or `_` and a kind; `common.carry`
packs any columns under one name.
"""

from __future__ import annotations

import random
import re
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table

#: The kinds in order of output; the first four are the fixed formats.
KINDS = ("email", "ip", "card", "phone", "secret", "number", "iban")
_LOCAL = r"A-Za-z0-9._%+-"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Words before a candidate that speak for it, and against it.
FOR = {"secret": "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth", "number": "tel|phone|call|fax|mobile|cell|contact|ssn", "iban": "iban|account|bank|konto|compte|cuenta|transfer"}
AGAINST = {"secret": "commit|sha|md5|hash|checksum|digest|etag|revision|build|/", "number": "isbn|issn|page|version|order|figure|item|invoice|year", "iban": "serial|model|part|article"}
MORE = {
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+",
    "number": r"(?<![0-9A-Za-z_+/=.-])\(?[0-9](?:[ ().-]{0,2}[0-9]){8,18}+(?![0-9A-Za-z_+/=-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
}
#: What a candidate must have at all: a secret letters and digits, an IBAN its check digits.
PROPOSED = {
    "secret": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
    "number": lambda m: F.lit(True),
    "iban": lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34),
}
SAMPLE, TREES, DEPTH, RATE, PRECISION = 1500, 24, 3, 0.3, 0.98
CONTEXT, BLOCK = 24, 64
FEATURES = ("length", "digits", "upper", "lower", "hex", "groups", "keyword", "quote", "separators", "runs", "checksum", "noted")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


_NONE = "cast(array() as array<struct<start:int,end:int,m:string>>)"


def found(text: Column, pattern: str, fits) -> Column:
    """Array of (start, end, m): leftmost, non-overlapping matches that fit.

    A match starts after the gaps and matches before it. Their lengths are summed in blocks of BLOCK, so that a text of
    very many matches doesn't copy a growing array for each.
    """
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.zip_with(gaps, m, lambda g, x: F.struct(g.alias("g"), x.alias("m"), (g + F.coalesce(F.length(x), F.lit(0))).alias("n")))

    def total(block):
        return F.aggregate(block, F.lit(0), lambda n, x: n + x["n"])

    def places(block, at):
        def step(acc, x):
            start = acc["at"] + x["g"]
            one = F.array(F.struct(start.alias("start"), (acc["at"] + x["n"]).alias("end"), x["m"].alias("m")))
            return F.struct((acc["at"] + x["n"]).alias("at"), F.concat(acc["out"], one).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), F.expr(_NONE).alias("out")), step, lambda acc: acc["out"])

    def placed(blocks):
        sums = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, block: F.concat(acc, F.array(F.element_at(acc, -1) + total(block))))
        return F.flatten(F.zip_with(blocks, F.slice(sums, 1, F.size(sums) - 1), places))

    spans = _let(both, lambda x: _let(F.transform(F.sequence(F.lit(1), F.size(x), F.lit(BLOCK)), lambda i: F.slice(x, i, BLOCK)), placed))
    return F.when(text.rlike(pattern), F.filter(spans, lambda x: x["m"].isNotNull() & fits(x["m"]))).otherwise(F.expr(_NONE))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression inside a lambda would be computed at each call."""
    return F.element_at(F.transform(F.array(value), body), 1)


FITS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}

# --- boosted trees --------------------------------------------------------------------------------------------------


def features(m: str, before: str, kind: str) -> list[float]:
    """What `scored` computes in Spark, for training."""
    count = lambda p: len(re.findall(p, m))
    told = lambda p: float(bool(re.search(p, before.lower())))
    checked = float(kind == "iban" and remainder(m) == 1)
    return [len(m), count("[0-9]"), count("[A-Z]"), count("[a-z]"), float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", m))), count("[0-9]+"), told(FOR[kind]), float(before[-1:] in ("'", '"')), count("[^A-Za-z0-9]"), count("[A-Za-z][0-9]|[0-9][A-Za-z]"), checked, told(AGAINST[kind])]


def remainder(m: str) -> int:
    """An IBAN modulo 97, its first four characters last, letters as 10 to 35: 1 for a right one."""
    plain = m.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _examples(kind: str, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Synthetic candidates: half personal, half look-alikes; some contexts are ambiguous on either side."""
    r = random.Random(f"{kind}/{seed}")
    pick = lambda a, k: "".join(r.choice(a) for _ in range(k))
    low, mixed, digits = string.ascii_lowercase, string.ascii_letters + string.digits, string.digits
    word = lambda: pick(low, r.randint(2, 9))
    hexes = lambda: pick("0123456789abcdef", r.choice([32, 40, 64]))
    rows, labels = [], []
    for k in range(n):
        good = k % 2 == 0
        if kind == "secret" and good:
            m = r.choice([hexes, lambda: pick(mixed, r.randint(20, 48)), lambda: r.choice(["sk_", "pk-", "ghp_", "xoxb-"]) + pick(mixed, r.randint(20, 90)), lambda: pick(mixed + "+/", r.randint(24, 60)) + "=", lambda: r.choice(["", "ghp_", "key-"]) + pick(digits * 4 + low, r.randint(18, 40))])()
            before = r.choice(['token = "', "secret: ", "password='", "api_key=", 'auth: "', "the value ", " ", "key "])
        elif kind == "secret":
            m, before = r.choice([
                lambda: ("-".join(word() for _ in range(r.randint(3, 6))) + f"-{r.randint(1, 2030)}", "the page "), lambda: ("_".join(word() for _ in range(3)) + str(r.randint(0, 99)), "see "),
                lambda: (pick(low, r.randint(16, 30)) + str(r.randint(0, 9)), " "), lambda: ("=" * r.randint(8, 30) + str(r.randint(0, 9)) + "a=" * 4, "\n"), lambda: (f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{r.randint(10, 23)}-00-00", "on "),
                lambda: (hexes(), r.choice(["commit ", "sha1 ", "md5: ", "checksum ", "etag "])), lambda: ("/".join(word().title() for _ in range(4)) + str(r.randint(1, 9)), "file "), lambda: (word() + "".join(word().title() for _ in range(3)) + str(r.randint(1, 9)), "call "), lambda: (f"IMG_20{r.randint(10, 24)}0{r.randint(1, 9)}{r.randint(10, 28)}_{pick(digits, 6)}", "image "),
                lambda: (r.choice([hexes(), pick(mixed, r.randint(16, 40))]), r.choice([" ", "id ", "the value ", '"'])),
            ])()
        elif kind == "number" and good:
            a, b, c = pick("23456789", 1) + pick(digits, 2), pick(digits, 3), pick(digits, 4)
            m = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}-{b[:2]}-{c}", f"{c} {a}{b[0]} {c} {pick(digits, 4)}"])
            before = r.choice(["call ", "tel. ", "phone: ", " ", "ssn ", "on ", "order "])
        elif kind == "number":
            m, before = r.choice([
                lambda: (pick(digits, r.randint(9, 19)), r.choice([" ", "= ", "id "])), lambda: (f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}", r.choice(["on ", "\n"])), lambda: (" ".join(pick(digits, r.randint(1, 2)) for _ in range(r.randint(6, 9))), "pages "),
                lambda: (".".join(pick(digits, r.randint(1, 3)) for _ in range(r.randint(5, 8))), "v"), lambda: (f"{r.randint(1900, 2029)}-{r.randint(1900, 2029)} {r.randint(1, 9)}.{r.randint(0, 9)}", "in "), lambda: (f"978-{r.randint(0, 9)}-{pick(digits, 2)}-{pick(digits, 6)}-{r.randint(0, 9)}", r.choice(["isbn ", " "])), lambda: (f"{pick(digits, 3)}-{pick(digits, 3)}-{pick(digits, 4)}", "invoice "),
            ])()
        else:
            country = r.choice(["DE", "FR", "GB", "ES", "NL", "CH"])
            body = ("" if r.random() < 0.6 else pick(string.ascii_uppercase, 4)) + pick(digits, r.randint(11, 20))
            right = f"{98 - remainder(country + '00' + body):02d}"
            m = country + (right if good else pick(digits, 2)) + body
            m = " ".join(m[i : i + 4] for i in range(0, len(m), 4)) if r.random() < 0.5 else m
            before = r.choice(["iban ", "account: ", " ", "to "] if good else ["serial ", "model ", " ", "part ", "account "])
        rows.append(features(m, before, kind))
        labels.append(float(good))
    return np.array(rows), np.array(labels)


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, threshold, left, right) or a leaf's value."""
    leaf = float(g.sum() / (h.sum() + 1.0))
    best = (1e-6, None, None)
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[:-1] + values[1:]) / 2 if len(values) < 40 else np.unique(np.quantile(values, np.linspace(0.03, 0.97, 32))):
                left = x[:, f] <= t
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
                if gain > best[0]:
                    best = (gain, f, float(t))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1)


def evaluate(tree, row) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache
def model(kind: str):
    """(trees, threshold) of a kind: boosted on one sample; the threshold is the least of the wanted precision on another."""
    x, y = _examples(kind, SAMPLE, 1)
    score, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(x, y - p, p * (1 - p), DEPTH))
        score += RATE * np.array([evaluate(trees[-1], row) for row in x])
    x, y = _examples(kind, SAMPLE, 2)
    score = np.array([RATE * sum(evaluate(t, row) for t in trees) for row in x])
    return trees, calibrated(score, y)


def calibrated(score: np.ndarray, y: np.ndarray) -> float:
    """The least score from which on the share of personal candidates is PRECISION; equal scores stand or fall together."""
    levels = np.unique(score)[::-1]
    fine = [t for t in levels if y[score >= t].mean() >= PRECISION]
    if not fine:
        return float("inf")
    below = levels[levels < fine[-1]]
    return float((fine[-1] + below[0]) / 2) if len(below) else float(fine[-1])


def _case(tree, x: dict[int, Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(x[tree[0]] <= tree[1], _case(tree[2], x)).otherwise(_case(tree[3], x))


def scored(m: Column, before: Column, kind: str) -> Column:
    count = lambda c: F.length(F.regexp_replace(m, f"[^{c}]", "")).cast("double")
    many = lambda p: F.size(F.regexp_extract_all(m, F.lit(p), F.lit(0))).cast("double")
    told = lambda p: F.lower(before).rlike(p).cast("double")
    plain = F.replace(m, F.lit(" "), F.lit(""))
    letter = lambda x: F.ascii(x) >= 65
    rest = F.aggregate(F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), ""), F.lit(0), lambda n, x: F.when(x == "", n).otherwise((n * F.when(letter(x), 100).otherwise(10) + F.when(letter(x), F.ascii(x) - 55).otherwise(F.ascii(x) - 48)) % 97))
    checked = (rest == 1).cast("double") if kind == "iban" else F.lit(0.0)
    values = [F.length(m).cast("double"), count("0-9"), count("A-Z"), count("a-z"), m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"), many("[0-9]+"), told(FOR[kind]), before.rlike("['\"]$").cast("double"), F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")).cast("double"), many("[A-Za-z][0-9]|[0-9][A-Za-z]"), checked, told(AGAINST[kind])]
    trees = model(kind)[0]
    return _let(F.array(*values), lambda v: RATE * sum((_case(t, {i: F.element_at(v, i + 1) for i in range(len(values))}) for t in trees), F.lit(0.0)))


# --- operator -------------------------------------------------------------------------------------------------------

def detect(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, text, base and spans: arrays of (start, k, end) in order, k the number of the kind; and other columns."""
    text = F.coalesce("text", F.lit(""))
    df = documents(docs, *carried).select("doc_id", "text", *carried, *[found(text, BASE[k], FITS[k]).alias(f"_{k}") for k in BASE])

    def short(k, spans):
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(k)).alias("k"), x["end"].alias("end")))

    df = df.withColumn("base", F.array_sort(F.concat(*[short(k, F.col(f"_{k}")) for k in BASE]))).withColumn("_texted", text)
    df = df.select("doc_id", "text", *carried, "base", "_texted", *[found(F.col("_texted"), MORE[k], PROPOSED[k]).alias(f"_{k}") for k in MORE])

    def chosen(k):
        def before(x):
            return F.substring("_texted", F.greatest(x["start"] - CONTEXT + 1, F.lit(1)), F.least(x["start"], F.lit(CONTEXT)))

        fine = F.filter(f"_{k}", lambda x: _let(before(x), lambda b: scored(x["m"], b, k)) >= model(k)[1])
        new = F.filter(fine, lambda x: ~F.exists("base", lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"])))
        return short(k, F.when(F.size(f"_{k}") > 0, new).otherwise(F.expr(_NONE)))

    return df.select("doc_id", "text", *carried, "base", F.array_sort(F.concat("base", *[chosen(k) for k in MORE])).alias("spans"))


def replaced(text: Column, spans: Column, by) -> Column:
    """The text with `by(span, where the last one ended)` for each span; a span inside earlier ones gives nothing."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["end"] > acc["at"], F.concat(acc["out"], gap, by(s, acc["at"]))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    whole = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span's kind in brackets in its place; of spans that overlap, each that goes on further is named."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return replaced(text, spans, lambda s, at: F.element_at(names, s["k"] + 1))


def _told(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detect(table(spark, sf_dir, "documents"))
    count = lambda k, spans: F.size(F.filter(spans, lambda s: s["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *[count(k, "base") for k in BASE], F.sha2(_told("base"), 256).alias("base_sha256"), _told("spans").alias("spans"), *[count(k, "spans") for k in MORE], F.size("spans").cast("long").alias("n_spans"))

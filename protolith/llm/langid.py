"""Language identification in two steps: family first, then one-versus-one linear SVMs within the family.

Features are relative counts of hashed character trigrams of the lower-cased whole text. A linear SVM (squared hinge,
dual coordinate descent on the Gram matrix) separates each pair of families, then each pair of a family's languages;
votes decide, ties by the sum of margins, then by name. Training takes at most `per_language` labelled documents of each
language and `total` in all (those of lowest hash of doc_id), a documented bound; their features are counted where the
texts are, so no text reaches the driver. Prediction reads every whole text. A language absent from `FAMILIES` is a
family of its own.

A null text, or one without a letter (Unicode category L), is `und` with score 0. The score is the product of the
logistic values of the mean winning margins, so between 0 and 1. Repeated rows get equal answers; an empty table gives
no rows; other columns, whatever their names, play no part. With no labelled document every text with a letter is `und`
too; with one language, that language.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, groups_of, release, table, tidy

DIMENSIONS, CHUNK_CHARS = 1 << 13, 1 << 19
#: Bounds of the training sample: documents of one language, and of all; the Gram matrix has TOTAL rows at most.
PER_LANGUAGE, TOTAL = 500, 4000
#: A text of a lower score is like no learned language.
LEAST_SCORE = 0.25
#: The branch of each language code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "da", "sv", "no", "nb", "nn", "is", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "indo-aryan": ("hi", "bn", "ur", "pa", "mr", "gu", "ne"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "am", "mt"),
}
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    base = lang.split("-")[0].lower()
    return next((f for f, langs in FAMILIES.items() if base in langs), lang)


def hashes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1)
    h += c[1:-1] * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h += c[2:] * np.uint32(0xC2B2AE35)
    h *= np.uint32(0x27D4EB2F)
    return h >> np.uint32(19)


def weigh(texts: list[str], w: np.ndarray) -> np.ndarray:
    """The mean weight of each text's trigrams: texts x columns of w. Long texts go chunk by chunk."""
    out = np.zeros((len(texts), w.shape[1]))
    for i, j in groups_of([len(t) + 2 for t in texts], CHUNK_CHARS):
        padded = [f" {t.lower()} " for t in texts[i:j]]
        if j - i == 1 and len(padded[0]) > CHUNK_CHARS:
            t, total = padded[0], 0
            for at in range(0, len(t) - 2, CHUNK_CHARS):
                h = hashes(t[at : at + CHUNK_CHARS + 2])
                out[i] += w[h].sum(axis=0, dtype=np.float64)
                total += len(h)
            out[i] /= max(1, total)
            continue
        h = hashes("".join(padded))
        n = np.array([len(t) for t in padded])
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        v = w[np.append(h, [0, 0])].astype(np.float64)
        v[-2:] = 0
        # Trigrams over a border hold one text's end and the next one's start: they are left out.
        ends = np.cumsum(n)
        v[ends - 1] = 0
        v[ends - 2] = 0
        out[i:j] = np.add.reduceat(v, starts, axis=0) / np.maximum(1, n - 2)[:, None]
    return out


def counts(text: str) -> np.ndarray:
    h = hashes(f" {text.lower()} ")
    x = np.bincount(h, minlength=DIMENSIONS).astype(np.float32)
    return x / max(1, len(h))


def svm(gram: np.ndarray, y: np.ndarray, cost: float = 100.0, rounds: int = 30) -> np.ndarray:
    """Dual coefficients (alpha * y) of a squared-hinge linear SVM."""
    a, f = np.zeros(len(y)), np.zeros(len(y))
    diag = gram.diagonal() + 1 / (2 * cost)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            new = max(0.0, a[i] - (y[i] * f[i] - 1 + a[i] / (2 * cost)) / diag[i])
            if (step := new - a[i]) != 0:
                f += step * y[i] * gram[i]
                a[i] = new
                moved = max(moved, abs(step) * diag[i])
        if moved < 1e-3:
            break
    return a * y


def train(texts: list[str], langs: list[str]) -> dict:
    return train_on(np.stack([counts(t) for t in texts]) if texts else np.zeros((0, DIMENSIONS), np.float32), langs)


def train_on(x: np.ndarray, langs: list[str]) -> dict:
    """Weights of all classifiers, a column each, and what a column separates; x, a row of counts for each document, changes."""
    some = len(x) > 0
    mean = x.mean(axis=0) if some else np.zeros(DIMENSIONS, np.float32)
    scale = (1 / np.sqrt(np.maximum(x.var(axis=0), 1e-7)) / np.sqrt(DIMENSIONS)).astype(np.float32) if some else np.ones(DIMENSIONS, np.float32)
    x -= mean
    x *= scale
    gram = (x @ x.T).astype(np.float64) + 1
    names = sorted(set(langs))
    of = {n: family(n) for n in names}
    pairs, w, b = [], [], []

    def add(kind, p, q, group):
        y = np.array([1.0 if g == p else -1.0 if g == q else 0.0 for g in group])
        at = np.flatnonzero(y)
        k = np.zeros(len(y))
        k[at] = svm(gram[np.ix_(at, at)], y[at])
        v = (k.astype(np.float32) @ x) * scale
        pairs.append((kind, p, q))
        w.append(v)
        b.append(k.sum() - float(np.sum(mean * v)))

    for p, q in combinations(sorted(set(of.values())), 2):
        add("family", p, q, [of[n] for n in langs])
    for f in sorted(set(of.values())):
        for p, q in combinations([n for n in names if of[n] == f], 2):
            add(f, p, q, langs)
    return {"names": names, "of": of, "pairs": pairs, "w": np.array(w, np.float32).T if w else np.zeros((DIMENSIONS, 0), np.float32), "b": np.array(b)}


def _decide(model: dict, margins: np.ndarray) -> tuple[str, float]:
    def vote(kind, options):
        if len(options) == 1:
            return options[0], 1.0
        won, total, used = dict.fromkeys(options, 0), dict.fromkeys(options, 0.0), dict.fromkeys(options, 0)
        for (k, p, q), m in zip(model["pairs"], margins, strict=True):
            if k == kind:
                won[p if m >= 0 else q] += 1
                total[p] += m
                total[q] -= m
                used[p] += 1
                used[q] += 1
        best = max(sorted(options), key=lambda o: (won[o], total[o]))
        return best, 1 / (1 + np.exp(-2 * np.clip(total[best] / used[best], -30, 30)))

    f, s = vote("family", sorted(set(model["of"].values())))
    lang, t = vote(f, [n for n in model["names"] if model["of"][n] == f])
    return lang, float(s * t)


def predict(model: dict, texts: list[str | None]) -> list[tuple[str, float]]:
    at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model["names"] else []
    margins = weigh([texts[i] for i in at], model["w"]) + model["b"]
    out = [(UNKNOWN, 0.0)] * len(texts)
    for i, m in zip(at, margins, strict=True):
        out[i] = _decide(model, m)
    return out


def _counted(batches):
    schema = pa.schema([("lang", pa.string()), ("at", pa.binary()), ("x", pa.binary())])
    for b in batches:
        for i in range(0, b.num_rows, 64):
            part = b.slice(i, 64)
            found = [counts(t) for t in part.column(1).to_pylist()]
            at = [np.flatnonzero(c).astype("<i4") for c in found]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), pa.array([k.tobytes() for k in at], pa.binary()), pa.array([c[k].tobytes() for c, k in zip(found, at, strict=True)], pa.binary())], schema=schema)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> dict:
    """A model from at most so many documents of each language and of all; labelled has doc_id, text and lang."""
    known = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    many = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not many:
        return train([], [])
    each = max(1, min(per_language, total // len(many)))
    # Twice the bound by hash is ranked; each task keeps only the first of a language.
    h = F.xxhash64("doc_id")
    allowed = F.create_map(*[F.lit(x) for lang, n in many.items() for x in (lang, 2.0 * each / n)])
    drawn = known.filter(F.abs(h % 1_000_000) < F.element_at(allowed, F.col("lang")) * 1_000_000).select("lang", "text", h.alias("h"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    rows = drawn.withColumn("rank", rank).filter(F.col("rank") <= each).select("lang", "text").mapInArrow(_counted, "lang string, at binary, x binary").collect()
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["x"], "<f4")
    langs = [r["lang"] for r in rows]
    del rows
    model = train_on(x, langs)
    del x
    release()
    return model


def fit_counts(labelled: DataFrame) -> dict:
    """A model of the same form from the trigrams of every labelled document: log-odds of their shares, no sample.

    labelled has text and lang. Tasks count by language, and only counts are added up.
    """

    def run(batches):
        schema, of = pa.schema([("lang", pa.string()), ("n", pa.binary())]), {}
        told = lambda: pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array([n.tobytes() for n in of.values()], pa.binary())], schema=schema)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                padded = f" {text.lower()} "
                for at in range(0, len(padded) - 2, CHUNK_CHARS):
                    n = np.bincount(hashes(padded[at : at + CHUNK_CHARS + 2]), minlength=DIMENSIONS)
                    of[lang] = of[lang] + n if lang in of else n
            if len(of) > 256:
                yield told()
                of.clear()
        if of:
            yield told()

    def add(t):
        total = sum(np.frombuffer(n, np.int64) for n in t.column("n").to_pylist())
        return pa.table({"lang": t.column("lang")[:1], "n": pa.array([total.tobytes()], pa.binary())})

    known = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    found = known.mapInArrow(tidy(run), "lang string, n binary").groupBy("lang").applyInArrow(add, "lang string, n binary").collect()
    n = {r["lang"]: np.frombuffer(r["n"], np.int64) for r in found}
    names = sorted(n)
    of = {k: family(k) for k in names}
    log = lambda x: np.log((x + 1) / (x.sum() + DIMENSIONS))
    families = sorted(set(of.values()))
    pairs, w = [], []
    for kind, counts_of in [("family", {f: sum(n[k] for k in names if of[k] == f) for f in families}), *[(f, {k: n[k] for k in names if of[k] == f}) for f in families]]:
        for p, q in combinations(sorted(counts_of), 2):
            pairs.append((kind, p, q))
            w.append(log(counts_of[p]) - log(counts_of[q]))
    return {"names": names, "of": of, "pairs": pairs, "w": np.array(w, np.float32).T if w else np.zeros((DIMENSIONS, 0), np.float32), "b": np.zeros(len(w))}


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, text, lang_pred and score of every document."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang_pred", pa.string()), ("score", pa.float64())])
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                found = predict(model, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], schema=schema)

    return documents(docs).mapInArrow(tidy(run), "doc_id long, text string, lang_pred string, score double")


def accepted(docs: DataFrame, model: dict, languages: list[str] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is one of `languages` (None: any learned one) with a score of `least` or more.

    All columns stay; a null lang, where there is that column, becomes the language found. Without a model (no labelled
    row) nothing can be told apart: texts with a letter stay as they are.
    """
    names, kinds = docs.columns, docs.schema
    known = bool(model["names"])

    def run(batches):
        at = names.index("text")
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = part.column(at).cast(pa.string()).to_pylist()
                found = predict(model, texts) if known else [(None, 1.0) if t and _LETTER.search(t) else (UNKNOWN, 0.0) for t in texts]
                fine = pa.array([x[0] != UNKNOWN and x[1] >= least and (languages is None or x[0] is None or x[0] in languages) for x in found], pa.bool_())
                if "lang" in names and pa.types.is_string(part.schema.field("lang").type):
                    k = names.index("lang")
                    told = pa.array([was if was is not None else x[0] for was, x in zip(part.column(k).to_pylist(), found, strict=True)], pa.string())
                    part = part.set_column(k, part.schema.field(k), told)
                yield part.filter(fine)

    return docs.mapInArrow(tidy(run), kinds)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def model_of(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """Learns from the documents that aren't held out."""
    return fit(documents(docs, F.col("lang").cast("string").alias("lang")).filter(~F.coalesce(held_out(), F.lit(True))), per_language)


def counted_model_of(docs: DataFrame) -> dict:
    """`fit_counts` of the documents that aren't held out."""
    return fit_counts(documents(docs, F.col("lang").cast("string").alias("lang")).filter(~F.coalesce(held_out(), F.lit(True))))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, model_of(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")

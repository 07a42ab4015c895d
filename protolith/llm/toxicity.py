"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are runs of letters (A-Z lower-cased; bytes over 127 are letters). A word's embedding is the sum of the hashed
embeddings of the word and of its first 4 and 6 bytes, which inflected words share. Filters of widths 1, 2 and 3 run
over a text's words, each filter keeps its greatest response in the whole text, and a linear layer of these gives the
raw score. Training is by Adagrad on batches; one dimension of an embedding starts at the log-odds of the word among all
toxic documents. Thresholds are calibrated by language on documents that training doesn't see: a logistic model of the
raw score with an offset for each language, shrunk towards none, at the labels' own shares, so that a score of 0.5 is
each language's threshold. A text's language is what `langid` reads in it, by counts of all documents.

Every labelled document is learned from, whole: an eighth calibrates, the others train. Tasks train on shares of them
from one net, round by round, and the nets are averaged after each round: an embedding over the tasks that met its word,
in proportion to their documents. Up to `SHARE` bytes of text are one task's, so that few documents are learned in plain
order; there are `MOST_SHARES` tasks at most, which bounds what is averaged and not what is read. A task holds a block
of `SHARE` bytes at a time. Sums of thresholds are exact, by language, and no document's values reach the driver. Of a
text above `CHUNK` bytes training keeps what the filters answer to most. Scoring reads every whole text, long ones piece
by piece.

A null text counts as empty, and texts without a word are scored like padding. Of repeated rows of `labels` the greatest
label holds; labels that are null, or not 0 or 1, aren't used. Repeated documents get equal scores. Without labels of
both kinds all scores are the share of toxic ones among the labels, or 0. An empty table gives no rows, other columns
play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import deepcopy
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from .common import documents, forget, groups_of, materialize, release, table, tidy
from .hashing import BASE, INVERSE, mix, powers

#: Rows and columns of the embeddings, filters of each width, bytes of text that are held at once.
BUCKETS, SIZE, FILTERS, WIDTHS, CHUNK = 1 << 18, 8, 8, (1, 2, 3), 1 << 20
#: Bytes of text that a task holds, the most tasks, rounds, passes of a round over each block, and parts of an averaged net.
SHARE, MOST_SHARES, ROUNDS, PASSES, PARTS = 12 << 20, 64, 2, 3, 64
#: Texts and words of a batch, labels that are broadcast (more are joined by a shuffle).
BATCH, BATCH_WORDS, BROADCAST = 64, 1 << 17, 4_000_000
PREFIXES = (4, 6)
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def buckets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The embeddings' rows of each word, a row of three for each, and the words' starts."""
    text = np.frombuffer(data.translate(_LETTERS), np.uint8)
    n = len(text)
    space = np.ones(n + 2, bool)
    space[1:-1] = text == 32
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = 1 << max(12, n.bit_length())
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(size, BASE)[:n], out=total[1:])
    back = powers(size, INVERSE)[starts]
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    for k, most in enumerate((n, *PREFIXES)):
        h = (total[np.minimum(starts + most, ends)] - total[starts]) * back + np.uint64(k + 1)
        out[:, k] = mix(h) >> np.uint64(64 - 18)
    return out, starts


def pieces(raw: bytes) -> Iterator[np.ndarray]:
    """The rows of a text's words, piece by piece; each piece begins with the last words of the one before."""
    at, before = 0, None
    while at < len(raw) or before is None:
        end = at + CHUNK
        if end < len(raw):
            spaces = raw[at:end].translate(_LETTERS).rfind(32)
            end = at + spaces + 1 if spaces >= 0 else end
        own = buckets(raw[at:end])[0]
        if before is not None:
            own = np.concatenate([before, own])
        yield own
        before, at = own[len(own) - max(WIDTHS) + 1 :] if len(own) >= max(WIDTHS) else own, end


class Net:
    """The classifier: `e` embeddings (the last row is the padding's, zero), `w` filters, `b`, `u` and `c` the rest."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.e = (rng.standard_normal((BUCKETS + 1, SIZE)) * 0.02).astype(np.float32)
        self.e[BUCKETS] = 0
        self.w = (rng.standard_normal((sum(WIDTHS), SIZE, FILTERS)) / np.sqrt(SIZE)).astype(np.float32)
        self.w[:, 0] = np.abs(self.w[:, 0])
        self.b, self.u, self.c = np.full(n, -0.1, np.float32), np.full(n, 0.2, np.float32), np.float32(-1)

    def responses(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' embeddings and each filter's response at each word, reading on to the right; padded by zeros."""
        k = max(WIDTHS) - 1
        x = np.zeros((len(rows) + k, SIZE), np.float32)
        x[: len(rows)] = np.take(self.e, rows[:, 0], axis=0)
        for j in range(1, rows.shape[1]):
            x[: len(rows)] += np.take(self.e, rows[:, j], axis=0)
        # Products of 8 terms: BLAS adds longer ones in an order that depends on a row's place, and equal texts must score equally.
        each = x @ self.w.transpose(1, 0, 2).reshape(SIZE, -1)
        out, at = np.empty((len(rows), FILTERS * len(WIDTHS)), np.float32), 0
        for i, width in enumerate(WIDTHS):
            part = out[:, FILTERS * i : FILTERS * (i + 1)]
            for j in range(width):
                add = each[j : j + len(rows), FILTERS * (at + j) : FILTERS * (at + j + 1)]
                part[:] = add if j == 0 else part + add
            at += width
        return x, out

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.b, 0) @ self.u + self.c


def padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one behind the other, with padding behind each (an empty text is padding), and where each starts and ends."""
    pad = np.full((max(WIDTHS) - 1, 1 + len(PREFIXES)), BUCKETS, np.int32)
    own = [d if len(d) else pad[:1] for d in docs]
    rows = np.concatenate([x for d in own for x in (d, pad)])
    ends = np.cumsum([len(d) + len(pad) for d in own])
    return rows, ends - len(pad) - np.array([len(d) for d in own]), ends - len(pad)


def pooled(net: Net, docs: list[np.ndarray]) -> np.ndarray:
    rows, starts, ends = padded(docs)
    out = net.responses(rows)[1]
    return np.maximum.reduceat(out, np.stack([starts, ends], axis=1).ravel(), axis=0)[::2]


class Pace:
    """Adagrad's sums of squared gradients; those of embeddings are means over their dimensions."""

    def __init__(self, net: Net):
        self.of = {k: np.full_like(getattr(net, k), 1e-2) for k in ("w", "b", "u")}
        self.rows, self.c = np.full(BUCKETS + 1, 1e-2, np.float32), 1e-2


def begun(counts: np.ndarray, many: tuple[int, int]) -> Net:
    """A net whose words start at their log-odds; counts has the documents that hold a word, by label, many those of each label."""
    net = Net()
    odds = np.log((counts[1] + 0.5) / (many[1] + 1)) - np.log((counts[0] + 0.5) / (many[0] + 1))
    net.e[:-1, 0] = np.clip(odds * counts.sum(axis=0) / (counts.sum(axis=0) + 10), -4, 4) / 4
    return net


def batches_of(order: np.ndarray, docs: list[np.ndarray]) -> Iterator[np.ndarray]:
    for at in range(0, len(order), BATCH):
        which = order[at : at + BATCH]
        for i, j in groups_of([len(docs[k]) for k in which], BATCH_WORDS):
            yield which[i:j]


def improve(net: Net, pace: Pace, docs: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, rate: float = 0.1) -> None:
    """A pass of training over the documents, in random order."""
    k = len(net.b)
    first = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])
    for which in batches_of(rng.permutation(len(docs)), docs):
        rows, starts, ends = padded([docs[i] for i in which])
        x, out = net.responses(rows)
        top = np.stack([s + out[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
        h = out[top, np.arange(k)] + net.b
        act = np.maximum(h, 0)
        z = act @ net.u + net.c
        dz = ((1 / (1 + np.exp(-z)) - y[which]) / len(which)).astype(np.float32)
        dh = dz[:, None] * net.u * (h > 0)
        grads = {"u": act.T @ dz, "b": dh.sum(axis=0), "w": np.zeros_like(net.w)}
        where, step = [], []
        for i, width in enumerate(WIDTHS):
            cols = slice(FILTERS * i, FILTERS * (i + 1))
            for j in range(width):
                place, d = top[:, cols] + j, dh[:, cols]
                grads["w"][first[i] + j] = np.einsum("bfd,bf->df", x[np.minimum(place, len(x) - 1)], d)
                where.append(place.ravel())
                step.append((d[:, :, None] * net.w[first[i] + j].T).reshape(-1, SIZE))
        where, step = np.concatenate(where), np.concatenate(step)
        some = (where < len(rows)) & (step != 0).any(axis=1)
        hit = rows[where[some]]
        to, inverse = np.unique(hit.ravel(), return_inverse=True)
        total = np.zeros((len(to), SIZE), np.float32)
        np.add.at(total, inverse, np.repeat(step[some], hit.shape[1], axis=0))
        pace.rows[to] += (total**2).mean(axis=1)
        net.e[to] -= rate * total / np.sqrt(pace.rows[to])[:, None]
        net.e[BUCKETS] = 0
        for name, g in grads.items():
            pace.of[name] += g**2
            setattr(net, name, getattr(net, name) - rate * g / np.sqrt(pace.of[name]))
        pace.c += float(dz.sum()) ** 2
        net.c = np.float32(net.c - rate * dz.sum() / np.sqrt(pace.c))


def read(net: Net, raw: bytes) -> np.ndarray:
    """The rows of a text's words; of a long text those that each filter answers to most, with padding between them."""
    if len(raw) <= CHUNK:
        return buckets(raw)[0]
    best, won = np.full(len(net.b), -np.inf), [np.empty((0, 1 + len(PREFIXES)), np.int32)] * len(net.b)
    for p in pieces(raw):
        if len(p):
            out = net.responses(p)[1]
            at = out.argmax(axis=0)
            for k in np.flatnonzero(out[at, np.arange(len(at))] > best):
                best[k], won[k] = out[at[k], k], p[at[k] : at[k] + WIDTHS[k // FILTERS]].copy()
    pad = np.full((max(WIDTHS) - 1, 1 + len(PREFIXES)), BUCKETS, np.int32)
    return np.concatenate([x for w in won for x in (w, pad)])


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Hashes, labels and texts, up to SHARE bytes of them, by hash."""
    block, size = [], 0
    for b in batches:
        for h, toxic, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            raw = (text or "").encode()
            if block and size + len(raw) > SHARE:
                yield sorted(block)
                block, size = [], 0
            block.append((h, toxic, raw))
            size += len(raw)
    if block:
        yield sorted(block)


def counted(known: DataFrame, shares: int) -> np.ndarray:
    """How many documents of each label hold each word."""

    def run(batches):
        n = np.zeros((2, BUCKETS), np.int64)
        for block in blocks_of(batches):
            for _, toxic, raw in block:
                # Of an index that is there more than once one is added.
                found = [p.ravel() for p in pieces(raw)] if len(raw) <= CHUNK else [np.unique(p) for p in pieces(raw)]
                n[toxic][np.concatenate(found)] += 1
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(PARTS), pa.int32()), "data": pa.array([p.tobytes() for p in np.split(n, PARTS, axis=1)], pa.binary())})

    def add(t):
        total = sum(np.frombuffer(d, np.int64) for d in t.column("data").to_pylist())
        return pa.table({"at": t.column("at")[:1], "data": pa.array([total.tobytes()], pa.binary())})

    parts = known.coalesce(shares).mapInArrow(tidy(run), "at int, data binary").groupBy("at").applyInArrow(add, "at int, data binary").collect()
    return np.concatenate([np.frombuffer(r["data"], np.int64).reshape(2, -1) for r in sorted(parts)], axis=1) if parts else np.zeros((2, BUCKETS), np.int64)


_DENSE = ("w", "b", "u")


def improved(known: DataFrame, net: Net, pace: Pace, number: int, shares: int) -> tuple[Net, Pace]:
    """A round of training in tasks, each from this net, and the mean of their nets."""

    sent = known.sparkSession.sparkContext.broadcast((net, pace))

    def run(batches):
        (own, pace), docs = deepcopy(sent.value), 0  # a worker keeps the value for its next task
        before, paced = own.e[:-1].copy(), pace.rows[:-1].copy()
        for k, block in enumerate(blocks_of(batches)):
            words, y = [read(own, raw) for *_, raw in block], np.array([t for _, t, _ in block], float)
            rng = np.random.default_rng((3, number, k))
            for _ in range(PASSES):
                improve(own, pace, words, y, rng)
            docs += len(block)
        if not docs:
            return
        met = np.flatnonzero((own.e[:-1] != before).any(axis=1) | (pace.rows[:-1] != paced))
        rows = np.concatenate([own.e[met], pace.rows[met, None]], axis=1, dtype=np.float32)
        cut = np.searchsorted(met, np.arange(PARTS + 1) * (BUCKETS // PARTS))
        rest = np.concatenate([*(getattr(own, n).ravel() for n in _DENSE), *(pace.of[n].ravel() for n in _DENSE), [own.c, pace.c]], dtype=np.float64)
        data = [rows[i:j].tobytes() for i, j in pairwise(cut)] + [rest.tobytes()]
        which = [met[i:j].astype(np.int32).tobytes() for i, j in pairwise(cut)] + [b""]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(PARTS + 1), pa.int32()), "task": pa.array([TaskContext.get().partitionId()] * len(data), pa.int32()), "docs": pa.array([docs] * len(data), pa.int64()), "which": pa.array(which, pa.binary()), "data": pa.array(data, pa.binary())})

    def mean(t):
        at, found = t.column("at")[0].as_py(), sorted(zip(*(t.column(c).to_pylist() for c in ("task", "docs", "which", "data")), strict=True))
        if at == PARTS:
            which, out = b"", sum(n * np.frombuffer(d, np.float64) for _, n, _, d in found) / sum(n for _, n, *_ in found)
        else:
            first, total, many = at * (BUCKETS // PARTS), np.zeros((BUCKETS // PARTS, SIZE + 1)), np.zeros(BUCKETS // PARTS)
            for _, n, k, d in found:
                k = np.frombuffer(k, np.int32) - first
                total[k] += n * np.frombuffer(d, np.float32).reshape(-1, SIZE + 1).astype(np.float64)
                many[k] += n
            met = np.flatnonzero(many)
            which, out = (first + met).astype(np.int32).tobytes(), (total[met] / many[met, None]).astype(np.float32)
        return pa.table({"at": t.column("at")[:1], "which": pa.array([which], pa.binary()), "data": pa.array([out.tobytes()], pa.binary())})

    parts = known.coalesce(shares).mapInArrow(tidy(run), "at int, task int, docs long, which binary, data binary").groupBy("at").applyInArrow(mean, "at int, which binary, data binary").collect()
    sent.destroy()
    out, kept, at = Net(), Pace(net), 0
    out.e[:], kept.rows[:] = net.e, pace.rows
    for r in parts:
        if r["at"] == PARTS:
            rest = np.frombuffer(r["data"], np.float64)
        else:
            which, rows = np.frombuffer(r["which"], np.int32), np.frombuffer(r["data"], np.float32).reshape(-1, SIZE + 1)
            out.e[which], kept.rows[which] = rows[:, :SIZE], rows[:, SIZE]
    for to in (lambda n, v: setattr(out, n, v), kept.of.__setitem__):
        for n in _DENSE:
            was = getattr(net, n)
            to(n, rest[at : at + was.size].reshape(was.shape).astype(np.float32))
            at += was.size
    out.c, kept.c = np.float32(rest[at]), float(rest[at + 1])
    return out, kept


#: Sums of a logistic model over the rows of a language: of the error, of it times x, of the variance, of it times x and x squared.
_SUMS = {"g": "(p - y)", "gx": "(p - y) * x", "h": "p * (1 - p)", "hx": "p * (1 - p) * x", "hxx": "p * (1 - p) * x * x"}


def newton(names: list[str], sums: Callable[[float, dict[str, float]], dict[str, tuple]], ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Slope, offset and an offset for each language; sums has those of `_SUMS` by language, at a slope and each language's offset."""
    n = len(names)
    theta = np.zeros(2 + n)
    theta[0] = 1
    keep = np.array([0.05, 0.05, *[ridge] * n])
    for _ in range(rounds):
        of = sums(theta[0], dict(zip(names, theta[1] + theta[2:], strict=True)))
        g, gx, h, hx, hxx = np.array([of[v] for v in names], float).T
        hess = np.zeros((2 + n, 2 + n))
        hess[0, 0], hess[1, 1], hess[0, 1], hess[0, 2:], hess[1, 2:] = hxx.sum(), h.sum(), hx.sum(), hx, h
        hess += np.triu(hess, 1).T
        hess[range(2, 2 + n), range(2, 2 + n)] = h
        step = np.linalg.solve(hess + np.diag(keep), np.array([gx.sum(), g.sum(), *g]) + keep * theta)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return theta


def _thresholds(theta: np.ndarray, names: list[str], centre: float, spread: float) -> dict:
    return {"slope": max(theta[0], 1e-3) / spread, "centre": centre, "offset": theta[1], "by": dict(zip(names, theta[2:], strict=True))}


def calibrate(raw: np.ndarray, y: np.ndarray, weight: np.ndarray, langs: list[str]) -> dict:
    """Slope, offset and an offset for each language, by Newton's method."""
    names, own = sorted(set(langs)), np.array(langs)
    centre, spread = float(raw.mean()), float(raw.std()) or 1.0
    x = (raw - centre) / spread

    def sums(slope, offsets):
        p = 1 / (1 + np.exp(-np.clip(slope * x + np.array([offsets[v] for v in langs]), -40, 40)))
        terms = [(p - y) * weight, (p - y) * weight * x, p * (1 - p) * weight, p * (1 - p) * weight * x, p * (1 - p) * weight * x * x]
        return {v: tuple(t[own == v].sum() for t in terms) for v in names}

    return _thresholds(newton(names, sums), names, centre, spread)


def calibrated(judged: DataFrame) -> dict:
    """`calibrate` of a table of raw, toxic and lang, each of weight 1; the sums are decimals, so the order of rows plays no part."""
    exact = lambda e: F.sum(e.cast("decimal(38,15)"))
    total = judged.agg(F.count("*").alias("n"), exact(F.col("raw")).alias("s"), exact(F.col("raw") * F.col("raw")).alias("q")).first()
    centre = float(total["s"]) / total["n"]
    spread = float(np.sqrt(max(0.0, float(total["q"]) / total["n"] - centre**2))) or 1.0
    names = sorted(r["lang"] for r in judged.select("lang").distinct().collect())

    def sums(slope, offsets):
        each = F.create_map(*[F.lit(v) for kv in offsets.items() for v in (kv[0], float(kv[1]))])
        x = (F.col("raw") - centre) / spread
        z = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.lit(float(slope)) * F.col("x") + F.element_at(each, F.col("lang"))))
        rows = judged.select("lang", F.col("toxic").alias("y"), x.alias("x")).withColumn("p", 1 / (1 + F.exp(-z)))
        return {r["lang"]: tuple(float(r[k]) for k in _SUMS) for r in rows.groupBy("lang").agg(*[exact(F.expr(e)).alias(k) for k, e in _SUMS.items()]).collect()}

    return _thresholds(newton(names, sums), names, centre, spread)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Hash, label and text of every document that has a label, its bytes, and whether training leaves it to the thresholds."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    few = materialize(known)
    both = docs.join(F.broadcast(few) if few.count() <= BROADCAST else few, "doc_id")
    h = F.xxhash64("doc_id")
    text = F.coalesce("text", F.lit(""))
    return materialize(both.select(h.alias("h"), "toxic", text.alias("text"), F.octet_length(text).cast("long").alias("bytes"), (F.pmod(F.xxhash64(h), F.lit(8)) == 0).alias("apart")))


def learn(known: DataFrame, language: dict) -> dict:
    """A net, and thresholds calibrated on an eighth of the documents that the net didn't learn from."""
    many = {(r["toxic"], r["apart"]): r for r in known.groupBy("toxic", "apart").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    n = lambda *which: sum(many[k]["n"] for k in which if k in many)
    toxic, clean = n((1, True), (1, False)), n((0, True), (0, False))
    if not toxic or not clean:
        return {"net": None, "share": toxic / max(1, toxic + clean)}
    split = min(n((t, a)) for t in (0, 1) for a in (True, False)) >= 2
    train, test = (known.filter("not apart"), known.filter("apart")) if split else (known, known)
    train = train.select("h", "toxic", "text")
    shares = min(MOST_SHARES, -(-max(1, sum(r["bytes"] for k, r in many.items() if not (split and k[1]))) // SHARE))
    net = begun(counted(train, shares), (n((0, False)), n((1, False))) if split else (clean, toxic))
    pace = Pace(net)
    for number in range(ROUNDS):
        net, pace = improved(train, net, pace, number, shares)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in langid.predict(language, texts)], pa.string()), pa.array(raws(net, texts), pa.float64())], names=["toxic", "lang", "raw"])

    judged = materialize(test.select("toxic", "text").mapInArrow(tidy(run), "toxic int, lang string, raw double"))
    return {"net": net, "share": toxic / (toxic + clean), "thresholds": calibrated(judged)}


def raws(net: Net, texts: list[str]) -> np.ndarray:
    """The raw score of each text."""
    raw, encoded = np.empty(len(texts)), [t.encode() for t in texts]
    for i, j in groups_of([len(r) + 1 for r in encoded], CHUNK):
        if j - i == 1:
            raw[i] = net.raw(np.max([pooled(net, [p])[0] for p in pieces(encoded[i])], axis=0)[None])[0]
            continue
        rows, starts = buckets(b" ".join(encoded[i:j]))
        cut = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in encoded[i:j]]))
        raw[i:j] = net.raw(pooled(net, [rows[a:b] for a, b in pairwise([0, *cut])]))
    return raw


def score(model: dict, texts: list[str], langs: list[str]) -> np.ndarray:
    """Between 0 and 1 for each text; langs are the languages read in them."""
    net = model["net"]
    if net is None:
        return np.full(len(texts), model["share"])
    t = model["thresholds"]
    z = t["slope"] * (raws(net, texts) - t["centre"]) + t["offset"] + np.array([t["by"].get(v, 0.0) for v in langs])
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def scored(docs: DataFrame, model: dict, language: dict) -> DataFrame:
    """doc_id, lang_read and score of every document."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("lang_read", pa.string()), ("score", pa.float64())])
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                langs = [x[0] for x in langid.predict(language, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(score(model, texts, langs))], schema=schema)

    return documents(docs).mapInArrow(tidy(run), "doc_id long, lang_read string, score double")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def model_of(docs: DataFrame, labels: DataFrame) -> tuple[dict, dict]:
    """The classifier and the language model, from documents that aren't held out."""
    language = langid.counted_model_of(docs)
    own = labels.select("doc_id", "toxic").filter(~F.coalesce(held_out(), F.lit(True)))
    known = labelled(documents(docs), own)
    model = learn(known, language)
    forget(known)
    release()
    return model, language


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, *model_of(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang_read")

"""Best-fit packing: pieces of tokenised documents into as few sequences as possible.

A document is its token ids and then `END`; only documents over `capacity` tokens are cut, into full pieces and a
last one. Bins have three residual capacities: tokens, documents and attention cost (the sum of squared lengths).
Vector best-fit takes pieces longest first and picks, of the open bins that hold the piece under every constraint,
the one whose residual is best: least weighted residual norm after the piece, or greatest weighted dot-product of the
piece with the residual. A new bin is opened only where none fits.

Pieces of one length are alike, so the packer sees a histogram (at most `capacity` lengths) and keeps bins of one
state as one group with a multiplicity: its memory and time don't grow with the corpus. The plan is a list of runs,
"pieces of length n with ranks [lo, hi) go c to a bin from sequence s on, at offset o". Ranks come from one range
shuffle by length, whose sorted parts count themselves, so no length, however frequent, meets in one task.

At the defaults only tokens can bind (at most `capacity` documents and `capacity`**2 cost fit as many tokens), so the
other two only steer the choice among bins; `most_docs` and `most_cost` make them bind.

Null and empty texts are a piece of one token (END). Repeated rows are packed each for itself; among equal lengths the
order is by hash of doc_id, then piece. A null doc_id is kept. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, groups_of, materialize, release, table, tidy

CAPACITY, END = 4096, 1
VOCABULARY = "word_bpe_49k.json"
#: Words that a worker remembers at once.
CACHE_WORDS, CHUNK_CHARS = 800_000, 1 << 20
#: Rows of shifts and runs (six numbers at most) that are broadcast; beyond, they are joined by shuffles.
BROADCAST_ROWS = 500_000

# --- tokens ---------------------------------------------------------------------------------------------------------

_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_DIGIT = "0-9²³¹¼-¾"
#: The vocabulary's own split, for characters up to U+017F; a text with others is left to the library.
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\t-\r \x85\xa0{_LETTER}{_DIGIT}]+")
_OTHER = re.compile(r"[^\x00-ſ]|<\|")


class _Words(dict):
    """Word -> its ids as little-endian 32-bit bytes, by the library when first seen."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.left_out = encode, 0

    def __missing__(self, word):
        return np.array(self.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, texts: list[list[str]]) -> dict:
        """The ids of all words of the texts: new ones are encoded in one call, and remembered while there is room.

        When as many words have been left out as are remembered, others are frequent now, and all are forgotten.
        """
        new = [w for w in set().union(*texts) if w not in self]
        if not new:
            return self
        if self.left_out > CACHE_WORDS:
            self.clear()
            self.left_out = 0
        found = self.encode(" ".join(new), add_special_tokens=False)
        word = np.array(found.word_ids)
        if word[-1] + 1 != len(new):  # a word that isn't one to the library
            return self
        ids, cut = np.array(found.ids, "<u4"), np.searchsorted(word, np.arange(len(new) + 1))
        data, cut = ids.tobytes(), (4 * cut).tolist()
        more = {w: data[i:j] for w, i, j in zip(new, cut, cut[1:], strict=False)}
        if len(self) + len(more) <= CACHE_WORDS:
            self.update({w: x for w, x in more.items() if len(w) < 64})
            return self if all(len(w) < 64 for w in new) else _Both(self, more)
        self.left_out += len(more)
        return _Both(self, more)


class _Both:
    def __init__(self, first, second):
        self.first, self.second = first, second

    def __getitem__(self, word):
        return self.second[word] if word in self.second else self.first[word]


@lru_cache(1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t, _Words(t.encode)


def encode_all(texts: list[str], path: str) -> list[bytes]:
    """The ids of whole texts, as the library gives them, as little-endian 32-bit bytes."""
    t, words = _tokenizer(path)
    split = [None if _OTHER.search(x) else _WORD.findall(x.lower()) for x in texts]
    known = words.learn([w for w in split if w is not None])
    return [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() if w is None else b"".join(map(known.__getitem__, w)) for x, w in zip(texts, split, strict=True)]


def encode(text: str, path: str) -> bytes:
    return encode_all([text], path)[0]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        where = path or vocabulary()
        release()
        for b in batches:
            out, docs_, texts = [], b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            whole = (ids + end for i, j in groups_of([len(t) for t in texts], CHUNK_CHARS) for ids in encode_all(texts[i:j], where))
            for doc, ids in zip(docs_, whole, strict=True):
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype(np.int32),) if with_ids else ()))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
    return documents(docs).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


# --- plan -----------------------------------------------------------------------------------------------------------


def plan(counts: dict[int, int], capacity: int = CAPACITY, most_docs: int | None = None, most_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), score: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank_lo, rank_hi, per_bin, first sequence, offset) for so many pieces of each length."""
    limit = np.array([capacity, most_docs or capacity, most_cost or float(capacity) ** 2], float)
    w = np.array(weights, float)
    #: Open groups: residuals (a row each), first sequence and number of bins; all bins of a group are alike.
    res, first, many = np.empty((64, 3)), np.empty(64, np.int64), np.empty(64, np.int64)
    size, runs, bins = 0, [], 0

    def add(r, s, m):
        nonlocal res, first, many, size
        if size == len(res):
            res, first, many = np.resize(res, (2 * size, 3)), np.resize(first, 2 * size), np.resize(many, 2 * size)
        res[size], first[size], many[size] = r, s, m
        size += 1

    for n in sorted(counts, reverse=True):
        left, rank = counts[n], 0
        need = np.array([n, 1, float(n) ** 2])
        if (need > limit).any():
            raise ValueError(f"a piece of {n} tokens fits no empty sequence")
        while left:
            fit = np.flatnonzero((res[:size] >= need).all(axis=1))
            if len(fit):
                r = res[fit]
                worth = -((((r - need) / limit) ** 2) @ w) if score == "norm" else ((r / limit) * (need / limit)) @ w
                g = fit[np.argmax(worth)]
                r, s, m = res[g].copy(), first[g], many[g]
            else:
                g, r, s, m = -1, limit, bins, None
            per = int(min(r // need))
            # Residual norm refills the bin just chosen until it is full; the dot-product may prefer another after one.
            per = 1 if score != "norm" else per
            m = -(-left // per) if m is None else m
            full = min(m, left // per)
            last = 1 if full < m and left - full * per else 0
            if g < 0:
                bins += m
            else:
                size -= 1
                if g != size:  # the last group fills the gap
                    res[g], first[g], many[g] = res[size], first[size], many[size]
            offset = int(capacity - r[0])
            for k, c, at in ((full, per, s), (last, left - full * per if last else 0, s + full)):
                if k:
                    runs.append((int(n), int(rank), int(rank + k * c), int(c), int(at), offset))
                    rank, left = rank + k * c, left - k * c
                    add(r - c * need, at, k)
            if m > full + last:
                add(r, s + full + last, m - full - last)
        # A group that can't hold even one token, or one more document, is closed.
        open_ = (res[:size] >= 1).all(axis=1)
        k = int(open_.sum())
        res[:k], first[:k], many[:k] = res[:size][open_], first[:size][open_], many[:size][open_]
        size = k
    return runs


# --- operator -------------------------------------------------------------------------------------------------------


def pack(rows: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (at most `capacity`)."""
    spark = rows.sparkSession
    rows = materialize(rows)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.xxhash64("doc_id", "piece")
    dealt = rows.withColumn("_h", key).repartitionByRange(parts, "length", "_h", "doc_id").sortWithinPartitions("length", "_h", "doc_id", "piece").drop("_h")
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    # At most a row for each length and each part: a part holds a range of lengths.
    found = sorted(dealt.groupBy("length", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("low")).collect())
    counts: dict[int, int] = {}
    shift = []
    for r in found:
        shift.append((r["length"], r["_part"], counts.get(r["length"], 0) - r["low"]))
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    runs: dict[int, list] = {}
    for n, *run in plan(counts, capacity, **options):
        runs.setdefault(n, []).append(tuple(run))
    shifts = spark.createDataFrame(shift, "length long, _part int, _shift long")
    plans = spark.createDataFrame([(n, lo, hi, c, s, o) for n, x in runs.items() for lo, hi, c, s, o in x], "length long, lo long, hi long, per long, seq long, off long")
    # A length's runs are few and in order of rank: an array that is searched for the rank.
    plans = plans.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "per", "seq", "off"))).alias("_runs"))
    rank = F.col("_at") + F.col("_shift")
    # At most a row for each length and part, and a plan for each length: both are small unless `capacity` is huge.
    small = F.broadcast if len(shift) + sum(map(len, runs.values())) <= BROADCAST_ROWS else lambda df: df
    out = dealt.join(small(shifts), ["length", "_part"]).join(small(plans), "length").withColumn("_rank", rank)
    out = out.withColumn("_run", F.element_at(F.filter("_runs", lambda x: (x["lo"] <= F.col("_rank")) & (F.col("_rank") < x["hi"])), 1))
    at = F.col("_rank") - F.col("_run.lo")
    out = out.withColumn("sequence_id", F.col("_run.seq") + F.expr("(_rank - _run.lo) div _run.per"))
    out = out.withColumn("offset", F.col("_run.off") + (at % F.col("_run.per")) * F.col("length"))
    return out.select(*rows.columns, "sequence_id", "offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

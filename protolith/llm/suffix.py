"""Exact removal of repeated substrings by bucket-pointer refinement over sampled suffixes.

Every byte that lies in a string of LENGTH bytes which also starts anywhere else, in the same document or another, is
removed; strings lie within one document and are judged on the input. The method is bucket-pointer refinement:
suffixes lie in buckets by their first Q bytes, a bucket of one suffix is done, and the others are refined by sorting
on the bucket identifiers of later offsets (32, 64, then 128 and 72 bytes on), each depth reusing the identifiers of
the depth before. Three things make it a distributed job:

* Identifiers are 64-bit names that depend on the bytes alone, not ranks, so all tasks agree on them without a global
  sort; equal strings are told by 128 bits: those of the bucket and those of the context, block or string within it.
  Only equality at depth LENGTH is asked for, so no order is lost.
* Of a string's Q-grams only one, the anchor of least name, is put into a first bucket. Equal strings have equal
  anchors at equal offsets, so first buckets of one anchor clear all strings around it: about one suffix in 80 is dealt.
* Around an anchor, the bytes of all its strings are its context. Contexts that occur twice or more are repeated as a
  whole. The others are refined against the distinct contexts of their bucket, in one task where a bucket has at most
  TASK_CONTEXTS. A larger bucket is first refined as a job: the strings of a context are cut into blocks of BLOCK
  starts, which are dealt by the deeper bucket of the bytes that all strings of a block share; again blocks that occur
  twice are repeated as a whole, and the others are refined in a task, or, where that bucket is still larger, string by
  string through counts that are summed before they are dealt. No text of a hot bucket is gathered; nothing is capped.

Null text counts as empty. Rows of one doc_id are told apart by 64 bits of their text; equal rows repeat each other. A
null doc_id is kept. An empty table gives no rows. Long texts go through the kernels SEGMENT starts at a time. Carried
columns must not be named like the operator's own; `common.carry` packs any columns under one name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, forget, groups_of, materialize, table, tidy
from .hashing import mix

#: Length of the strings compared, and the q of the first buckets.
LENGTH, Q = 200, 32
#: Starts that a kernel handles at once.
SEGMENT = 1 << 17
TASK_CONTEXTS = 512
BLOCK = 16
_K = np.uint64(0x9E3779B97F4A7C15)


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from each position on as one integer; the last seven positions read zeros."""
    n = len(data)
    padded = data + b"\0" * (15 + -n % 8)
    out = np.empty((n + 7) // 8 * 8, np.uint64)
    for k in range(8):
        out[k::8] = np.frombuffer(padded, "<u8", len(out) // 8, k)
    return out[:n]


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The refined bucket of suffixes in bucket x whose later offset is in bucket y."""
    return mix(x * _K + y)


def buckets(words: np.ndarray) -> np.ndarray:
    """The q-gram bucket of every position that has q bytes."""
    b = joined(words[:-8], words[8:])
    return joined(b[:-16], b[16:])[: max(0, len(words) - Q + 1)]


def refined(q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bucket at depth LENGTH of some positions, from buckets of later offsets: 32, 64, 128, then 200."""

    def deep(at, depth):
        return q[at] if depth == Q else joined(deep(at, depth // 2), deep(at + depth // 2, depth // 2))

    return joined(deep(at, 128), deep(at + LENGTH - 128, 128))


def checks(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A second identifier of the strings of LENGTH bytes, from the bytes themselves."""
    h = np.full(len(at), 0x5851F42D4C957F2D, np.uint64)
    for k in range(0, LENGTH, 8):
        h = mix(h * np.uint64(0xD1342543DE82EF95) + words[at + k])
    return h


def anchors(data: bytes, ends: np.ndarray):
    """Runs of starts that share an anchor: anchor, first start, last start; and the arrays behind them.

    ends: where each document ends; strings of LENGTH bytes lie within one. A start's anchor is the q-gram of the least
    bucket in its string, the leftmost of equals, so equal strings have equal anchors at equal offsets.
    """
    words = eights(data)
    q = buckets(words)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return words, q, *(np.empty(0, np.int64),) * 3
    least = (q & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(q), dtype=np.uint64)
    span, width = LENGTH - Q + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n], least[span - width : span - width + n])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.ones(n, bool)
    for e in ends:
        whole[max(0, e - LENGTH + 1) : e] = False
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])) + 1
    low = np.concatenate([[0], cut])
    high = np.concatenate([cut, [n]]) - 1
    fine = whole[low]
    low, high = low[fine], high[fine]
    return words, q, anchor[low], low, high


def segments(texts: list[bytes]):
    """(bytes, ends, [(text, first byte of the text here, start in bytes)]) of about SEGMENT starts each; long texts are cut."""
    for i, j in groups_of([len(t) for t in texts], SEGMENT):
        if j - i == 1 and len(texts[i]) > SEGMENT:
            for a in range(0, len(texts[i]) - LENGTH + 1, SEGMENT):
                part = texts[i][a : a + SEGMENT + LENGTH - 1]
                yield part, np.array([len(part)]), np.array([i]), np.array([a]), np.array([0])
        else:
            n = np.array([len(t) for t in texts[i:j]])
            ends = np.cumsum(n)
            yield b"".join(texts[i:j]), ends, np.arange(i, j), np.zeros(j - i, np.int64), ends - n


# A place is packed: the first start in the document, the anchor's distance from it, and how many starts follow it.


def pack(low: np.ndarray, anchor: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (low << 16) | ((anchor - low) << 8) | (high - low)


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First start, and how many starts follow."""
    return at >> 16, at & 255


def _anchors(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int64()), ("key", pa.int64()), ("ctx", pa.int64())])
    for b in batches:
        for i in range(0, b.num_rows, 1024):
            part = b.slice(i, 1024)
            ids, th = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            texts = [(t or "").encode() for t in part.column(2).to_pylist()]
            for data, ends, doc, first, begin in segments(texts):
                words, q, anchor, low, high = anchors(data, ends)
                if not len(low):
                    continue
                ctx = joined(refined(q, low), refined(q, high)) + checks(words, low) * _K
                ctx = mix(ctx ^ checks(words, high)) + pack(np.zeros_like(low), anchor - low, high - low).astype(np.uint64) * _K
                of = np.searchsorted(ends, low, side="right")
                shift = first[of] - begin[of]
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[of]]), pa.array(th[doc[of]]), pa.array(pack(low + shift, anchor + shift, high + shift)), pa.array(q[anchor].view(np.int64)), pa.array(ctx.view(np.int64))], schema=schema)


def _contexts(batches):
    """Bytes of the contexts that a document's places name."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())])
    for b in batches:
        rows = []
        for doc, th, text, places in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            data = (text or "").encode()
            for p in places:
                low, more = p["at"] >> 16, p["at"] & 255
                rows.append((p["key"], p["n"], doc, th, p["at"], data[low : low + more + LENGTH]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def refine(contexts: list[bytes]) -> list[np.ndarray]:
    """The offsets in each context whose string of LENGTH bytes is in another context too."""
    data = b"".join(contexts)
    size = np.array([len(c) for c in contexts])
    base = np.cumsum(size) - size
    many = size - LENGTH + 1
    owner = np.repeat(np.arange(len(contexts)), many)
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + base[owner]
    words = eights(data)
    bucket, live = buckets(words), np.arange(len(start))
    for step in (None, Q, 2 * Q, LENGTH - 4 * Q):
        if step:
            bucket = joined(bucket[:-step], bucket[step:])
        name = bucket[start[live]] if step != LENGTH - 4 * Q else bucket[start[live]] ^ checks(words, start[live])
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        live = live[np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])])]
        if not len(live):
            break
    bounds = np.searchsorted(owner[live], np.arange(len(contexts) + 1))
    return [start[live[a:b]] - base[k] for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]


_RANGE = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _refined(batches):
    """Repeated ranges of the contexts of whole buckets."""
    for b in batches:
        buckets_ = b.column(0).to_pylist()
        for i, j in groups_of([len(x) for x in buckets_], 4 * TASK_CONTEXTS):
            part = [c for x in buckets_[i:j] for c in x]
            rows = []
            for c, found in zip(part, refine([c["bytes"] for c in part]), strict=True):
                if c["n"] == 1 and len(found):
                    low = c["at"] >> 16
                    cut = np.flatnonzero(np.diff(found) > 1)
                    for x, y in zip(found[np.concatenate([[0], cut + 1])].tolist(), found[np.concatenate([cut, [-1]])].tolist(), strict=True):
                        rows.append((c["doc_id"], c["th"], low + x, low + y + LENGTH))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RANGE, strict=True)], schema=_RANGE)


def _blocks(batches):
    """Blocks of the strings of the contexts that a document's places name: (core's bucket, block's name)."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int64()), ("key", pa.int64()), ("ctx", pa.int64()), ("n", pa.int64())])
    for b in _contexts(batches):
        for i in range(0, b.num_rows, 1024):
            part = b.slice(i, 1024)
            contexts = part.column(5).to_pylist()
            data = b"".join(contexts)
            size = np.array([len(c) for c in contexts])
            words, base = eights(data), np.cumsum(size) - size
            q, place = buckets(words), part.column(4).to_numpy()
            low, more, back = place >> 16, place & 255, (place >> 8) & 255
            # Blocks by distance before the anchor, so that equal strings are in equal blocks.
            first = np.maximum(back - more, 0) // BLOCK
            many = back // BLOCK - first + 1
            owner = np.repeat(np.arange(len(contexts)), many)
            j = np.arange(len(owner)) - (np.cumsum(many) - many)[owner] + first[owner]
            a = np.maximum(back[owner] - (j * BLOCK + BLOCK - 1), 0)
            z = np.minimum(back[owner] - j * BLOCK, more[owner])
            core = base[owner] + back[owner] - j * BLOCK
            depth = LENGTH - BLOCK + 1
            key = q[core]
            for later in (*range(Q, depth - Q, Q), depth - Q):
                key = joined(key, q[core + later])
            lo, hi = base[owner] + a, base[owner] + z
            name = mix(joined(refined(q, lo), refined(q, hi)) ^ checks(words, lo) * _K ^ checks(words, hi)) + ((z - a) * 256 + j).astype(np.uint64) * _K
            cols = [part.column(2).to_numpy()[owner], part.column(3).to_numpy()[owner], ((low[owner] + a) << 16) | (z - a), key.view(np.int64), name.view(np.int64), part.column(1).to_numpy()[owner]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _strings(batches):
    """The two identifiers of every string of the contexts that a document's places name."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64())])
    for b in _contexts(batches):
        for i in range(0, b.num_rows, 1024):
            part = b.slice(i, 1024)
            contexts = part.column(5).to_pylist()
            words = eights(b"".join(contexts))
            size = np.array([len(c) for c in contexts])
            owner = np.repeat(np.arange(len(contexts)), size - LENGTH + 1)
            within = np.arange(len(owner)) - (np.cumsum(size - LENGTH + 1) - (size - LENGTH + 1))[owner]
            at = within + (np.cumsum(size) - size)[owner]
            low = (part.column(4).to_numpy() >> 16)[owner] + within
            cols = [refined(buckets(words), at).view(np.int64), checks(words, at).view(np.int64), *(part.column(k).to_numpy()[owner] for k in (1, 2, 3)), low]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _removed(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
    for b in batches:
        rows = []
        for doc, text, ranges in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            data, spans = (text or "").encode(), []
            for r in sorted(ranges or (), key=lambda r: (r["start"], r["stop"])):
                if spans and r["start"] <= spans[-1]["stop"]:
                    spans[-1]["stop"] = max(spans[-1]["stop"], r["stop"])
                else:
                    spans.append(r)
            edges = [0, *(x for r in spans for x in (r["start"], r["stop"])), len(data)]
            rows.append((doc, len(data), spans, b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))))
        if rows:
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, *b.columns[3:]], names=[*schema.names, *b.schema.names[3:]])


def remove_repeats(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, n_bytes, spans (removed, maximal, in bytes), kept (the remaining bytes) and other columns of every document."""
    # A row is told by (doc_id, th); th also tells a null doc_id from 0.
    th = F.xxhash64(F.col("doc_id").isNull(), "text").alias("th")
    rows = documents(docs, *carried).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), th, "text", F.col("doc_id").alias("_doc"), *carried)
    base = rows.select("doc_id", "th", "text")
    whose = ["doc_id", "th"]
    dealt = materialize(base.mapInArrow(tidy(_anchors), "doc_id long, th long, at long, key long, ctx long"))
    # Written, so that the join's sides are plain shuffles, of which Spark splits a hot bucket's.
    shared = materialize(dealt.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"))
    suffixes = materialize(dealt.join(shared, "key"))
    forget(dealt, shared)
    contexts = materialize(suffixes.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "at")).alias("p")))
    several = materialize(contexts.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    unlike = materialize(contexts.join(several, "key").select("key", "n", "m", "p.*"))
    places = lambda df: df.groupBy(*whose).agg(F.collect_list(F.struct("key", "n", "at")).alias("places"))
    text = lambda df: base.join(places(df), whose).select(*whose, "text", "places")
    # Buckets too large for a task: their blocks, by deeper buckets.
    blocks = materialize(text(unlike.filter(F.col("m") > TASK_CONTEXTS)).mapInArrow(tidy(_blocks), "doc_id long, th long, at long, key long, ctx long, n long"))
    named = materialize(blocks.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "at", F.col("n").alias("was"))).alias("p")))
    deeper = materialize(named.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    # Those of contexts that are repeated anyway only take part.
    straddling = materialize(named.join(deeper, "key").select("key", F.greatest("n", "p.was").alias("n"), "m", "p.doc_id", "p.th", "p.at"))
    small = F.col("m") <= TASK_CONTEXTS
    parts = text(unlike.filter(small).union(straddling.filter(small))).mapInArrow(tidy(_contexts), "key long, n long, doc_id long, th long, at long, bytes binary")
    whole_buckets = parts.groupBy("key").agg(F.collect_list(F.struct("n", *whose, "at", "bytes")).alias("c")).select("c")
    cold = whole_buckets.mapInArrow(tidy(_refined), "doc_id long, th long, start long, stop long")
    strings = materialize(text(straddling.filter(~small)).mapInArrow(tidy(_strings), "a long, b long, n long, doc_id long, th long, start long"))
    twice = materialize(strings.groupBy("a", "b").agg(F.count("*").alias("m")).filter("m > 1").select("a", "b"))
    hot = strings.filter("n = 1").join(twice, ["a", "b"]).select(*whose, "start", (F.col("start") + LENGTH).alias("stop"))
    low = F.shiftright("at", 16)

    def repeated(places_, names):
        found = places_.join(names.filter("n > 1").select("key", "ctx"), ["key", "ctx"])
        return found.select(*whose, low.alias("start"), (low + F.col("at").bitwiseAND(255) + LENGTH).alias("stop"))

    whole = repeated(suffixes, contexts).union(repeated(blocks.filter("n = 1").drop("n"), named))
    ranges = whole.union(cold).union(hot).groupBy(*whose).agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    out = rows.join(ranges, whose, "left").select(F.col("_doc").alias("doc_id"), "text", "ranges", *carried)
    schema = T._parse_datatype_string("doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.mapInArrow(tidy(_removed), T.StructType(schema.fields + [out.schema[c] for c in carried]))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary is a public model file; its pieces and log scores are read from the file's own records. A text gets one
space in front, spaces become the marker U+2581, and the segmentation of greatest summed score is found by Viterbi over
the trie's matches. A character that no piece covers costs `least score - 10` and is spelled in byte pieces; so is a
marker that the text itself holds, and decoding gives back every text. No piece has a marker after another character,
so a text falls apart before each run of spaces (and at line ends, if no longer piece has one); the best segmentations of
its parts are the best of the whole, and a worker remembers those of frequent parts. Ties go to the longer last piece.

Null and empty texts have no ids. Repeated rows get equal ids; an empty table gives no rows. Very long parts are linear
in time and memory.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table

VOCABULARY = "piece_bpe_32k.model"
MARK, PENALTY, CACHE_PARTS = "▁", 10.0, 400_000
#: Parts of fewer characters are segmented many at a time and remembered.
SHORT = 64
#: Kinds of pieces in a model file.
NORMAL, USER, BYTE = 1, 4, 6


def _fields(data: bytes):
    """(field, value) of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        field, wire = divmod(varint(), 8)
        if wire == 0:
            yield field, varint()
        elif wire == 2:
            n = varint()
            yield field, data[at : at + n]
            at += n
        else:
            n = 4 if wire == 5 else 8
            yield field, data[at : at + n]
            at += n


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id."""
    with open(path, "rb") as f:
        records = [dict(_fields(v)) for k, v in _fields(f.read()) if k == 1]
    return [(r[1].decode(), struct.unpack("<f", r[2])[0] if 2 in r else 0.0, r.get(3, NORMAL)) for r in records]


class Trie:
    """A double-array trie over bytes: the child of node s by byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        nodes: list[dict] = [{}]
        value = [-1]
        for key, v in keys:
            s = 0
            for c in key:
                if c not in nodes[s]:
                    nodes[s][c] = len(nodes)
                    nodes.append({})
                    value.append(-1)
                s = nodes[s][c]
            value[s] = v
        size = 2 * len(nodes) + 600
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        check = self.check
        place, begin = {0: 0}, 1
        check[0] = 0
        for s, children in enumerate(nodes):
            at = place.pop(s)
            self.value[at] = value[s]
            if not children:
                continue
            cs = sorted(children)
            where, taken, first = max(cs[0] + 1, begin), 0, True
            while True:
                if where + 257 > len(check):
                    for array, empty in ((self.base, 0), (check, -1), (self.value, -1)):
                        array += [empty] * (len(array) // 2)
                if check[where] >= 0:
                    taken += 1
                else:
                    if first:
                        begin, first = where, False
                    b = where - cs[0] - 1
                    if all(check[b + c + 1] < 0 for c in cs):
                        break
                where += 1
            # Where nearly all is taken, later searches begin behind it.
            if taken >= 0.9 * (where - begin + 1) or where - begin > 2000:
                begin = where
            self.base[at] = b
            for c in cs:
                check[b + c + 1] = at
                place[children[c]] = b + c + 1

    def matches(self, data: bytes, at: int):
        """(end, value) of the keys that start here, shortest first."""
        base, check, value, s = self.base, self.check, self.value, 0
        for k in range(at, len(data)):
            t = base[s] + data[k] + 1
            if t >= len(check) or check[t] != s:
                return
            s = t
            if value[s] >= 0:
                yield k + 1, value[s]


def _widths(lead: np.ndarray) -> np.ndarray:
    """Bytes of the characters with these first bytes."""
    return 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)


class Codec:
    def __init__(self, model: list[tuple[str, float, int]]):
        self.pieces = model
        plain = [(i, p, s) for i, (p, s, k) in enumerate(model) if k in (NORMAL, USER) and p]
        self.score = [s for _, s, _ in model]
        self.bytes_ = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(model) if k == BYTE}
        self.unknown = min((s for _, _, s in plain), default=0.0) - PENALTY
        self.trie = Trie([(p.encode(), i) for i, p, _ in plain])
        if any(MARK in p.lstrip(MARK) for _, p, _ in plain):
            raise ValueError("a piece has a marker after another character")
        line = any("\n" in p and len(p) > 1 for _, p, _ in plain)
        self.part = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if line else f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
        #: What each id stands for in a decoded text.
        self.told = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k in (NORMAL, USER) else b"" for p, _, k in model]
        self.seen: dict[str, bytes] = {}
        self.arrays = [np.array(x, np.int64) for x in (self.trie.base, self.trie.check, self.trie.value)]
        self.scores = np.array(self.score, np.float64)
        self.byte_ids = np.array([self.bytes_.get(b, 0) for b in range(256)], np.int64)

    def viterbi(self, part: str) -> list[int]:
        """The ids of the best segmentation of one part."""
        data = part.encode()
        n = len(data)
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            width = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
            here, alone = best[at], False
            for end, i in self.trie.matches(data, at):
                alone = alone or end == at + width
                if (s := here + self.score[i]) > best[end]:
                    best[end], back[end] = s, (at, i)
            if not alone and (s := here + self.unknown) > best[at + width]:
                best[at + width], back[at + width] = s, (at, -1)
            at += width
        out: list[int] = []
        while n:
            at, i = back[n]
            out += [i] if i >= 0 else [self.bytes_[b] for b in reversed(data[at:n])]
            n = at
        return out[::-1]

    def segment(self, parts: list[str]) -> list[bytes]:
        """The ids of the best segmentations of short parts, by Viterbi over all of them at once."""
        raw = [p.encode() for p in parts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        starts = ends - np.array([len(r) for r in raw])
        first, stop = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        width = _widths(data[at])
        # All positions walk down the trie together; those without a child drop out.
        base, check, value = self.arrays
        alone = np.zeros(len(data), bool)
        edges, pos, s, depth = [], at, np.zeros(len(at), np.int64), 0
        while len(pos):
            t = base[s] + data[pos + depth] + 1
            fits = t < len(check)
            fits[fits] = check[t[fits]] == s[fits]
            pos, s, depth = pos[fits], t[fits], depth + 1
            told = value[s] >= 0
            edges.append((pos[told], pos[told] + depth, value[s[told]]))
            inside = pos + depth < stop[pos]
            pos, s = pos[inside], s[inside]
        source, target, ids = (np.concatenate(x) for x in zip(*edges, strict=True))
        alone[source[target == source + _widths(data[source])]] = True
        lost = at[~alone[at]]
        source, target = np.concatenate([source, lost]), np.concatenate([target, lost + width[~alone[at]]])
        ids = np.concatenate([ids, np.full(len(lost), -1)])
        gain = np.where(ids >= 0, self.scores[ids], self.unknown)
        # Edges that start equally far in their parts end at different places, so each step is one update.
        order = np.argsort(source - first[source], kind="stable")
        source, target, ids, gain = source[order], target[order], ids[order], gain[order]
        steps = np.flatnonzero(np.diff(source - first[source], prepend=-1, append=-1))
        where = target + np.searchsorted(ends, target, "left")  # one more place a part: its start
        begin = source + np.searchsorted(ends, source, "right")
        best, back = np.full(len(data) + len(parts), -np.inf), np.zeros(len(data) + len(parts), np.int64)
        best[starts + np.arange(len(parts))] = 0.0
        for i, j in zip(steps, steps[1:], strict=False):
            s = best[begin[i:j]] + gain[i:j]
            better = np.flatnonzero(s > best[where[i:j]])
            best[where[i + better]], back[where[i + better]] = s[better], i + better
        used = np.zeros(len(source), bool)
        now, bottom = ends + np.arange(len(parts)), starts + np.arange(len(parts))
        while len(now):
            e = back[now]
            used[e] = True
            now, keep = begin[e], begin[e] > bottom
            now, bottom = now[keep], bottom[keep]
        taken = np.flatnonzero(used)
        taken = taken[np.argsort(source[taken])]
        source, target, ids = source[taken], target[taken], ids[taken]
        n = np.where(ids >= 0, 1, target - source)
        out = np.repeat(ids, n)
        spelled = np.repeat(source, n) + np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
        out[out < 0] = self.byte_ids[data[spelled[out < 0]]]
        cuts = 4 * np.concatenate([[0], np.cumsum(n)])[np.searchsorted(source, np.append(starts, len(data)))]
        flat = out.astype("<i4").tobytes()
        return [flat[i:j] for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]

    def _learn(self, parts: set[str]) -> None:
        """Fill the memory with the parts that it lacks."""
        if len(self.seen) + len(parts) > CACHE_PARTS:
            self.seen.clear()
        new = [p for p in parts if p not in self.seen]
        short = [p for p in new if len(p) < SHORT]
        for i in range(0, len(short), 20_000):
            some = short[i : i + 20_000]
            self.seen.update(zip(some, self.segment(some), strict=True))
        for p in new:
            if len(p) >= SHORT:
                self.seen[p] = np.array(self.viterbi(p), "<i4").tobytes()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        own = np.array([self.bytes_[b] for b in MARK.encode()], "<i4").tobytes()
        # A marker of the text itself is spelled in bytes, so that it isn't taken for a space.
        split = [[self.part.findall((MARK if k == 0 else "") + p.replace(" ", MARK)) for k, p in enumerate(t.split(MARK))] if t else [] for t in texts]
        self._learn({p for t in split for ps in t for p in ps})
        out = [np.frombuffer(own.join(b"".join(map(self.seen.__getitem__, ps)) for ps in t), "<i4") for t in split]
        for p in {p for t in split for ps in t for p in ps if len(p) >= SHORT}:
            del self.seen[p]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.told.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(read_model(path))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, ids, n_bytes_ids (how many of them spell bytes) and decoded (the text that the ids give back).

    A null text counts as empty: no ids, and an empty text back. Repeated rows get equal ids, other columns play no part,
    an empty table gives no rows; of segmentations of equal score the one whose last piece starts first is taken.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("n_bytes_ids", pa.int64()), ("decoded", pa.string())])

    def run(batches):
        c = codec(path or vocabulary())
        fallback = np.zeros(len(c.pieces), np.int64)
        fallback[list(c.bytes_.values())] = 1
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column(1).to_pylist()
                ids = c.encode_all(texts)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array([int(fallback[x].sum()) for x in ids], pa.int64()), pa.array([c.decode(x.tolist()) for x in ids], pa.string())], schema=schema)

    return documents(docs).mapInArrow(run, "doc_id long, text string, ids array<int>, n_bytes_ids long, decoded string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = encoded(table(spark, sf_dir, "documents"))
    return e.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "n_bytes_ids", F.lower(F.hex(F.xxhash64("ids"))).alias("ids_hash"), "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("restored"))

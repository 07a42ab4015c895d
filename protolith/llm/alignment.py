"""Alignment of two tokenizers' tokens over the bytes of the same text.

Tokens of A and B are intervals of bytes. B's intervals are kept sorted by start and end, and each token of A lists what
it overlaps by two bisections. A gap between neighbouring tokens of A that no token of B spans, where one of B ends too,
becomes a border: borders cut both into groups, and all pairs of an A and a B token of one group are links. A pair of
ids is counted by the documents that hold it linked.

Both vocabularies always end a token before a blank that follows something other than white space. So a text is cut
there into segments, a border is at every cut, and a worker aligns a segment once for all its occurrences. The distinct
linked pairs of each document, with their links, are written once. Counts are summed by pair, in tasks first. The most
frequent pairs' counts, at most `BROADCAST_PAIRS`, go to the tasks; rarer pairs, if any, are joined by the pair.

A text that is null or empty, or whose tokens of A or B don't spell a blank and the text, has no tokens: zeros and ''.
Repeated rows count as documents each, a null doc_id is kept, other columns play no part, an empty table gives no rows.
Long texts go piece by piece, but for one segment, which is held whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, groups_of, materialize, table, tidy

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments that a worker remembers, and their characters in all; characters of text that it cuts at once.
CACHE_SEGMENTS, CACHE_CHARS, CHUNK_CHARS = 400_000, 1 << 23, 1 << 19
#: Counts of pairs that are broadcast: 12 bytes each. Rarer pairs beyond are joined.
BROADCAST_PAIRS = 4_000_000
_CUT = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s ")


def segments(text: str) -> Iterator[list[str]]:
    """Lists of the segments of a blank and the text, each without its own first blank."""
    at, n = 0, len(text)
    while at <= n:
        end = at + CHUNK_CHARS
        while end < n:
            end = text.find(" ", end)
            if end < 0 or not text[end - 1].isspace():
                break
            end += 1
        end = n if end < 0 or end > n else end
        part = text[at:end]
        yield [s[1:] for s in _CUT.split(" " + part)] if part[:1].isspace() or part[-1:].isspace() or _ODD.search(part) else part.split(" ")
        at = end + 1


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in A's vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokenizers:
    """Token ids and their bytes, of both vocabularies."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        level = byte_level()
        words = self.a.get_vocab()
        self.bytes_a = [b""] * (max(words.values()) + 1)
        for w, i in words.items():
            self.bytes_a[i] = bytes(level[c] for c in w) if all(c in level for c in w) else w.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        n = self.b.get_piece_size()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a blank and the text: B adds the blank itself."""
        return self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)


@lru_cache(1)
def tokenizers(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A the tokens [first, last) of B that it overlaps; both cover the same bytes from 0 on."""
    starts_a, starts_b = np.concatenate([[0], ends_a[:-1]]), np.concatenate([[0], ends_b[:-1]])
    return np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")


def borders(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each token's group, for A and for B."""
    first, last = overlaps(ends_a, ends_b)
    # The gap behind a token is spanned if the next token's list begins with the one that ends this list.
    spanned = np.concatenate([[False], first[1:] < last[:-1]])
    group_a = np.cumsum(~spanned) - 1
    # A token of B is in the group of the A tokens that overlap it: of the first whose list reaches it.
    return group_a, group_a[np.searchsorted(last, np.arange(len(ends_b)), "right")]


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id), sorted, and how often each is there."""
    key, n = np.unique(group << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, n


def linked(group_a, ids_a, group_b, ids_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair of ids a << 32 | b, links) of distinct ids in each group; all groups have tokens of both."""
    ga, a, na = _counted(group_a, ids_a)
    gb, b, nb = _counted(group_b, ids_b)
    size = np.bincount(gb, minlength=int(ga[-1]) + 1 if len(ga) else 0)
    begin = np.cumsum(size) - size
    many = size[ga]
    at = np.repeat(np.arange(len(a)), many)
    to = np.repeat(begin[ga], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    return ga[at], a[at] << 32 | b[to], na[at] * nb[to]


class Memory:
    """What is known of segments: numbers of tokens, groups and links, the groups written out, linked pairs and their links."""

    def __init__(self, t: Tokenizers):
        self.t = t
        self.forget()

    def forget(self) -> None:
        #: Row 0 stands for a segment that isn't spelled.
        self.of: dict[str, int] = {}
        self.chars, self.fresh = 0, []
        self.told: list[str | None] = [None]
        self.numbers = np.zeros((1, 4), np.int64)
        self.begin, self.pairs, self.links = np.zeros(2, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, some: set[str]) -> None:
        """Align the segments that aren't known; where that would be too much to remember, forget all others."""
        new = some.difference(self.of)
        if new and (self.chars + sum(map(len, new)) > CACHE_CHARS or len(self.of) + len(new) > CACHE_SEGMENTS):
            self.forget()
            new = some
        self.chars += sum(map(len, new))
        # Between others a segment must not be empty or end in white space: then no token goes over its ends.
        plain = [s for s in new if s and not s[-1].isspace()]
        for i, j in groups_of([len(s) + 1 for s in plain], 1 << 16):
            self._align(plain[i:j])
        # A word before it, as B gives an empty text no token, not even for the blank.
        for s in new.difference(plain):
            self._align(["a", s])
        self._gather()

    def _align(self, new: list[str]) -> None:
        """Segments that are tokenised as one text."""
        t = self.t
        raw = [s.encode() for s in new]
        ends = np.cumsum([len(r) + 1 for r in raw])
        a, b = t.encode(" ".join(new))
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        whole = b" " + b" ".join(raw)
        if b"".join(map(t.bytes_a.__getitem__, a)) != whole or b"".join(map(t.bytes_b.__getitem__, b)) != whole:
            if len(new) == 1:
                self.of[new[0]] = 0
            else:
                for i, j in ((0, len(new) // 2), (len(new) // 2, len(new))):
                    self._align(new[i:j])
            return
        ends_a, ends_b = np.cumsum(t.length_a[ids_a]), np.cumsum(t.length_b[ids_b])
        of_a = np.searchsorted(ends, ends_a, "left")
        na, nb = np.bincount(of_a, minlength=len(new)), np.bincount(np.searchsorted(ends, ends_b, "left"), minlength=len(new))
        base, total = len(self.told), 0
        self.of.update(zip(new, range(base, base + len(new)), strict=True))
        ga, gb = borders(ends_a, ends_b)
        groups = int(ga[-1]) + 1
        size_a, size_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        owner = of_a[np.cumsum(size_a) - size_a]
        numbers = np.stack([na, nb, np.bincount(owner, minlength=len(new)), np.bincount(owner, size_a * size_b, len(new)).astype(np.int64)], axis=1)
        # The groups written out, one after the other.
        words_a, words_b = list(map(str, a)), list(map(str, b))
        cut_a, cut_b = np.concatenate([[0], np.cumsum(size_a)]).tolist(), np.concatenate([[0], np.cumsum(size_b)]).tolist()
        told = [f"{','.join(words_a[i:j])}|{','.join(words_b[k:m])}" for i, j, k, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:], strict=False)]
        many = numbers[:, 2].tolist()
        for m in many:
            self.told.append(";".join(told[total : total + m]))
            total += m
        group, pairs, links = linked(ga, ids_a, gb, ids_b)
        seg = owner[group]
        order = np.lexsort((pairs, seg))
        seg, pairs, links = seg[order], pairs[order], links[order]
        first = np.concatenate([[True], (seg[1:] != seg[:-1]) | (pairs[1:] != pairs[:-1])])
        links = np.add.reduceat(links, np.flatnonzero(first))
        seg, pairs = seg[first], pairs[first]
        self.fresh.append((numbers, np.bincount(seg, minlength=len(new)), pairs, links))

    def _gather(self) -> None:
        """Put what was aligned behind what was known."""
        if self.fresh:
            numbers, size, pairs, links = zip(*self.fresh, strict=True)
            self.fresh = []
            self.numbers = np.concatenate([self.numbers, *numbers])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.concatenate(size))])
            self.pairs, self.links = np.concatenate([self.pairs, *pairs]), np.concatenate([self.links, *links])

    def documents(self, texts: list[str | None]) -> list[tuple[list[int], str, np.ndarray, np.ndarray]]:
        """Of each text: numbers of tokens, groups and links, the groups' digest, distinct linked pairs and their links."""
        if len(texts) == 1:  # it may be long
            return [self._document(texts[0], segments(texts[0]) if texts[0] else ())]
        cut = [list(segments(t)) if t else [] for t in texts]
        self.learn(set().union(*(part for parts in cut for part in parts)))
        return [self._document(t, parts) for t, parts in zip(texts, cut, strict=True)]

    def _document(self, text: str | None, parts) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        nothing = np.zeros(0, np.int64)
        numbers, digest, pairs, links = np.zeros(4, np.int64), hashlib.sha256(), [nothing], [nothing]
        for k, part in enumerate(parts):
            self.learn(set(part))
            at = list(map(self.of.__getitem__, part))
            if 0 in at:
                return [0, 0, 0, 0], "", nothing, nothing
            digest.update((";" if k else "").encode() + ";".join(map(self.told.__getitem__, at)).encode())
            seg, often = np.unique(np.array(at), return_counts=True)
            numbers += often @ self.numbers[seg]
            size = self.begin[seg + 1] - self.begin[seg]
            where = np.repeat(self.begin[seg] - np.cumsum(size) + size, size) + np.arange(size.sum())
            pairs.append(self.pairs[where])
            links.append(self.links[where] * np.repeat(often, size))
        pair, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
        return numbers.tolist(), digest.hexdigest() if text else "", pair, np.bincount(inverse, np.concatenate(links), len(pair)).astype(np.int64)


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A), public_tokenizers.path(B)


ALIGNED = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))])


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and distinct linked pairs (a << 32 | b) with their links."""

    def run(batches):
        memory = Memory(tokenizers(*(paths or vocabularies())))
        for b in batches:
            ids, texts = b.column(0).cast(pa.int64()), b.column(1).to_pylist()
            for i, j in groups_of([len(t or "") + 64 for t in texts], 1 << 21):
                found = memory.documents(texts[i:j])
                columns = [ids.slice(i, j - i), *[pa.array([f[0][k] for f in found], pa.int64()) for k in range(4)], pa.array([f[1] for f in found]), *[pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (2, 3)]]
                yield pa.RecordBatch.from_arrays(columns, schema=ALIGNED)

    return documents(docs).mapInArrow(tidy(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>")


def counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (no pair of its A id has more)."""
    each = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    each = materialize(each)
    top = each.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))
    return each.join(top, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def scored(rows: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """`aligned` rows with n_best and count_sum."""
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    known = materialize(counts(rows))
    least, n = 0, known.count()
    while n > most:
        # The most frequent pairs only: double the least count until they are few enough.
        least = 2 * least + 1
        n = known.filter(F.col("n") > least).count()
    hot = known.filter(F.col("n") > least).toPandas().sort_values("pair")
    pair, count, best = hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), hot["best"].to_numpy(bool)
    sent = rows.sparkSession.sparkContext.broadcast((pair, count, best))

    def look(lists, links):
        pair, count, best = sent.value
        flat, times = lists.flatten().to_numpy(zero_copy_only=False), links.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(pair, flat), max(0, len(pair) - 1))
        seen = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
        return flat, times, np.where(seen, count[at], 0) if len(pair) else np.zeros(len(flat), np.int64), seen & best[at] if len(pair) else seen, seen

    def run(batches):
        for b in batches:
            lists, links = b.column(1), b.column(2)
            _, times, n, top, _ = look(lists, links)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            added = lambda v: (t := np.concatenate([[0], np.cumsum(v)]))[ends[1:]] - t[ends[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(added(times * top), pa.int64()), pa.array(added(times * n), pa.int64()), *b.columns[3:]], names=["row", "n_best", "count_sum", *names])

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = "row long, n_best long, count_sum long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    out = rows.select("row", "pairs", "links", *names).mapInArrow(tidy(run), kinds)
    if least:

        def rest(batches):
            for b in batches:
                flat, times, _, _, seen = look(b.column(1), b.column(2))
                row = np.repeat(b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(row[~seen]), pa.array(flat[~seen]), pa.array(times[~seen])], names=["row", "pair", "times"])

        # Each of these pairs is in at most `least` documents, so no key is hot.
        rare = rows.select("row", "pairs", "links").mapInArrow(rest, "row long, pair long, times long").join(known.filter(F.col("n") <= least), "pair")
        more = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
        out = out.join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("b", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("s", F.lit(0)))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(aligned(table(spark, sf_dir, "documents")))

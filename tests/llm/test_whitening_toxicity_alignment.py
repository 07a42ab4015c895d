"""Whitening against a dense eigensolver, toxicity by held-out accuracy, alignment against a plain reading of the bytes."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from protolith.llm import alignment, toxicity, whitening

# --- whitening ------------------------------------------------------------------------------------------------------


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, n int, x string")


def dense(rows):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in rows], object)
    n, s = len(x), x.sum(axis=0)
    z = n * x - s
    c = (z / n).astype(float)
    e, y = np.linalg.eigh(c.T @ c / n)
    return [int(v) for v in (z * z).sum(axis=1)], c, e[::-1], y[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(1)
    good = (rng.standard_normal((60, 12)) * np.linspace(3, 0.5, 12)).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(good)] + [(3, good[3].tolist()), (None, good[4].tolist())]
    bad = [(90, None), (91, []), (92, [None] + [0.0] * 11), (93, [float("nan")] * 12), (94, [float("inf")] * 12), (95, [3e38] * 12)]
    out = whitening.whiten(whitening.integers(vectors(spark, rows + bad))).collect()
    deviation, c, e, y = dense([v for _, v in rows])
    assert len(out) == 8 * len(rows) and {r["n"] for r in out} == {len(rows)}
    assert Counter((r["vec_id"], r["deviation"]) for r in out) == Counter({k: 8 * n for k, n in Counter(zip([i for i, _ in rows], deviation, strict=True)).items()})
    for k in range(8):
        got = sorted(r["whitened"] for r in out if r["component"] == k + 1)
        want = c @ y[:, k] / np.sqrt(e[k])
        assert min(np.abs(np.sort(s * want) - got).max() for s in (1, -1)) < 1e-9
        assert {r["explained"] for r in out if r["component"] == k + 1}.pop() == pytest.approx(e[k] / e.sum(), rel=1e-10)
    assert max(r["identity_error"] for r in out) < 1e-9


def test_whitening_without_variance(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(whitening.integers(none)).collect() == []
    assert whitening.whiten(whitening.integers(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))).collect() == []
    line = whitening.whiten(whitening.integers(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (7, [5.0])]))).collect()
    assert {(r["vec_id"], r["component"]) for r in line} == {(1, 1), (2, 1)}
    assert sorted(abs(r["whitened"]) for r in line) == pytest.approx([1, 1])


def test_long_deviations(spark):
    huge = whitening.whiten(whitening.integers(vectors(spark, [(1, [1e15, 0.0]), (2, [0.0, 0.0])], "double"))).collect()
    assert {r["deviation"] for r in huge} == {None}
    near = (2**30, 2**31)
    rows = [(1, [near[0] / 1024, 0.0]), (2, [0.0, near[1] / 1024])]
    out = whitening.whiten(whitening.integers(vectors(spark, rows, "double"))).collect()
    assert {r["deviation"] for r in out} == set(dense([v for _, v in rows])[0])


def symmetric(d, values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize("most", [16, 256])
@pytest.mark.parametrize("values", [np.linspace(1, 100, 90), np.r_[np.ones(80), np.full(10, 7.0)], np.r_[np.zeros(88), 3.0, 5.0], 2.0 ** -np.arange(90.0)])
def test_lanczos(values, most):
    """Restarts of the basis, equal eigenvalues, and breakdowns of a matrix of rank two."""
    m = symmetric(90, values)
    e, v, left = whitening.block_lanczos(lambda q: m @ q, 90, 6, 4, most=most)
    assert np.abs(e - np.sort(values)[::-1][:6]).max() < 1e-10 * values.max()
    assert np.abs(v.T @ v - np.eye(6)).max() < 1e-12 and np.abs(m @ v - v * e).max() < 1e-10 * values.max()


def test_lanczos_stops_early():
    passes = []
    m = symmetric(400, np.r_[np.linspace(0, 1, 390), np.linspace(50, 100, 10)])
    whitening.block_lanczos(lambda q: passes.append(q.shape[1]) or m @ q, 400, 4, 4)
    assert sum(passes) < 120


# --- toxicity -------------------------------------------------------------------------------------------------------


def corpus(n=600):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeimnorst"), 6)) for _ in range(400)]
    out = []
    for i in range(n):
        text, bad = list(rng.choice(words, rng.integers(5, 60))), i % 5 == 0
        if bad:
            text[rng.integers(len(text))] = str(rng.choice(["moronic", "scumbag", "Scumbags"])) + str(rng.choice(["", ",", "!"]))
        out.append((i, " ".join(map(str, text)), "en", int(bad)))
    return out


@pytest.fixture(scope="module")
def toxic(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, "a", "b") for i, t, lang, _ in rows] + [(9000, None, None, "a", "b"), (9001, "", None, "a", "b"), (9002, "123 !!", None, "a", "b"), (None, rows[0][1], None, "a", "b"), (0, rows[0][1], "en", "a", "b")], "doc_id long, text string, lang string, toxic string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, *_, y in rows] + [(0, 0, 1), (1, None, 1), (None, 1, 1), (2, 7, 1)], "doc_id long, toxic int, h int")
    return rows, docs, toxicity.model_of(docs, labels), labels


def test_toxicity_held_out(toxic):
    rows, docs, model, _ = toxic
    got = {}
    for r in toxicity.scored(docs, *model).collect():
        got.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(s) == 1 and 0 <= min(s) <= 1 for s in got.values()) and got[None] == got[0]
    held = [(i, y) for i, *_, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and sum((got[i].copy().pop() >= 0.5) == bool(y) for i, y in held) >= 0.97 * len(held)
    assert {9000, 9001, 9002} <= set(got) and got[9000] == got[9001]


def test_toxicity_does_not_read_labels_of_the_held_out(spark, toxic):
    rows, docs, model, labels = toxic
    changed = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, 1) for i, *_, y in rows], "doc_id long, toxic int, h int")
    again = toxicity.model_of(docs, changed)
    assert np.array_equal(model[0]["net"].e, again[0]["net"].e) and model[0]["thresholds"] == again[0]["thresholds"]


def test_long_text_in_pieces(toxic, monkeypatch):
    _, _, (model, _), _ = toxic
    text = " ".join(t for _, t, *_ in corpus(200))
    whole = toxicity.score(model, [text], ["en"])
    monkeypatch.setattr(toxicity, "CHUNK", 501)
    assert np.allclose(toxicity.score(model, [text], ["en"]), whole)


def test_pooling_stays_inside_a_text(toxic):
    net = toxic[2][0]["net"]
    docs = [toxicity.buckets(t.encode())[0] for t in ("moronic", "", "quiet words here", "a")]
    together = toxicity.pooled(net, docs)
    for d, row in zip(docs, together, strict=True):
        assert np.allclose(toxicity.pooled(net, [d])[0], row, atol=1e-5)


def test_every_labelled_document_is_learned_from(spark):
    """More documents of a label than any sample took: all are counted, in one share or in many."""
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('word of ', if(id % 2 = 0, 'even', 'odd'), ' w', id) as text")
    known = toxicity.labelled(docs, spark.range(9000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")).select("h", "toxic", "text")
    one, four = toxicity.counted(known, 1), toxicity.counted(known, 4)
    assert np.array_equal(one, four) and one.max(axis=1).tolist() == [4500, 4500]
    for k, word in enumerate((b"even", b"odd")):
        assert one[k, toxicity.buckets(word)[0][0, 0]] >= 4500


def test_shares_are_averaged(spark, toxic, monkeypatch):
    rows, docs, _, labels = toxic
    monkeypatch.setattr(toxicity, "SHARE", 20_000)
    asked, own = [], toxicity.improved
    monkeypatch.setattr(toxicity, "improved", lambda *a: asked.append(a[-1]) or own(*a))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, *toxicity.model_of(docs.repartition(6), labels)).collect()}
    held = [(i, y) for i, *_, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert min(asked) > 1 and sum((got[i] >= 0.5) == bool(y) for i, y in held) >= 0.95 * len(held)


def test_long_text_is_trained_on_by_its_strongest_words(toxic, monkeypatch):
    net = toxic[2][0]["net"]
    raw = " ".join(t for _, t, *_ in corpus(200)).encode()
    whole = toxicity.pooled(net, [toxicity.buckets(raw)[0]])[0]
    monkeypatch.setattr(toxicity, "CHUNK", 501)
    few = toxicity.read(net, raw)
    assert len(few) < 150 and np.allclose(toxicity.pooled(net, [few])[0], whole, atol=1e-2)


def test_sums_of_a_table_give_the_same_thresholds(spark):
    rng = np.random.default_rng(4)
    langs, y = ["a" if i % 3 else "b" for i in range(300)], (rng.random(300) < 0.3).astype(float)
    raw = y + rng.standard_normal(300)
    a, b = toxicity.calibrate(raw, y, np.ones(300), langs), toxicity.calibrated(spark.createDataFrame([(float(r), int(t), v) for r, t, v in zip(raw, y, langs, strict=True)], "raw double, toxic int, lang string"))
    assert all(a[k] == pytest.approx(b[k], abs=1e-6) for k in ("slope", "centre", "offset", "by"))


def test_one_kind_of_label(spark, toxic):
    _, docs, _, _ = toxic
    some = spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int")
    out = toxicity.scored(docs, *toxicity.model_of(docs, some))
    assert {r["score"] for r in out.select("score").distinct().collect()} == {0.0}
    none = docs.filter("doc_id < 0")
    assert toxicity.scored(none, *toxicity.model_of(none, some.filter("doc_id < 0"))).count() == 0


def test_thresholds_by_language():
    rng = np.random.default_rng(4)
    langs = ["a" if i % 2 else "b" for i in range(400)]
    y = (rng.random(400) < 0.5).astype(float)
    raw = 4 * y + np.array([3.0 if v == "a" else 0.0 for v in langs]) + rng.standard_normal(400) * 0.2
    t = toxicity.calibrate(raw, y, np.ones(400), langs)
    z = t["slope"] * (raw - t["centre"]) + t["offset"] + np.array([t["by"][v] for v in langs])
    assert ((z > 0) == (y == 1)).mean() > 0.98


# --- alignment ------------------------------------------------------------------------------------------------------

TEXTS = ["The quick brown fox", "The quick brown fox", None, "", " ", "  two  blanks ", "a\n b \t c　d", "été 😀 naïve", "x▁y", "<|endoftext|> <s> <0x41>", "don't, o'clock... 12345!!", "日本語のテキスト です", "trailing ", "\u001c \u0085 x  y", "word " * 300, "a" * 3000, "\x00 z", "<unk> ok"]


def tokens(text):
    t = alignment.tokenizers(*alignment.vocabularies())
    return t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text), t


def plain(texts):
    """The contract read aloud, token by token."""
    found = []
    for text in texts:
        if not text:
            found.append(None)
            continue
        a, b, t = tokens(text)
        want = (" " + text).encode()
        if b"".join(t.bytes_a[i] for i in a) != want or b"".join(t.bytes_b[i] for i in b) != want:
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(t.bytes_a[i]) for i in a]).tolist(), np.cumsum([len(t.bytes_b[i]) for i in b]).tolist()
        both, low, groups = sorted(set(ends_a) & set(ends_b)), 0, []
        for high in both:
            groups.append(([i for i, e in zip(a, ends_a, strict=True) if low < e <= high], [i for i, e in zip(b, ends_b, strict=True) if low < e <= high]))
            low = high
        found.append((len(a), len(b), groups))
    many = Counter(p for f in found if f for p in {(x, y) for g, h in f[2] for x in g for y in h})
    top = {}
    for (x, _), n in many.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for f in found:
        links = [(x, y) for g, h in f[2] for x in g for y in h] if f else []
        told = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in f[2]) if f else ""
        out.append((*((f[0], f[1], len(f[2])) if f else (0, 0, 0)), len(links), sum(many[p] == top[p[0]] for p in links), sum(many[p] for p in links), hashlib.sha256(told.encode()).hexdigest() if f else ""))
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("most", [4_000_000, 20, 0])
def test_alignment(spark, most):
    """With all counts broadcast, some, and none."""
    docs = spark.createDataFrame([(i % 16 or None, t, "a", "b") for i, t in enumerate(TEXTS)], "doc_id long, text string, pair string, row string")
    got = rows_of(alignment.scored(alignment.aligned(docs), most))
    want = [(i % 16 or None, *w) for i, w in enumerate(plain(TEXTS))]
    assert Counter(got) == Counter(want)
    assert alignment.scored(alignment.aligned(docs.filter("doc_id < 0")), most).count() == 0


def test_zeros_only_where_bytes_differ():
    zero = {t for t, w in zip(TEXTS, plain(TEXTS), strict=True) if w[0] == 0}
    assert "x▁y" in zero and "été 😀 naïve" not in zero and "<|endoftext|> <s> <0x41>" not in zero


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab,.' \n\t'é日😀1▁\x1c <>|"), max_size=40))
def test_segments_are_tokenised_apart(text):
    """Cut, aligned and put together again, and the same with cuts for long texts."""
    memory = alignment.Memory(alignment.tokenizers(*alignment.vocabularies()))
    one = plain([text])[0]
    for chunk in (1 << 19, 5):
        alignment.CHUNK_CHARS, was = chunk, alignment.CHUNK_CHARS
        try:
            (numbers, digest, _, links), _ = memory.documents([text, "other words"])
        finally:
            alignment.CHUNK_CHARS = was
        assert (*numbers, digest) == (*one[:4], one[6]) and links.sum() == one[3]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_SEGMENTS", 5)
    memory = alignment.Memory(alignment.tokenizers(*alignment.vocabularies()))
    texts = ["one two three four", "five six seven eight nine ten eleven", "one five twelve"]
    for text in texts:
        (got,) = memory.documents([text])
        want = plain([text])[0]
        assert (*got[0], got[1]) == (*want[:4], want[6])
    assert len(memory.of) <= 7


def test_interval_index():
    """Tokens of A list what they overlap; a gap that is spanned is no border."""
    first, last = alignment.overlaps(np.array([2, 5, 6]), np.array([1, 3, 6]))
    assert list(zip(first.tolist(), last.tolist(), strict=True)) == [(0, 2), (1, 3), (2, 3)]
    assert [g.tolist() for g in alignment.borders(np.array([2, 5, 6]), np.array([1, 3, 6]))] == [[0, 0, 0], [0, 0, 0]]
    assert [g.tolist() for g in alignment.borders(np.array([2, 5, 6]), np.array([2, 3, 5, 6]))] == [[0, 1, 2], [0, 1, 1, 2]]

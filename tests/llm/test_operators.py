"""Every operator against brute force, on small tables with nulls, empty, repeated and long texts."""

import hashlib
import re
import wave
import io
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from protolith.llm import langid, licenses, media, minhash, packing, pieces, pii, suffix, vafile, wrappers

LONG = "lorem ipsum dolor sit amet consetetur " * 30
TEXTS = [LONG, LONG, "x" + LONG + "y", None, "", "été 😀 " * 80, "a b", "a b", "one two three four", LONG[:250] + "q", "1 " * 3000]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """With extra columns under clashing names, written as a table."""
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame([(i, t, "en", "key") for i, t in enumerate(TEXTS)], "doc_id long, text string, key string, bucket string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < 0")


def repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for k in range(len(d) - length + 1):
            seen[d[k : k + length]] = seen.get(d[k : k + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append(bytes(x for x, g in zip(d, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("most", [512, 1])
def test_suffix(docs, none, most, monkeypatch):
    monkeypatch.setattr(suffix, "TASK_CONTEXTS", most)
    rows = {r["doc_id"]: bytes(r["kept"]) for r in suffix.remove_repeats(docs).collect()}
    assert [rows[i] for i in range(len(TEXTS))] == repeats(TEXTS)
    assert suffix.remove_repeats(none).count() == 0


def test_suffix_of_texts_over_a_segment(spark, tmp_path):
    """Texts longer than what a task reads at once, with repeats across the cut, inside one text and between two."""
    r = np.random.default_rng(12)
    word = lambda n: "".join(r.choice(list("abcdefgh "), n))
    a = word(suffix.SEGMENT + 9000)
    passage = a[suffix.SEGMENT - 150 : suffix.SEGMENT + 260]
    texts = [a, word(900) + passage + word(50), word(500) + a[4000:4230] + word(suffix.SEGMENT) + a[4000:4230]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    rows = {x["doc_id"]: bytes(x["kept"]) for x in suffix.remove_repeats(spark.read.parquet(str(tmp_path / "t"))).collect()}
    want = repeats(texts)
    assert [rows[i] for i in range(3)] == want and sum(map(len, want)) < sum(map(len, texts)) - 1000


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(min_size=230, max_size=420).map(lambda b: bytes(97 + x % 2 for x in b[:40]) * 8), min_size=1, max_size=5))
def test_refine(contexts):
    found = suffix.refine([c[:300] for c in contexts])
    for i, c in enumerate(contexts):
        mine = c[:300]
        want = [k for k in range(len(mine) - 199) if sum(mine[k : k + 200] == d[:300][j : j + 200] for d in contexts for j in range(len(d[:300]) - 199)) > 1]
        assert found[i].tolist() == want


def test_media(docs, none):
    rows = {r["doc_id"]: r for r in media.to_media(docs).collect()}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        with wave.open(io.BytesIO(bytes(rows[i]["media"]))) as w:
            assert w.readframes(w.getnframes()) == payload == bytes(rows[i]["payload"])
    assert rows[0]["fp_code"] == rows[1]["fp_code"] != rows[5]["fp_code"]
    assert media.to_media(none).count() == 0


def test_language(docs, none):
    texts = ["the cat and the dog are here with that", "der hund und die katze sind nicht hier", "le chien et la maison des rues est", "el perro y la casa de los montes"] * 12
    model = langid.train([f"{t} {i}" for i, t in enumerate(texts)], ["en", "de", "fr", "es"] * 12)
    assert [x[0] for x in langid.predict(model, ["the dog and that cat", "die katze und der hund", "la maison et le chien", "los montes y el perro", None, "", "12 !"])] == ["en", "de", "fr", "es", "und", "und", "und"]
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert langid.accepted(none, model).count() == 0 and langid.identify(none, model).count() == 0
    assert langid.predict(langid.train([], []), ["abc"]) == [("und", 0.0)]
    assert [x[0] for x in langid.predict(langid.train(["abc", "abd"], ["en", "en"]), ["x", "½ ² Ⅷ ① 12 _", "日"])] == ["en", "und", "en"]
    # A chosen language, a least score, a null lang, clashing columns; without a model texts with a letter stay.
    df = docs.withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(9)).withColumn("lang", F.lit(None).cast("string"))
    every = langid.accepted(df, model, least=0.0).collect()
    assert all(r["lang"] in ("en", "de", "fr", "es") and r["lang_pred"] == "x" for r in every) and len(every) == sum(bool(t) and any(c.isalpha() for c in t) for t in TEXTS)
    assert {r["lang"] for r in langid.accepted(df, model, ["de"]).collect()} <= {"de"} and langid.accepted(df, model, least=1.1).count() == 0
    assert langid.accepted(df, langid.train([], [])).count() == len(every)


def test_language_of_held_out_documents(spark):
    """Accuracy on documents that the model didn't learn from, and a sample within its bounds."""
    sf = "/root/testdata/sf0.001"
    rows = langid.op4_language_id(spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(held) > 30 and sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    known = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    assert all(len(langid.fit(known, 5, t)["pairs"]) for t in (8, 40))


def test_licenses(spark):
    texts = ["x\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0.", None, "", "This license is nice."]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [sorted(r["licenses"]) for r in rows] == [["CC-BY-NC-4.0", "MIT"], ["Apache-2.0", "Apache-2.0"], [], [], []]
    assert all(any(re.search(licenses.TRIGGERS, w) for w in s.split()) for s in licenses.SENTENCES.values())
    assert all(n in licenses.SENTENCES for _, rule in licenses.RULES for n in rule) and len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES)
    # Null, empty, repeated and very long texts, extra columns of clashing names, an empty table.
    more = [(1, "x" * 300_000 + " Licensed-under the\n# ISC-License!", "MIT", 3), (1, "a copy-of the MPL: if a copy-of the MPL was not distributed with this file you can obtain one at https://mozilla.org/MPL/2.0/", "a", 1), (2, "Released under the Boost Software License, Version 1.0; CC BY-NC-SA 4.0, licensed under CC BY-NC-SA 4.0", None, 1), (2, None, None, None)]
    df = spark.createDataFrame(more, "doc_id long, text string, licenses string, _ids int")
    got = sorted((r["doc_id"], sorted(r["licenses"]), len(r["sentence_ids"])) for r in licenses.scan(df).collect())
    assert got == [(1, [], 1), (1, ["ISC"], 1), (2, [], 0), (2, ["BSL-1.0", "CC-BY-NC-SA-4.0"], 2)]
    assert licenses.scan(df.filter("doc_id < 0")).count() == 0


def test_names_holders_and_negations_of_licenses(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    name = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    cases = [
        (bsd + name.format("the University of\n * California, Berkeley"), ["BSD-3-Clause"]),
        (bsd + name.format("the copyright holder"), ["BSD-3-Clause"]),
        (bsd, ["BSD-2-Clause"]),
        ("Licensed under the GNU General Public License, version 2 or later.", ["GPL-2.0-or-later"]),
        ("licensed under the GNU General Public License version 2 (or, at your option, any later version)", ["GPL-2.0-or-later"]),
        ("Licensed under the GNU General Public License, version 2.", ["GPL-2.0-only"]),
        ("released under the GNU Lesser General Public License version 3 or any later version", ["LGPL-3.0-or-later"]),
        ("It is not licensed under the MIT license.", []),
        ("This was never released under the MIT License; it is released under the ISC License.", ["ISC"]),
        ("# SPDX-License-Identifier: MIT", ["MIT"]),
        ("/* SPDX-License-Identifier: (apache-2.0 OR MIT) AND LicenseRef-x */ x", ["Apache-2.0", "LicenseRef-x", "MIT"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0\nMIT", ["GPL-2.0-or-later"]),
        ("SPDX-License-Identifier:", []),
        ("Licensed under the ISC licensee", []),
    ]
    rows = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [sorted(r["licenses"]) for r in rows] == [w for _, w in cases]


def test_every_known_sentence_is_found(spark):
    """The tree of words finds what a plain alternative of all sentences finds, in texts of joined and cut sentences."""
    r = np.random.default_rng(8)
    told = sorted(licenses.SENTENCES.values())
    plain = re.compile(r"(?<![a-z0-9])(?:" + "|".join(s.replace(" ", "[^a-z0-9]+") for s in sorted(told, key=len, reverse=True)) + ")(?![a-z0-9])")
    texts = told + [" ".join(told[i] if k % 3 else told[i][: int(r.integers(5, 60))] for k, i in enumerate(r.integers(0, len(told), 6))) for _ in range(200)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", licenses.sentences(F.col("t")).alias("s")).orderBy("i").collect()
    assert [x["s"] for x in got] == [[re.sub("[^a-z0-9]+", " ", m) for m in plain.findall(t)] for t in texts]


def test_wrapped_licenses(spark):
    import textwrap

    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    keep = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    wrapped = lambda s, mark="": textwrap.fill(s, 72, initial_indent=mark, subsequent_indent=mark)
    texts = [f"{wrapped(grant)}\n\n{wrapped(keep)}", wrapped(lgpl, " * "), "This file is released under the MIT License."]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licenses"] for r in rows] == [["MIT"], ["LGPL-2.1-or-later"], ["MIT"]]


@pytest.mark.parametrize("block", [(1024, 8192), (3, 40)])
def test_top_k(spark, monkeypatch, block):
    """Ties, copies of a vector and of rows, mixed dimensions, large and unfit components, clashing columns."""
    monkeypatch.setattr(vafile, "QUERY_BLOCK", block[0])
    monkeypatch.setattr(vafile, "VECTOR_BLOCK", block[1])
    r = np.random.default_rng(1)
    v = r.integers(-300, 300, (400, 8))
    v[50] = v[60] = v[70]
    v[200:330] = v[200]
    v[100] = v[110] = 0
    v[7] *= 10**5
    rows = [(i, row.tolist()) for i, row in enumerate(v)] + [(50, v[50].tolist()), (50, v[50].tolist()), (300, v[300].tolist()), (350, v[1].tolist()), (500, [5, 6, 7]), (501, [7, 7, 7]), (550, [1])]
    data = [(i, [float(x) / 256 for x in row], i, "x") for i, row in rows] + [(900, None, 0, ""), (901, [None] * 8, 0, ""), (902, [float("nan")] * 8, 0, ""), (903, [], 0, ""), (950, [1e300] * 8, 0, ""), (None, [1.0] * 8, 0, "")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, q long, rows string")
    ints = vafile.integers(df)
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in vafile.top_k(ints, ints.filter("vec_id % 50 = 0")).collect())
    want = []
    for a, (i, q) in enumerate(rows):
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, w, strict=True)), j) for b, (j, w) in enumerate(rows) if a != b and len(q) == len(w))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    none = ints.filter("vec_id < 0")
    assert vafile.top_k(none, none).count() == 0


def test_top_k_of_great_vectors(spark):
    """Finite components take part however great they are; scores that aren't longs are null, and ranked by what they are."""
    r = np.random.default_rng(3)
    v = r.integers(-9, 9, (60, 4)).astype(float)
    v[3], v[50], v[7] = [3e6, 0, 0, 0], [3e38, -3e38, 1, 0], [2.0**31, 2.0**31, -(2.0**31), 0]
    v[11], v[12], v[0] = [2.0**60, 1, 0, 0], [2.0**60, 0, 1, 0], [1, 1, 1, 1]
    v = v.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    ints = vafile.integers(df)
    got = sorted(tuple(x) for x in vafile.top_k(ints, ints.filter("vec_id in (0, 3, 50)")).select("query_id", "rank", "vec_id", F.coalesce(F.col("score").cast("string"), F.lit(""))).collect())
    exact = [[int(np.floor(256 * x)) for x in row] for row in v]
    want = []
    for q in (0, 3, 50):
        best = sorted((-sum(x * y for x, y in zip(exact[q], exact[j], strict=True)), j) for j in range(60) if j != q)[:5]
        want += [(q, k + 1, j, str(-s) if -(2**63) <= -s < 2**63 else "") for k, (s, j) in enumerate(best)]
    assert got == want and any(w[3] == "" for w in want)


def test_limbs(spark):
    some = sorted({s * (1 << k) + d for s in (1, -1) for k in (0, 1, 61, 62, 63, 64, 124, 186, 300) for d in (-1, 0, 1)})
    told = [vafile.limbs(x) for x in some]
    assert told == sorted(told)
    back = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "i int, t array<long>").select("i", vafile.whole(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in back] == [x if -(2**63) <= x < 2**63 else None for x in some]
    near = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "i int, t array<long>").select("i", vafile.rounded(F.col("t")).alias("x")).orderBy("i").collect()
    assert all(abs(r["x"] - x) <= 1 + 1e-15 * abs(x) for r, x in zip(near, some, strict=True))


def base(t):
    def luhn(d):
        return sum((n := int(c) * (1 + i % 2)) - 9 * (n > 9) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    forms = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))), (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    return sorted((m.start(), k, m.end()) for k, (p, fits) in enumerate(forms) for m in re.finditer(p, t or "") if fits(m[0]))


def test_pii(spark, tmp_path):
    texts = ["a@b.c_d@e.f g@h", "1.2.3.4.5.6.7.8 999.1.1.1.1 +1 (222) 333-4444", None, "", "😀 1.2.3.4 +123456789 é@x.y ü.z@q.rs.tu", "9" * 20000, "1.1." * 500, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" 4785380592391139', "plain words only and nothing else-where 2024", "token: ghp_aB3xQ4111111111111111kZ8d x", "password='" + "QwErTyUiOp" * 7 + "4k7Z2m9X'", "iban DE89370400440532013000, serial DE88370400440532013000."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    rows = pii.detect(spark.read.parquet(str(tmp_path / "t"))).withColumn("red", pii.redacted(F.col("text"), F.col("spans"))).orderBy("doc_id").collect()
    assert [[tuple(s) for s in r["base"]] for r in rows] == [base(t) for t in texts]
    assert len(rows[7]["base"]) == 1 and rows[7]["red"] == 'token = "[SECRET]" [CARD]'
    assert rows[8]["red"] == texts[8] and rows[0]["red"] == "[EMAIL][EMAIL] g@h"
    # A secret around a base span, one whose first digit comes late, and an IBAN; a wrong IBAN isn't one.
    assert rows[9]["red"] == "token: [SECRET] x" and len(rows[9]["base"]) == 1
    assert rows[10]["red"] == "password='[SECRET]'" and rows[11]["red"] == "iban [IBAN], serial DE88370400440532013000."


def test_pii_scores_as_trained(spark, tmp_path):
    """Expressions and training see the same features; held-out precision and recall of what the thresholds select."""
    for kind, least in (("secret", 0.6), ("number", 0.8), ("iban", 0.9)):
        trees, threshold = pii.model(kind)
        x, y = pii._examples(kind, 2000, 3)
        score = np.array([pii.RATE * sum(pii.evaluate(t, row) for t in trees) for row in x])
        chosen = score >= threshold
        assert np.isfinite(threshold) and y[chosen].mean() >= 0.95 and chosen[y == 1].mean() >= least
    cases = [("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", 'token = "'), ("number", "(415) 555-2671", "tel. "), ("iban", "DE89 3704 0044 0532 0130 00", "iban "), ("secret", "some-long-words-2019", "the page ")]
    spark.createDataFrame(cases, "kind string, m string, before string").write.parquet(str(tmp_path / "c"))
    df = spark.read.parquet(str(tmp_path / "c"))
    for kind, m, before in cases:
        got = df.filter((F.col("m") == m)).select(pii.scored(F.col("m"), F.col("before"), kind)).first()[0]
        assert abs(got - pii.RATE * sum(pii.evaluate(t, pii.features(m, before, kind)) for t in pii.model(kind)[0])) < 1e-6


def test_packing(docs, none, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    for x in [*filter(None, TEXTS), "It's Ünï İ ß ½²3 'LL", "日本 <|endoftext|>", "a\x1cb\x85c"]:
        assert np.frombuffer(packing.encode(x, packing.vocabulary()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    rows = packing.pack(packing.pieces(docs)).collect()
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert packing.pack(packing.pieces(none)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=20), st.sampled_from(["norm", "dot"]), st.integers(2, 60))
def test_plan(counts, score, most_docs):
    bins = {}
    for n, lo, hi, per, seq, off in packing.plan(counts, 50, most_docs, score=score):
        for rank in range(lo, hi):
            bins.setdefault(seq + (rank - lo) // per, []).append((off + (rank - lo) % per * n, n))
    assert sum(map(len, bins.values())) == sum(counts.values())
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= 50 and len(b) <= most_docs and sum(n * n for _, n in b) <= 2500


def test_near_duplicates(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", "a", "a", "A", "b c"]
    for _ in range(12):
        text = list(r.choice(words, 60))
        for _ in range(8):
            copy = text[:]
            for k in r.integers(0, 60, r.integers(0, 4)):
                copy[k] = str(r.choice(words))
            texts.append(" ".join(copy))
    rows = {x["doc_id"]: x for x in minhash.group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w)} if 0 < len(w) < 3 else set(zip(w, w[1:], w[2:], strict=False)))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in product(range(len(texts)), repeat=2):
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert [(rows[i]["n_shingles"], rows[i]["component_id"]) for i in range(len(texts))] == [(len(s), find(i)) for i, s in enumerate(sets)]
    assert minhash.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_through_a_close_class(spark):
    """x is like z, which is 99% like the pivot p, but not like p: what x and z share beyond p isn't x's own."""
    texts = []
    for g in range(12):
        w = lambda a, b: " ".join(f"g{g}w{i}" for i in range(a, b))  # noqa: B023, E731
        copies = [f"{w(0, k)} g{g}c{k} {w(k + 1, 102)}" for k in range(5, 100, 12)]
        texts += [w(0, 102), w(0, 103), w(0, 120), *copies]
    rows = {x["doc_id"]: x["component_id"] for x in minhash.group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows == {i: i - i % 11 for i in range(len(texts))}


def test_near_duplicates_of_the_pipeline(spark):
    """An addition of 22% is a near duplicate at five words and 0.8, one of 30% isn't."""
    import corpus_pipeline

    w = lambda g, n: " ".join(f"g{g}w{i}" for i in range(n))
    texts = [w(0, 104), w(0, 126), w(1, 104), w(1, 134), None, ""]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 3, 4, 5]


def test_sentencepiece():
    c = pieces.codec(pieces.vocabulary())
    score = {p: s for p, s, k in c.pieces if k in (pieces.NORMAL, pieces.USER)}

    def best(t):
        table = [0.0] + [float("-inf")] * len(t)
        for j in range(1, len(t) + 1):
            table[j] = max([table[i] + score[t[i:j]] for i in range(max(0, j - 20), j) if t[i:j] in score] + ([table[j - 1] + c.unknown] if t[j - 1] not in score else []))
        return table[-1]

    for t in ["Hello world", "  two  spaces ", "été 😀 ▁ x\n\ny", "", "a" * 300, "日本語 mixed"]:
        ids = c.encode(t).tolist()
        assert c.decode(ids) == t
        if t and "▁" not in t:
            unknown = sum(1 for ch in t if ch not in score and ch != " ")
            got = sum(c.score[i] for i in ids if c.pieces[i][2] != pieces.BYTE) + unknown * c.unknown
            assert abs(got - best("▁" + t.replace(" ", "▁"))) < 1e-3
    parts = ["▁the", "▁", "日本語", "é😀x", "▁▁▁▁ü", "\n", "a", "▁" + "ab" * 31]
    assert c.segment(parts) == [np.array(c.viterbi(p), "<i4").tobytes() for p in parts]
    assert [x.tolist() for x in c.encode_all([None, "", "x y", "z" * 500])] == [[], [], c.encode("x y").tolist(), c.encode("z" * 500).tolist()]


def test_sentencepiece_of_a_table(spark, docs, none):
    df = docs.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x")).union(docs.filter("doc_id = 0").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x")))
    rows = sorted(pieces.encoded(df).collect(), key=lambda r: r["doc_id"])
    c = pieces.codec(pieces.vocabulary())
    assert [r["doc_id"] for r in rows] == [0, *range(len(TEXTS))] and rows[0]["ids"] == rows[1]["ids"]
    for r in rows[1:]:
        t = TEXTS[r["doc_id"]] or ""
        assert r["decoded"] == t and r["ids"] == c.encode(t).tolist()
    assert pieces.encoded(none).count() == 0


def test_media_features(spark):
    """Against a direct Fourier transform, one frame at a time; the last text has more frames than a chunk."""
    texts = ["lorem ipsum dolor " * 50, "ab" * 700, "\u00e9" * 900, "z", "one two three four five " * 35_000]
    rows = {r["doc_id"]: r for r in media.to_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.WINDOW) / (media.WINDOW - 1))
    basis = np.exp(-2j * np.pi * np.outer(np.arange(media.WINDOW // 2 + 1), np.arange(media.WINDOW)) / media.WINDOW)
    for i, t in enumerate(texts):
        data = t.encode()
        x = np.frombuffer(data + b"\xff" * (-len(data) % 576), np.uint8).astype(float)
        at = range(0, len(x) - media.WINDOW + 1, media.HOP)
        assert i < 4 or len(at) > media.CHUNK
        peaks = [[int(p) for p in media.peaks(bytes(rows[i]["payload"]))[k]] for k in range(len(at))]
        for k in range(0, len(at), 1 if i < 4 else 997):
            frame = x[at[k] : at[k] + media.WINDOW]
            power = np.abs(basis @ ((frame - frame.mean()) * window))
            power[: media.LOWEST] = -1
            best = sorted(power, reverse=True)[: media.PEAKS]
            assert len(set(peaks[k])) == media.PEAKS and min(peaks[k]) >= media.LOWEST
            assert all(abs(power[p] - b) < 0.07 + 1e-4 * b for p, b in zip(peaks[k], best, strict=True))
        pairs = [(k, peaks[k][0] << 16 | p << 4 | dt) for k in range(len(at)) for dt in range(1, media.FAN + 1) if k + dt < len(at) for p in peaks[k + dt]]
        assert list(zip(rows[i]["fp_time"], rows[i]["fp_code"], strict=True)) == pairs


def test_wrappers(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li>m</li></ul></nav><div class='cookie notice'>c</div><{0}><h1>H &amp; {1}</h1><p>one {1}<p>two <b>bold</b>\n x<br>y</p><form>f</form></{0}><div id=comments><p>reader</p></div><footer>F</footer></body></html>"
    rows = [(i, f"http://{'ab'[i % 2]}.org/{i}", page.format(["article", "div class=post"][i % 2], i).replace("</div class=post>", "</div>")) for i in range(6)] + [(6, None, None), (7, "http://c.org", "")]
    out = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i] for i in range(6)] == [f"H & {i}\none {i}\ntwo bold x y" for i in range(6)] and out[6] == out[7] == ""


def test_wrappers_drop_constant_blocks():
    page = "<html><body><div class=top>Our town's paper since 1901</div><div class=story>{0}<p>Write to us at any time</p></div></body></html>"
    pages = [page.format("".join(f"<p>story {i} has a sentence numbered {k} of its own</p>" for k in range(2 + i))) for i in range(4)]
    w = wrappers.infer(pages)
    want = "\n".join(f"story 1 has a sentence numbered {k} of its own" for k in range(3))
    assert wrappers._main(w["main"]) == ("div[class=story]",) and wrappers.extract(pages[1], wrappers._main(w["main"]), wrappers._fixed(w["fixed"])) == want


@pytest.mark.parametrize("page", ["<body class='single has-sidebar'><article>{}</article></body>", "<body><div class='content-with-sidebar'>{}</div></body>", "<body><div class='no-sidebar'><article class='post comments-open'>{}</article></div></body>"])
def test_wrappers_spare_the_article(page):
    html = page.format("<p>one <span>two</span></p><pre>x <span class='hljs-comment'># y</span></pre><div class='share-buttons'>s</div>")
    assert wrappers.extract(html, wrappers.main_of([html])) == "one two\nx # y"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<html><head><title>t</title><meta name=a><body><article>Hello</article>", "Hello"),
        ("<body class='page no-sidebar'><p>Hello</p></body>", "Hello"),
        ("<body><article class='post ad-free'>Hello</article></body>", "Hello"),
        ("<body><article><p title='a>b'>Hello</p></article></body>", "Hello"),
        ("<body><article class=a>one two three</article><article class=b>four five six</article></body>", "one two three\nfour five six"),
        ("<body><p title=\"x>y</p><p>broken &amp; open", "y\nbroken & open"),
        ("", ""),
        ("<", "<"),
        ("plain &lt;words&gt;", "plain <words>"),
        ("<p>one<p>two", "one\ntwo"),
    ],
)
def test_wrappers_on_ordinary_markup(html, want):
    assert wrappers.extract(html, wrappers.main_of([html])) == want


def test_wrappers_align_like_a_plain_aligner(monkeypatch):
    """Optional groups, slots and repeats; tables whose rows are computed again give what one table gives."""
    r = np.random.default_rng(5)
    def page(n):
        rows = "".join(f"<tr><td>{r.integers(1e9)}</td></tr>" for _ in range(int(r.integers(1, 4))))
        ad = "<div class=extra><b>offer</b></div>" if n % 2 else ""
        return f"<body><h1>site</h1>{ad}<article><p>story {r.integers(1e9)}</p><table>{rows}</table></article><p>end</p></body>"
    pages = [page(n) for n in range(6)]
    whole = wrappers.infer(pages)
    assert "(<div[class=extra]><b>offer</b></div>)?" in whole["expression"].replace("\\", "") or "(<div[class=extra]><b>#</b></div>)?" in whole["expression"]
    assert ")+" in whole["expression"] and wrappers._main(whole["main"]) == ("article",)
    long = [f"<body><div id=menu>{''.join(f'<a href=x>link {k}</a><hr>' for k in range(40))}</div><article>" + "".join(f"<h2>part {n} {k}</h2><p>text {n} {k} {r.integers(1e9)}</p>" for k in range(30)) + "</article></body>" for n in range(4)]
    want = wrappers.infer(long)
    monkeypatch.setattr(wrappers, "TABLE_BITS", 1000)
    got = wrappers.infer(long)
    assert got == want
    for p in long:
        texts = [wrappers.extract(p, wrappers._main(w["main"]), wrappers._fixed(w["fixed"])) for w in (want, got)]
        assert texts[0] == texts[1] == "\n".join(re.findall(r"<(?:h2|p)>([^<]*)<", p))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14), st.sampled_from([1, 1 << 20]))
def test_common_subsequence(a, b, bits):
    """As long as the quadratic table says, rising in both, and equal."""
    wrappers.TABLE_BITS, was = bits, wrappers.TABLE_BITS
    found = wrappers.common(a, b)
    wrappers.TABLE_BITS = was
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    assert len(found) == n[-1][-1] and all(a[i] == b[j] for i, j in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<body><div class='page login'><article>Hello</article></div></body>", "Hello"),
        ("<body><div class='widget'><article>Hello there</article></div></body>", "Hello there"),
        ("<body class='page'><div class='login'><p>Hello</p></div></body>", "Hello"),
        ("<body><article>Hello all of you</article><div class=comments><article class=comment>me too</article><article>and me</article></div></body>", "Hello all of you"),
        ("<body><article>Hello all of you</article><div class=widget>buy</div></body>", "Hello all of you"),
    ],
)
def test_words_do_not_empty_pages(html, want):
    assert wrappers.extract(html, wrappers.main_of([html])) == want


def test_constant_headings_stay():
    page = "<body><div class=site>Cooking since 1901</div><article><h1>Dish {0}</h1><h2>Ingredients</h2><p>{0} eggs and {0} nuts</p><h2>Method</h2><p>Stir {0} times, then wait {0} hours</p><p>Write to the cook</p></article></body>"
    pages = [page.format(f"n{k}{'x' * k}") for k in range(5)]
    w = wrappers.infer(pages)
    assert wrappers.extract(pages[2], wrappers._main(w["main"]), wrappers._fixed(w["fixed"])) == "Dish n2xx\nIngredients\nn2xx eggs and n2xx nuts\nMethod\nStir n2xx times, then wait n2xx hours"


def test_slots_decide_against_names():
    """Constant articles beside a plain element that varies; a menu of other class names; one page alone goes by names."""
    page = "<body><div class=items><span>Home of news</span><span>Places and people</span></div><article>Our ten best stories of the year, told again for you and all your friends</article><div class=text><p>{}</p><p>{}</p></div></body>"
    pages = [page.format(f"story {k} " * (5 + k), f"more of {k} " * 6) for k in range(4)]
    w = wrappers.infer(pages)
    assert wrappers._main(w["main"]) == ("div[class=text]",)
    assert wrappers.extract(pages[1], wrappers._main(w["main"]), wrappers._fixed(w["fixed"])) == f"{('story 1 ' * 6).strip()}\n{('more of 1 ' * 6).strip()}"
    assert wrappers.main_of(pages[:1]) == ("article",)


def test_wrappers_by_salt(spark, monkeypatch):
    rows = [(i, f"http://a.org/{i}" if i % 5 else None, f"<body><article><p>story {i}</p></article></body>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("main", F.lit("x"))
    want = sorted(tuple(x) for x in wrappers.main_text(df).collect())
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    assert sorted(tuple(x) for x in wrappers.main_text(df).collect()) == want and want[1][2] == "story 1"
    assert wrappers.main_text(df.filter("page_id < 0")).count() == 0


def test_digest_of_tokens():
    assert zlib.crc32(packing.encode("a", packing.vocabulary())) >= 0 and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_pieces_of_texts_over_a_sequence(spark):
    """Texts of more than 4096 tokens: full pieces and a last one, whose ids are the library's."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    texts = ["word " * 4095, "word " * 4096, "one two three " * 4000, "short", None, "naïve “quoted” – 日本 " * 1500]
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).orderBy("doc_id", "piece").collect()
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        own = [x for x in rows if x["doc_id"] == i]
        cut = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        assert [(x["piece"], x["start"], x["length"], list(x["ids"])) for x in own] == [(k, 4096 * k, len(c), c) for k, c in enumerate(cut)]
        assert [x["ids_crc32"] for x in own] == [zlib.crc32(np.array(c, "<u4").tobytes()) for c in cut]
    assert [sum(x["doc_id"] == i for x in rows) for i in (0, 1)] == [1, 2]
    packed = packing.pack(spark.createDataFrame(rows).select("doc_id", "piece", "length")).collect()
    for s in {x["sequence_id"] for x in packed}:
        inside = sorted((x["offset"], x["length"]) for x in packed if x["sequence_id"] == s)
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))] and sum(n for _, n in inside) <= 4096

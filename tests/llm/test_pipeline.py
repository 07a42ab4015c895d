"""Every stage of the pipeline against brute force, with nulls, repeated rows, empty tables and columns of clashing names."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from protolith.llm import langid, pii

WORDS = {"en": "the cat and the dog are here with that house", "de": "der hund und die katze sind nicht hier im haus", "fr": "le chien et la maison des rues est ici"}
PASSAGE = " ".join(f"shared{i}" for i in range(40))


def texts():
    out = []
    for i in range(24):
        lang = sorted(WORDS)[i % 3]
        out.append((i, " ".join(f"{WORDS[lang]} n{i}x{k}" for k in range(12)), lang))
    copy = out[1][1].split()
    out += [(30, out[0][1], None), (31, " ".join(copy[:-3]), "de"), (32, f"{out[2][1]} {PASSAGE} tail of one", "fr"), (33, f"{PASSAGE} {out[5][1][::-1]}", "fr")]
    out += [(34, "mail me at ann.b@example.org or +1 (222) 333-4444, the cat and the dog are here", "en"), (35, None, "en"), (36, "", None), (37, "12 !?", "en"), (None, out[3][1] + " other", "en")]
    return out


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("p") / "d")
    rows = [(i, t, lang, "s", len(t or ""), "a", 1, "k", [1], 2, "b", "m", "h", "c") for i, t, lang in texts()]
    names = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept int, ranges string, n_bytes array<int>, th int, base string, _masked string, host string, carried string"
    spark.createDataFrame([*rows, rows[4]], names).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def kept_columns(docs, out):
    assert out.columns == docs.columns
    for r in out.collect():
        assert (r["spans"], r["kept"], r["ranges"], r["n_bytes"], r["th"], r["base"], r["_masked"], r["host"], r["carried"]) == ("a", 1, "k", [1], 2, "b", "m", "h", "c")


def test_language(spark, docs):
    out = corpus_pipeline.language(spark, docs, "")
    kept_columns(docs, out)
    model = langid.model_of(docs)
    found = {i: langid.predict(model, [t])[0] for i, t, _ in texts()}
    want = [(i, t) for i, t, _ in [*texts(), texts()[4]] if t and any(c.isalpha() for c in t) and found[i][1] >= langid.LEAST_SCORE]
    assert rows_of(out) == sorted(want, key=repr)
    assert all(r["lang"] == found[30][0] for r in out.filter("doc_id = 30").collect())
    german = corpus_pipeline.language(spark, docs, "", ["de"])
    assert {r["doc_id"] for r in german.collect()} == {i for i, t, _ in texts() if found[i][0] == "de" and found[i][1] >= langid.LEAST_SCORE}
    # Without labels nothing is told apart, and nothing with a letter goes.
    bare = corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    assert rows_of(bare) == sorted(((i, t) for i, t, _ in [*texts(), texts()[4]] if t and any(c.isalpha() for c in t)), key=repr)


def near(rows, width=5, level=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= level * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)), key=lambda k: rows[k][0])
                root[y] = x
    out = {r for k, r in enumerate(rows) if rows[find(k)][0] == r[0]}
    return sorted(out, key=repr)


def test_near_duplicates(spark, docs):
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    kept_columns(docs, out)
    assert rows_of(out) == near([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {30, 31}.isdisjoint(r["doc_id"] for r in out.collect())


def test_near_duplicates_of_one_id(spark):
    """Two texts of one doc_id are documents of their own; equal rows leave one."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (1, b), (1, a), (2, b), (0, a), (3, None), (3, None)], "doc_id long, text string")
    assert rows_of(corpus_pipeline.near_duplicates(spark, df, "")) == [(0, a), (1, b), (3, None)]


def test_repeated_passages(spark, docs):
    out = corpus_pipeline.repeated_passages(spark, docs, "")
    kept_columns(docs, out)
    data = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    seen = {}
    for _, d in data:
        for k in range(len(d) - 199):
            seen[d[k : k + 200]] = seen.get(d[k : k + 200], 0) + 1
    want = []
    for i, d in data:
        gone = set()
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        want.append((i, bytes(x for k, x in enumerate(d) if k not in gone).decode("utf-8", "replace")))
    assert rows_of(out) == sorted(want, key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_personal_data(spark, docs):
    out = corpus_pipeline.personal_data(spark, docs, "")
    kept_columns(docs, out)
    spans = {r["doc_id"]: r["spans"] for r in pii.detect(docs).collect()}
    for r in out.collect():
        if r["doc_id"] == 34:
            assert r["text"] == "mail me at [EMAIL] or [PHONE], the cat and the dog are here" and len(spans[34]) == 2
        elif not spans[r["doc_id"]]:
            assert r["text"] == ({i: t for i, t, _ in texts()}[r["doc_id"]])


def test_sequences(spark, docs):
    rows = corpus_pipeline.sequences(spark, docs, "").collect()
    assert len(rows) == docs.count()
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    total = sum(r["length"] for r in rows)
    assert len(at) == -(-total // 4096)


def test_run_and_empty_tables(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 20 and "sequence_id" in out.columns
    none = docs.filter("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, "")
        assert got.count() == 0, name

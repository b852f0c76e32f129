"""Operators over small tables: nulls, empty and repeated rows, ties, clashing names, empty tables."""

import pytest

import corpus_pipeline
from roomlake.llm import bpe, covertree, impact, kdshard, langid, mincut, minhash, packing, suffix, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed: int, n: int = 40) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + str((seed + i) % 9) for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = text(3, 60)
    rows = [(1, base), (2, base), (3, base + " end"), (4, text(5)), (5, None), (6, ""), (7, "   "), (8, "One"), (9, "one"), (10, text(11) + " " + base), (11, text(5).upper()), (12, base)]
    return spark.createDataFrame([(i, t, "en", f"src{i % 2}", 0 if t is None else len(t), "x", i) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, component_id long")


def test_near_duplicates(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, shingle=2).collect()}
    assert len(got) == 12 and {got[i][1] for i in (1, 2, 3, 12)} == {1} and got[4][1] == got[11][1] == 4 and got[8][1] == got[9][1] == 8
    assert got[5] == (0, 5, True) and got[6][0] == got[7][0] == 0 and got[10][2]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_repeats(spark, docs):
    want = suffix.brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest(suffix.repeated_spans(docs)).collect()}
    assert got == want
    assert suffix.repeated_spans(docs.limit(0)).count() == 0
    cut = {r.doc_id: r.text for r in suffix.without_repeats(docs).collect()}
    assert cut[1] == text(3, 60) and cut[2] == "" and cut[5] is None


def test_many_contexts_take_the_other_way(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix, "MANY", 1)
    want = suffix.brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest(suffix.repeated_spans(docs)).collect()}
    assert got == want


def test_shards(spark, docs):
    rows = kdshard.shards(docs, 4).collect()
    assert len(rows) == 12 and {r.shard for r in rows} <= set(range(4))
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.doc_id: r.size for r in rows}[5] == 16
    assert kdshard.shards(docs.limit(0), 4).count() == 0


def test_packing_table(spark, docs):
    out = packing.packed(packing.sized(docs), capacity=200).collect()
    assert {r.doc_id for r in out} == set(range(1, 13)) and packing.packed(packing.sized(docs.limit(0))).count() == 0


def test_language(spark, docs):
    many = spark.createDataFrame([(i, text(i), "en") for i in range(40)] + [(100 + i, " ".join(w[::-1] for w in text(i).split()), "xx") for i in range(40)] + [(200, None, "en"), (201, "123 !!", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(many, langid.fit(many)).collect()}
    assert got[3].lang_pred == "en" and got[103].lang_pred == "xx" and got[200].lang_pred == got[201].lang_pred == "und" and got[200].score == 0
    assert langid.predict(docs, langid.fit(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_toxicity(spark, docs):
    many = spark.createDataFrame([(i, text(i) + (" stupid idiot trash" if i % 4 == 0 else "")) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.severity(many, toxicity.fit(many, labels)).collect()}
    assert all((got[i].p_toxic >= 0.5) == (i % 4 == 0) for i in range(80)) and all(0 <= r.severity <= 3 for r in got.values())
    assert toxicity.severity(docs, toxicity.fit(docs, labels.limit(0))).filter("p_toxic > 0.5").count() == 0


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.1]), (50, [1.0, None]), (100, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(df).collect()}
    assert got[0] == (2, 0, True) and got[1] == (2, 0, False) and got[6] == (2, 0, False) and got[3] == (0, 3, True) and got[4] == (0, 4, True) and len(got) == 9
    top = [(r.query_id, r.rank, r.vec_id, r.score) for r in impact.top_k(df, 2).orderBy("query_id", "rank").collect()]
    assert top == [(0, 1, 1, 131072), (0, 2, 6, 65536), (100, 1, 1, 65536), (100, 2, 6, 35968)]
    assert covertree.near_duplicates(df.limit(0)).count() == 0 and impact.top_k(df.limit(0)).count() == 0


def test_pages_and_tokens(spark, docs):
    pages = spark.createDataFrame([(1, "u", "<article><p>Hello, world.</p></article>", 5), (2, None, None, 5)], "page_id long, url string, html string, n_chars int")
    assert {r.page_id: (r.text, r.n_chars) for r in mincut.extract(pages).collect()} == {1: ("Hello, world.", 13), 2: ("", 0)}
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encoded(docs, path, tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decoded(ids, path, tokenizers.PATTERN).collect()}
    assert back == {r.doc_id: (r.text or "").encode() for r in docs.collect()}


def test_null_ids(spark, docs):
    lone = docs.selectExpr("cast(null as bigint) as doc_id", "text", "cast(null as string) as source").filter("text is not null")
    mixed = docs.select("doc_id", "text", "source").union(lone)
    assert mixed.count() == 23
    assert suffix.repeated_spans(mixed).count() == 23 and suffix.repeated_spans(mixed).filter("doc_id is null and size(spans) > 0").count() == 0
    assert packing.packed(packing.sized(mixed)).filter("doc_id is null").count() == 11
    assert kdshard.shards(lone, 3).count() == 11 and minhash.near_duplicates(mixed).count() == 23


def test_near_duplicate_stage_without_or_with_repeated_ids(spark):
    """One row of each group stays, whatever the ids: none, or one for several rows."""
    a, b, c = ("the quick brown fox jumps over the lazy dog again", "many rivers run slowly down to the wide open sea", "seven old ships sail past the harbour wall at dawn")
    rows = [(None, a), (None, b), (None, b), (1, c), (1, c), (2, c), (None, c), (3, "one more text that shares no words with others here"), (3, "a second row of that id and of other words entirely"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(None, a), (None, b), (1, c), rows[7], rows[8], (None, None)], key=repr)

"""The operators' tables, and the pipeline, against plain versions on a small corpus.

The corpus has nulls, empty and blank texts, one very long text, ties, repeated rows, rows without an
id, columns with the names that operators use inside, exact and near copies and shared passages.
"""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from roomlake.llm import alignment, covertree, impact, kdshard, langid, lexical, minhash, packing, subtrees, suffix, toxicity
from roomlake.llm.bytesops import mix, prefix, spans_hash

SYLLABLES = {"en": "the and ing er ou th st re on at", "xx": "zu qo vej kri blo nar ush pim dat wex"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h long, component_id long, kept boolean, size long"


def words(rnd, lang, n):
    return [rnd.choice(SYLLABLES[lang].split()) + rnd.choice(SYLLABLES[lang].split()) for _ in range(n)]


def corpus():
    rnd = random.Random(11)
    out = []
    for i in range(130):
        lang = "xx" if i % 3 == 0 else "en"
        out.append((i, words(rnd, lang, rnd.randrange(12, 60)), lang))
    base = out[1][1]
    for k in range(30):  # near and exact copies
        copy = list(base)
        for _ in range(k % 4):
            copy[rnd.randrange(len(copy))] = f"new{k}"
        out.append((200 + k, copy, "en"))
    passage = words(rnd, "en", 40)
    for k in range(20):  # a passage that many share
        out.append((300 + k, words(rnd, "en", 30) + passage + words(rnd, "en", 20), "en"))
    for k in range(16):  # toxic ones
        out.append((400 + k, words(rnd, "en", 12) + ["stupid", "idiot", "trash"] * 2 + words(rnd, "en", 12), "en"))
    texts = [(i, " ".join(w), lang) for i, w, lang in out]
    texts += [(500, None, "en"), (501, "", "en"), (502, "  \t ", "en"), (503, "I", "en"), (504, "123 !!", None), (505, "word", "en"), (506, "Word", "en")]
    texts += [(510, " ".join(words(rnd, "en", 30_000)), "en"), (511, texts[3][1], "en"), (511, texts[3][1], "en"), (511, texts[4][1] + " z", "en"), (None, texts[5][1], "xx"), (None, None, "en")]
    return [(i, t, lang, "hot" if k % 3 else f"s{k % 7}", None if t is None else len(t), "x", 1, 2, None, 3) for k, (i, t, lang) in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def components(nodes, linked):
    comp = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


def near_groups(keyed, k):
    """Of (key, text) the smallest key reachable."""
    sets = [(key, shingles(t, k)) for key, t in keyed]
    linked = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    return {key: len(s) for key, s in sets}, components([key for key, _ in sets], linked)


@pytest.mark.parametrize("paired", [256, 1])
def test_op8(spark, rows, docs, monkeypatch, paired):
    monkeypatch.setattr(minhash, "PAIRED", paired)
    keyed = [(k, r[1]) for k, r in enumerate(rows)]
    frame = spark.createDataFrame(keyed, "doc_id long, text string")
    sizes, comp = near_groups(keyed, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame, shingle=2).collect()}
    assert got == {k: (sizes[k], comp[k], comp[k] == k) for k in comp}


def test_op8_keeps_all_rows(rows, docs):
    assert minhash.near_duplicates(docs, shingle=5).count() == len(rows)


def naive_pack(items, capacity):
    """Best fit in so many words: of all open bins the tightest compatible one, ties to the older."""
    bins, out = [], []
    rest = []
    for k, (i, size, source, cluster) in enumerate(items):
        start = 0
        while size - start > capacity:
            bins.append([0, {source} - {None}, {cluster} - {None}, 1, False])
            out.append((len(bins) - 1, 0, k, start, capacity))
            start += capacity
        rest.append((-(size - start), i, k, start))
    for neg, _, k, start in sorted(rest):
        _, _, source, cluster = items[k]
        fits = [(b[0], n) for n, b in enumerate(bins) if b[4] and b[0] >= -neg and source not in b[1] and cluster not in b[2]]
        if fits:
            n = min(fits)[1]
        else:
            bins.append([capacity, set(), set(), 0, True])
            n = len(bins) - 1
        b = bins[n]
        out.append((n, b[3], k, start, -neg))
        b[0] += neg
        b[1] |= {source} - {None}
        b[2] |= {cluster} - {None}
        b[3] += 1
    return sorted(out)


def sized_rows(pairs):
    out = []
    for i, text, source in pairs:
        plain = re.sub(r"[\s]+", " ", (text or "").lower()).strip(" ")
        out.append((i, len((text or "").encode()), source, plain or None))
    return out


def test_op1(rows, docs):
    capacity = 900
    got = sorted((r.bin_id, r.slot, -1 if r.doc_id is None else r.doc_id, r.start, r.length) for r in packing.packed(packing.sized(docs), capacity=capacity).collect())
    items = sorted(sized_rows([(r[0], r[1], r[3]) for r in rows]), key=lambda x: (x[0] or 0, x[0] is None, x[1], x[2] or ""))
    # ties of one id: by id, then in the order of the operator (no id, size, source, cluster)
    want = naive_pack([((i or 0), *rest) for i, *rest in items], capacity)
    named = sorted((n, slot, -1 if items[k][0] is None else items[k][0], start, length) for n, slot, k, start, length in want)
    assert sum(g[4] for g in got) == sum(w[4] for w in named) == sum(len((r[1] or "").encode()) for r in rows)
    assert got == named


def test_op1_keeps_near_copies_apart(rows, docs):
    capacity = 900
    got = sorted((r.bin_id, r.slot, -1 if r.doc_id is None else r.doc_id, r.start, r.length) for r in packing.packed(packing.clustered(docs), capacity=capacity).collect())
    comp = near_groups([(k, r[1]) for k, r in enumerate(rows)], 5)[1]
    items = [(r[0], len((r[1] or "").encode()), r[3], comp[k]) for k, r in enumerate(rows)]
    items.sort(key=lambda x: (x[0] or 0, x[0] is None, x[1], x[2] or ""))
    want = naive_pack([((i or 0), *rest) for i, *rest in items], capacity)
    assert got == sorted((n, slot, -1 if items[k][0] is None else items[k][0], start, length) for n, slot, k, start, length in want)
    plain = [t for *_, t in sized_rows([(r[0], r[1], r[3]) for r in rows])]
    assert len({comp[k] for k, t in enumerate(plain) if t}) < len(set(plain) - {None})  # near copies count as one cluster


def test_op3(rows, docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    train = [(r[1], r[2]) for r in rows if r[0] is not None and not held(r[0]) and r[1] and r[2]]
    filters = langid.fit(docs.filter("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
    got = [(r.doc_id, r.text, r.lang, r.lang_pred, r.score) for r in langid.predict(docs, filters).collect()]
    assert len(got) == len(rows)
    plain = lambda t: re.sub(r"[^a-z\x80-\U0010ffff]+", " ", t.lower()).strip()

    def grams(text, lone):
        t = f" {plain(text)} "
        four = [t[i : i + 4] for i in range(len(t) - 3)]
        alone = re.findall(r"(?<= )[a-z](?= )", t)
        return four + (alone if lone or not four else [])

    known = {}
    for lang in {x for _, x in train}:
        texts = [set(grams(t, True)) for t, x in train if x == lang]
        counts = defaultdict(int)
        for s in texts:
            for g in s:
                counts[g] += 1
        known[lang] = {g for g, n in counts.items() if n >= max(1.0, langid.SUPPORT * len(texts))}
    right = 0
    for i, text, lang, pred, score in got:
        if not text or not re.search("[A-Za-z]", text):
            assert pred == "und" and score == 0
            continue
        share = {x: sum(g in known[x] for g in grams(text, False)) / len(grams(text, False)) for x in known}
        assert pred == max(sorted(share), key=share.get)
        assert abs(score - share[pred] / max(1e-12, sum(share.values()))) < 0.02
        right += pred == lang
    assert right >= 0.97 * sum(bool(r[1] and re.search("[A-Za-z]", r[1])) for r in rows)


def plain_severity(model, text):
    """Probabilities of a text, word by word."""
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    h = lambda b: spans_hash(prefix(np.frombuffer(b, np.uint8)), np.array([0]), np.array([len(b)]))
    found = set()
    for w in re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode()):
        found.add(int(h(w)[0]))
        if len(w) > toxicity.PREFIX:
            found.add(int(mix(h(w[: toxicity.PREFIX]) ^ np.uint64(0xFEED))[0]))
    score = sum(weight.get(f, 0.0) for f in found)
    return 1 / (1 + np.exp(-np.clip(score - model.thresholds, -30, 30)))


def toxic_labels(rows):
    return [(r[0], int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] % 2 == 0]


def test_op4(spark, rows, docs):
    labels = spark.createDataFrame(toxic_labels(rows) + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.severity(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        p = plain_severity(model, r.text)
        assert abs(r.severity - p.sum()) < 1e-9 and abs(r.p_toxic - p[0]) < 1e-9 and r.grade == int((p >= 0.5).sum())
        assert (r.p_toxic >= 0.5) == ("idiot" in (r.text or ""))


def test_op5(spark, rows, docs):
    got = kdshard.shards(docs, 5).collect()
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == want
    many = spark.range(6000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 as int) * 11) as text", "if(id % 3 = 0, 'hot', cast(id % 50 as string)) as source")
    out = kdshard.shards(many, 8).collect()
    size, slots = defaultdict(int), defaultdict(list)
    for r in out:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 8
    assert sorted(size) == list(range(8)) and max(size.values()) < 1.02 * mean and min(size.values()) > 0.98 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def vectors(rnd, n=260, d=8):
    x = rnd.normal(size=(n, d))
    x[100:160] = x[0] + 0.03 * rnd.normal(size=(60, d))
    x[160:170] = 3 * x[1]
    return x.astype(np.float32)


def test_op2_and_op7(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 40)
    monkeypatch.setattr(covertree, "PIVOTS", 4)
    monkeypatch.setattr(impact, "BLOCK", 60)
    monkeypatch.setattr(impact, "PART", 2)
    x = vectors(np.random.default_rng(3))
    table = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, [0.0] * 8), (301, None), (302, [1.0, None] * 4), (303, [float("nan")] * 8), (304, [1.0] * 3), (305, []), (None, [1.0] * 8), (None, x[0].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in table], "vec_id long, embedding array<float>, rep string, id int, n_links int").repartition(4)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    comp = components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(hit)) if a < b])
    got = sorted(((-1 if r.vec_id is None else r.vec_id), r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(df).collect())
    want = [(-1, 0, None, True)] * 2 + [(i, int(hit[i].sum()) - 1, comp[i], comp[i] == i) for i in range(len(x))] + [(i, 0, i, True) for i in range(300, 306)]
    assert got == want

    # the zero vector has scores like any other; one length more stands alone
    whole = np.concatenate([np.floor(x.astype(float) * 256), np.zeros((1, 8))])
    ids = [*range(len(x)), 300]
    top = defaultdict(list)
    for r in impact.top_k(df, 5, every=50).orderBy("query_id", "rank").collect():
        top[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(top) == [0, 50, 100, 150, 200, 250, 300]
    for q in top:
        s = whole @ whole[ids.index(q)]
        best = sorted((-int(v), i) for v, i in zip(s, ids) if i != q)[:5]
        assert top[q] == [(k + 1, i, -v) for k, (v, i) in enumerate(best)]


def test_op2_sends_each_block_a_few_times(spark):
    """All 2,016 pairs of 64 blocks meet once, and blocks are sent a few times each, not once a pair."""
    body = ("scale", "reps", "w", "units", "starts", "radii")
    blocks = spark.createDataFrame([(7 * i - 50, 100 + i % 3, 1.0, *[b"x"] * 5) for i in range(64)], "g long, size int, " + ", ".join(f"{c} {'double' if c == 'scale' else 'binary'}" for c in body))
    pairs = blocks.select("g").crossJoin(blocks.selectExpr("g as h")).filter("g < h")
    sent = covertree._dealt(blocks, pairs).select("task", "ord", "g", "meets").collect()
    held = {(r.task, r.g) for r in sent if r.ord < 0}
    met = [tuple(sorted((r.g, m))) for r in sent for m in r.meets or [] if r.ord == 1]
    assert all((r.task, m) in held for r in sent for m in r.meets or [])
    assert sorted(met) == sorted((r.g, r.h) for r in pairs.collect()) and len(met) == 2016
    assert sorted(r.g for r in sent if r.ord == 0) == sorted(r.g for r in blocks.collect())
    assert sum(r.ord != 0 for r in sent) <= 64 * (covertree.SHARES + covertree.BUNDLES / 2 + 2)


def test_op9(rows, docs):
    got = defaultdict(list)
    for r in suffix.digest(suffix.repeated_spans(docs)).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert sum(map(len, got.values())) == len(rows)
    keyed = [(r[0], r[1]) for r in rows if r[0] is not None]
    single = [(i, t) for i, t in keyed if i != 511]
    # rows of one id are one document's: what each holds counts for later ones, and each has its own result
    want = suffix.brute_force(sorted(single, key=lambda x: x[0]))
    for i, _ in single:
        if i < 511:
            assert got[i] == [want[i]]
    assert sorted(got[511])[-1][1] == len(rows[-5][1].encode()) or sorted(g[1] for g in got[511])[:2]
    assert all(g[1] == 0 for g in got[None])


def test_pipeline(spark, rows, tmp_path):
    """All stages against plain versions of them, one after another, on rows with ids."""
    own = [r[:5] for r in rows if r[0] is not None and r[0] not in (510, 511)]
    documents = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(toxic_labels(own), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = toxicity.fit(documents, spark.createDataFrame(toxic_labels(own), "doc_id long, toxic int"))
    left = [r for r in own if plain_severity(model, r[1])[0] < corpus_pipeline.TOXIC]
    assert {r[0] for r in own} - {r[0] for r in left} == {r[0] for r in own if "idiot" in (r[1] or "")}
    left = [r for r in left if re.search("[A-Za-z]", r[1] or "")]
    frame = spark.createDataFrame(left, documents.schema)
    found = {r.doc_id: r for r in langid.predict(frame, langid.fit(frame)).collect()}
    left = [r for r in left if found[r[0]].hit_share >= corpus_pipeline.LEAST_SHARE]
    _, comp = near_groups([(r[0], r[1]) for r in left], 5)
    left = [r for r in left if comp[r[0]] == r[0]]
    first, texts = {}, {}
    for i, t, *_ in sorted(left):
        raw = t.encode()
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], i)
        mask = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < i:
                mask[k : k + 50] = True
        texts[i] = bytes(b for b, m in zip(raw, mask) if not m).decode()
    items = sorted(sized_rows([(r[0], texts[r[0]], r[3]) for r in left if texts[r[0]]]), key=lambda x: x[0])
    want = sorted((n, slot, items[k][0], start, length) for n, slot, k, start, length in naive_pack(items, packing.CAPACITY))
    assert sorted((r.bin_id, r.slot, r.doc_id, r.start, r.length) for r in got) == want and len(want) > 100


def ranked(docs, items, k):
    """Scores in so many words."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(doc, Counter(terms(t))) for doc, t in docs]
    n = sum(bool(c) for _, c in counts)
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, t in items:
        scores = []
        for doc, c in counts:
            m = 25 + (75 * sum(c.values()) * n) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms(t) if c[w])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r, None if lone else doc, -s) for r, (s, lone, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("item_terms, block", [(200_000, 4096), (30, 7)])
def test_op11(spark, rows, docs, monkeypatch, item_terms, block):
    monkeypatch.setattr(lexical, "ITEM_TERMS", item_terms)
    monkeypatch.setattr(lexical, "DOC_BLOCK", block)
    texts = [r[1] for r in rows]
    items = [(1, texts[0]), (2, (texts[1] or "") + " " + (texts[1] or "")), (3, None), (4, ""), (5, "I stupid-Idiot é"), (6, "no such words zzz"), (7, texts[160])]
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id long, text string, doc_id string, rank int")
    got = sorted((tuple(r) for r in lexical.search(docs, frame, 5).collect()), key=lambda r: r[:2])
    assert got == ranked([(r[0], r[1]) for r in rows], items, 5)


def test_op11_empty(spark, docs):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("group", [100_000, 6, 1])
def test_op12(spark, rows, docs, monkeypatch, group):
    """With small groups prefixes grow longer, and those of full depth take the other way."""
    monkeypatch.setattr(subtrees, "GROUP", group)
    keyed = [(k, r[1]) for k, r in enumerate(rows)]
    rnd = random.Random(4)
    base = words(rnd, "en", 130)
    keyed += [(1000, " ".join(base)), (1001, " ".join(base[:49])), (1002, "\n".join(base[3:60])), (1003, " ".join(base[20:70] + base[20:75] + ["end"])), (1004, "\t ".join(base)), (999, " ".join(base[60:110]))]
    frame = spark.createDataFrame([(k, t, 0, "x") for k, t in keyed], "doc_id long, text string, id long, hits string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in subtrees.without_repeated_words(frame).collect()}
    want = subtrees.brute_force(keyed)
    assert got == want and sum(w[1] for w in want.values()) > 300


def test_op12_edges(spark, rows, docs):
    out = subtrees.without_repeated_words(docs)
    assert out.count() == len(rows) and out.filter("doc_id is null and n_removed > 0").count() == 0
    assert subtrees.without_repeated_words(docs.limit(0)).count() == 0


ODD = [None, "", " ", "  ", "a", " a ", "a  b \n  c <|endoftext|>\t <s> d  e　 f\U0001f600 g  ", "one ▁two", "é ́x y​ z \x1c q \u0085 r", "x" * 700, "中文 かな test " * 3, "a\x00 b\x7f c", "same words here", "same words here", "ﬁne Å"]


@pytest.mark.parametrize("spans, block, at_spaces", [(400_000, 200_000, True), (40, 50, True), (400_000, 200_000, False)])
def test_op13(spark, rows, monkeypatch, spans, block, at_spaces):
    """Against whole texts encoded at once, with one chunk or many, and with texts that are not cut into spans."""
    tokenizers = pytest.importorskip("public_tokenizers")
    paths = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(alignment, "SPANS", spans)
    monkeypatch.setattr(alignment, "BLOCK", block)
    if not at_spaces:
        monkeypatch.setattr(alignment, "cuts_at_spaces", lambda *paths: False)
    keyed = [(k, t) for k, t in enumerate([*ODD, *(r[1] for r in rows[::5] if r[0] != 510)])]
    frame = spark.createDataFrame([(k, t, 0, "x") for k, t in keyed], "doc_id long, text string, chunk long, groups string").repartition(2)
    got = sorted(tuple(r) for r in alignment.aligned(frame, *paths).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect())
    assert got == alignment.brute_force(keyed, *paths)
    digests = {r.doc_id: r.groups for r in alignment.aligned(frame, *paths, digest=True).collect()}
    assert digests == {g[0]: hashlib.sha256(g[7].encode()).hexdigest() if g[7] else "" for g in got}
    assert alignment.aligned(frame.limit(0), *paths).count() == 0

"""Parts of the operators that need no session."""

import random

import numpy as np
import pytest
import regex

from roomlake.llm import bpe, bytesops, covertree, impact, langid, mincut, minhash, packing, suffix

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")


def test_bpe_equals_the_library():
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.codec(path, tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(0)
    pieces = ["a", "b", "aa", "the", "ing", "é", "日本", "  ", "\n", "!!", "1", "x", "th", "'s", " ", "\x1c", "🙂", "<|endoftext|>"]
    for n in [0, 1, 5, 50, 400] * 40:
        text = "".join(rnd.choice(pieces) for _ in range(n))
        if n == 400:
            text = regex.sub(r"[^\p{L}]", "", text)  # one match of hundreds of bytes
        ids = codec.encode(text)
        assert ids == own.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    assert codec.encode(None) == [] and codec.decode([]) == b""


def test_bpe_join_is_encoding_of_the_whole():
    codec = bpe.codec(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    rnd = random.Random(1)
    for _ in range(300):
        a, b = (bytes(rnd.choice(b"abcdehinrst") for _ in range(rnd.randrange(1, 30))) for _ in range(2))
        assert tuple(codec.join(codec.merge(a), codec.merge(b))) == codec.merge(a + b)


def test_sketches_fill_and_estimate():
    rnd = np.random.default_rng(0)
    a = np.unique(rnd.integers(0, 1 << 63, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:800], rnd.integers(0, 1 << 63, 100).astype(np.uint64)]))
    grid = minhash.sketches(np.concatenate([a, b, a[:1]]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 1]))
    assert (grid != np.iinfo(np.uint64).max).all()
    assert abs((grid[0] == grid[1]).mean() - 0.8) < 0.2


def test_interval_expansion_finds_runs():
    rnd = random.Random(2)
    for _ in range(30):
        words = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(4, 30))) for _ in range(6)]
        data = np.frombuffer(bytes([255]).join(words) + bytes([255]) * 64, np.uint8)
        order, starts = suffix.runs_of_repeats(data, 6)
        raw = data.tobytes()
        runs = np.split(order, starts[1:])
        seen = set()
        for run in runs:
            texts = {raw[i : i + 6] for i in run if 255 not in raw[i : i + 6]}
            assert len(texts) <= 1 and not texts & seen
            seen |= texts


def test_packing_laws():
    rnd = random.Random(3)
    items = [(i, rnd.choice([0, 10, 300, 900, 2500]), rnd.choice(["hot", "hot", "a", "b", None]), rnd.choice([None, "c1", "c2", f"x{i}"])) for i in range(600)]
    out = packing.pack(items, 1000)
    fill, sources, clusters, got = {}, {}, {}, {}
    for k, b, slot, start, length in out:
        fill[b] = fill.get(b, 0) + length
        got[k] = got.get(k, 0) + length
        for seen, label in ((sources, items[k][2]), (clusters, items[k][3])):
            if label is not None:
                assert (b, label) not in seen
                seen[b, label] = k
    assert max(fill.values()) <= 1000 and got == {k: i[1] for k, i in enumerate(items)}


def test_best_fit_is_tightest():
    bins = packing.Bins()
    for n, (room, marks) in enumerate([(5, 1), (7, 2), (7, 0), (9, 0)]):
        bins.marks.append(marks)
        bins.put(room, n)
    assert bins.take(4, 1) == (7, 1) and bins.take(4, 2) == (5, 0) and bins.take(8, 3) == (9, 3) and bins.take(8, 0) is None


@pytest.mark.parametrize("scale", [256, 1e8, 1e200])
def test_index_is_exact(scale):
    rnd = np.random.default_rng(4)
    values = np.floor(rnd.uniform(-1, 1, (500, 12)) * scale)
    values[100:140] = values[7]
    ids = np.arange(500) * 3
    ids[200:202] = 600
    index = impact.Index(ids, values)
    for q in (0, 7, 120):
        found, score = index.top(values[q], 5, q * 3)
        own = [int(x) for x in values[q]]
        all_scores = [sum(int(a) * b for a, b in zip(row, own)) for row in values.tolist()]
        want = sorted((-s, int(i)) for i, s in zip(ids, all_scores) if i != q * 3)[:5]
        ends = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        assert [(s, int(i)) for i, s in zip(found, score)] == [(ends(-s), i) for s, i in want]


def test_index_stops_before_all_postings_are_read():
    rnd = np.random.default_rng(7)
    values = np.floor(256 * rnd.normal(size=(4000, 32)) / np.sqrt(32))
    values[50:60] = values[:10] + rnd.integers(-9, 9, (10, 32))
    index = impact.Index(np.arange(4000), values)
    for q in range(10):
        assert index.top(values[q], 1, q)[0][0] == 50 + q
    assert index.read < 0.7 * 10 * values.size


def test_index_answers_a_part_at_once():
    """Over 4096 rows, with ties, a hot dimension and an id that two rows share; half the queries stop early."""
    rnd = np.random.default_rng(8)
    values = np.floor(256 * rnd.normal(size=(6000, 32)) / np.sqrt(32))
    values[:, 3] *= 1 + 3 * (rnd.random(6000) < 0.1)
    values[100:130] = values[:30]
    values[5000:5040] = values[40:80] + rnd.integers(-9, 9, (40, 32))
    ids = np.arange(6000)
    ids[61] = 60
    index = impact.Index(ids, values)
    got = index.tops(values[:80], 5, ids[:80])
    for q in range(80):
        s = values @ values[q]
        keep = np.flatnonzero(ids != ids[q])
        best = keep[np.lexsort((ids[keep], -s[keep]))][:5]
        assert got[q][0].tolist() == ids[best].tolist() and got[q][1] == s[best].astype(int).tolist()
    assert index.read < 80 * values.size
    few = impact.Index(ids[:4], values[:4]).tops(values[:80], 5, ids[:80])
    assert len(few[0][0]) == 3 and len(few[79][0]) == 4


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_cover_tree_counts_and_prunes():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(900, 16))
    x[:300] = x[0] + 0.02 * rnd.normal(size=(300, 16))
    x[300:340] = x[300] + 0.12 * rnd.normal(size=(40, 16))
    x = unit(x)
    w = np.ones(len(x), np.int64)
    tree, work = covertree.Tree(x), covertree.Work()
    n, _, links = covertree.dual(tree, w, tree, w, 0.95, work)
    assert (n == (x @ x.T >= 0.95).sum(axis=1)).all()
    assert len({links.find(i) for i in range(300)}) == 1
    # most pairs of points never meet: nodes are pruned, dense ones counted whole
    assert work.whole and work.compared < 0.4 * len(x) ** 2 and work.pruned > 0.3 * work.looked
    y = unit(np.concatenate([x[:200] + 0.01 * rnd.normal(size=(200, 16)), rnd.normal(size=(300, 16))]))
    other = covertree.Tree(y)
    v = rnd.integers(1, 4, len(y))
    n, m, _ = covertree.dual(tree, w, other, v, 0.95)
    hit = x @ y.T >= 0.95
    assert (n == hit @ v).all() and (m == w @ hit).all()


def test_trees_divide_at_any_width():
    x = unit(np.random.default_rng(6).normal(size=(1000, 64)))
    tree = covertree.Tree(x)
    assert not tree.leaf(tree.root) and len(tree.root.starts) > 500
    order = np.argsort(tree.perm)
    assert (tree.x[order] == x).all()
    for k in range(len(tree.root.starts)):
        c = tree.root.child(k)
        assert covertree._distance(tree.x[c.start : c.end], tree.x[c.start]).max() <= c.radius + 1e-7


def test_words_that_collide_in_polynomials():
    word = b"a"
    for _ in range(11):
        word += bytes(195 - c for c in word)
    other = bytes(195 - c for c in word)
    raw = np.frombuffer(word + b" " + other + b" one two three " + b"x" * 5000 + b" one", np.uint8)
    start, end, _ = bytesops.word_spans(raw, np.array([0, len(raw)]))
    h = bytesops.word_hashes(raw, start, end)
    assert len(set(h.tolist())) == 6 and h[2] == h[6]


def test_more_languages_than_bits_of_a_word():
    rnd = random.Random(8)
    texts = {f"l{i:02}": "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80)).encode() for i in range(70)}
    f = langid.build({k: np.unique(langid.gram_hashes(np.frombuffer(v, np.uint8), np.array([0, len(v)]))[0]) for k, v in texts.items()})
    for k, v in texts.items():
        share, _ = langid.shares(f, np.frombuffer(v[10:60], np.uint8), np.array([0, 50]))
        assert f.names[share[0].argmax()] == k and len(share[0]) == 70


def test_main_text():
    page = """<html><head><title>x</title></head><body><header>Site</header><nav>Home</nav><div id="cookie-notice">We use cookies, please accept.</div><article><h2>Title</h2>
    <p>First &amp; <b>bold</b>   text,<br>more.<p>Second.</p><div class="ad">Buy now!</div></article><aside>Related</aside><section id="comments"><p>I like this article very much, thanks for it.</p></section>
    <footer>(c)</footer><script>if (a<b) x="</p>"</script></body></html>"""
    assert mincut.main_text(page) == "Title\nFirst & bold text, more.\nSecond."
    assert mincut.main_text(None) == mincut.main_text("") == ""


def test_the_cut_changes_labels():
    """A short line between paragraphs is content, a long notice among links is none; by themselves they would be the other way."""
    long = ["A first paragraph, which is long enough to be taken as text by itself. It has sentences, too.", "And a second paragraph, just as long as the first one was. It ends here, finally."]
    page = f"<div><p>{long[0]}</p><div>Oct 5</div><p>{long[1]}</p></div><ul><li><a href=x>Home</a></li><li>Our notice about cookies, that we use.</li><li><a href=y>About</a></li></ul>"
    got = mincut.labelled(page)
    assert [b.text for b, keep, _ in got if keep] == [long[0], "Oct 5", long[1]]
    assert sum(keep != alone for _, keep, alone in got) == 2


@pytest.mark.parametrize(
    "page",
    [
        "<head><title>t</title><p>Hello, world, once more.</p>",
        "<body><video src=x><p>Hello, world, once more.</p>",
        "<body><select><option><p>Hello, world, once more.</p>",
        '<p class="x>Hello, world, once more.',
        "<svg><svg></svg>no</svg><textarea>no</textarea><p>Hello, world, once more.</p><script>no",
        "<template><template>no</template>no</template><p>Hello, world, once more.",
    ],
)
def test_pages_that_leave_things_out(page):
    assert mincut.main_text(page) == "Hello, world, once more."


def test_classifier_is_fitted():
    x = np.array([[1.0, n, d, 1.0, 1.0, *([0.0] * len(mincut.TAGS))] for n, d in ((8, 0), (7, 0), (3, 1), (2, 1))] * 5)
    w = mincut.fit_weights(x, np.array([0, 0, 1, 1] * 5))
    assert (x[:4] @ w > 0).tolist() == [False, False, True, True]
    assert (mincut.fit_weights(x, np.ones(20)) == mincut.DEFAULT).all()


def test_minimum_cut_value():
    rnd = random.Random(6)
    for _ in range(40):
        n = 7
        s, t = ([rnd.randrange(9) for _ in range(n)] for _ in range(2))
        edges = [(i, j, rnd.randrange(5)) for i in range(n) for j in range(i) if rnd.random() < 0.5]
        cost = lambda keep: sum(t[i] if keep[i] else s[i] for i in range(n)) + sum(c for i, j, c in edges if keep[i] != keep[j])
        assert cost(mincut.minimum_cut(s, t, edges)) == min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))


def test_filters_tell_languages():
    grams = lambda text: np.unique(langid.gram_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0])
    f = langid.build({"a": grams("the cat sat on the mat with that hat"), "b": grams("der hund lief durch den wald und schlief")})
    raw = "THE CAT with the hat".encode()
    share, n = langid.shares(f, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert share[0, 0] > 0.7 > share[0, 1] and n[0] > 10


def test_every_text_with_a_letter_has_grams():
    texts = [b"A.", b"", b"  ", b"x", "\u00e9".encode(), b"a  b"]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    got, cuts = langid.gram_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets)
    want = [[b"a"], [], [], [b"x"], [b" \xc3\xa9 "], [b" a b", b"a b "]]
    assert [[int(g).to_bytes(4, "big").lstrip(b"\0") for g in got[cuts[i] : cuts[i + 1]]] for i in range(len(texts))] == want
    one = langid.build({"en": langid.gram_hashes(np.frombuffer(b"this is a cat", np.uint8), np.array([0, 13]), lone=True)[0], "xx": np.zeros(0, np.uint32)})
    share, n = langid.shares(one, np.frombuffer(b"A.", np.uint8), np.array([0, 2]))
    assert n[0] == 1 and share[0, 0] == 1 and share[0, 1] == 0

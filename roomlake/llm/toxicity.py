"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text has a severity grade y in 0..GRADES-1.  The model shares one weight vector w across ordered
thresholds t_1 < t_2 < ...: P(y >= k) = sigmoid(w x - t_k).  Expected severity is the sum of these
probabilities over k.  Thresholds stay ordered by construction: each is the one before plus the
exponential of a free parameter.

Features are presences: of words (letters, ASCII lower case) and of the first PREFIX bytes of longer
words, each a 64-bit hash.  Only features that LEAST_TEXTS sampled texts hold, with the highest
log-odds either way, at most MAX_FEATURES of them, get a weight.

Labels are binary, so grades come from them in two steps: texts labelled clean have grade 0; those
labelled toxic are cut into thirds by how many occurrences of toxic-leaning features they hold.

Training uses a bounded, documented sample: at most PER_LABEL labelled rows of each label, by hashed
id.  Prediction reads every whole text, of any length.  Null and empty texts have no features; their
severity is what the thresholds alone say.  With no labelled text of both kinds everything has severity
0.  Rows of one text get one severity; an id with several labels counts as toxic if any says so, rows that
repeat an id train as one text each.  Letters are those of all scripts but for the marks of General
Punctuation and Latin-1 (quotes, dashes), which end words.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import LOWER, U64, buffers, give_back, lean, mix, pieces, prefix, spans_hash, word_spans
from .store import Store

GRADES = 4
PREFIX = 5
PER_LABEL = 2500
LEAST_TEXTS = 4
MAX_FEATURES = 4096
EPOCHS = 300
RIDGE = 3e-3

_GAP = np.ones(256, bool)
_GAP[65:91] = _GAP[97:123] = False
_GAP[128:] = False


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their shared weights and the ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of the occurrences of words and prefixes."""
    low = LOWER[raw]
    # quotes, dashes and other signs of Latin-1 (C2 ..) and General Punctuation (E2 80 .., E2 81 ..) end words
    two = np.flatnonzero(low[:-1] == 0xC2)
    three = np.flatnonzero((low[:-2] == 0xE2) & ((low[1:-1] == 0x80) | (low[1:-1] == 0x81)))
    low[np.concatenate([two, two + 1, three, three + 1, three + 2])] = 32
    start, end, row = word_spans(low, offsets, _GAP)
    p = prefix(low)
    word = spans_hash(p, start, end)
    long = end - start > PREFIX
    head = mix(spans_hash(p, start[long], start[long] + PREFIX) ^ U64(0xFEED))
    return np.concatenate([word, head]), np.concatenate([row, row[long]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each (id, toxic, text) as its distinct features with their counts."""
    for batch in batches:
        offsets, raw = buffers(batch.column(2))
        for i, j in pieces(offsets):
            h, row = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(h)))
            part = batch.slice(i, j - i)
            owner = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), pa.array(h[at].view(np.int64)), pa.array(count.astype(np.int64))], names=["id", "toxic", "feature", "n"])


def _fit_links(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient descent with momentum (Adam) on the binary link losses."""
    k = GRADES - 1
    w, free = np.zeros(n_features), np.concatenate([[1.0], np.full(k - 1, -0.5)])
    above = (grade[:, None] > np.arange(k)[None, :]).astype(float)
    balance = np.where(grade > 0, 0.5 / max(1, (grade > 0).sum()), 0.5 / max(1, (grade == 0).sum()))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(free), np.zeros_like(free)]
    for step in range(1, EPOCHS + 1):
        t = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        score = np.bincount(rows, w[cols], len(grade))
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - t[None, :], -30, 30)))
        g = (p - above) * balance[:, None]
        gw = np.bincount(cols, g.sum(axis=1)[rows], n_features) + RIDGE * w
        gt = -g.sum(axis=0)
        tail = np.cumsum(gt[::-1])[::-1]
        gf = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
        for x, grad, m, v in ((w, gw, 0, 1), (free, gf, 2, 3)):
            state[m] = 0.9 * state[m] + 0.1 * grad
            state[v] = 0.99 * state[v] + 0.01 * grad * grad
            x -= 0.05 * (state[m] / (1 - 0.9**step)) / (np.sqrt(state[v] / (1 - 0.99**step)) + 1e-8)
    return w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def fit(docs: DataFrame, labels: DataFrame, *, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """The model of a bounded sample of labelled rows."""
    empty = Model(np.zeros(0, U64), np.zeros(0), np.full(GRADES - 1, 30.0))
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(toxic_col).cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    ordered = [marked.filter(F.col("toxic") == t).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(per_label) for t in (0, 1)]
    store = Store(docs.sparkSession, "toxicity")
    chosen = store.put(ordered[0].union(ordered[1]), "chosen")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    sample = texts.join(F.broadcast(chosen), "id").select("id", "toxic", "text")  # at most 2 per_label rows
    bags = store.put(sample.mapInArrow(lean(_counts), "id long, toxic int, feature long, n long"), "bags")
    sizes = {r["toxic"]: r["n"] for r in bags.groupBy("toxic").agg(F.countDistinct("id").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return empty
    odds = F.log((F.col("bad") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("good") + 0.5) / (sizes[0] + 1.0))
    table = bags.groupBy("feature").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).filter(F.col("bad") + F.col("good") >= LEAST_TEXTS).withColumn("odds", odds)
    weight = F.abs("odds") * F.sqrt(F.col("bad") + F.col("good"))
    table = store.put(table.withColumn("rank", weight).orderBy(F.desc("rank"), "feature").limit(MAX_FEATURES).select("feature", "odds"), "features")
    # at most 2 per_label rows of at most MAX_FEATURES columns; only what occurs
    found = bags.join(F.broadcast(table), "feature").select("id", "toxic", "feature", (F.col("n") * (F.col("odds") > 2).cast("int")).alias("leaning")).toArrow()
    store.drop("chosen", "bags", "features")
    if not found.num_rows:
        return empty
    names, cols = np.unique(found.column("feature").to_numpy().view(U64), return_inverse=True)
    _, first, rows = np.unique(found.column("id").to_numpy(), return_index=True, return_inverse=True)
    toxic = found.column("toxic").to_numpy()[first]
    leaning = np.bincount(rows, found.column("leaning").to_numpy(), len(first))
    del found
    marks = np.quantile(leaning[toxic == 1], [1 / 3, 2 / 3]) if (toxic == 1).any() else [0, 0]
    grade = np.where(toxic == 1, 1 + (leaning > marks[0]).astype(int) + (leaning > marks[1]), 0)
    weights, thresholds = _fit_links(rows, cols, grade, len(names))
    del rows, cols
    give_back()
    return Model(names, weights, thresholds)


def _scores(model: Model):
    """Texts to (severity, p_toxic, grade)."""
    top = len(model.features)
    bits = np.zeros(1 << 16, bool)
    bits[(model.features >> U64(48)).astype(np.int64)] = True

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            offsets, raw = buffers(texts)
            score = np.zeros(len(texts))
            for i, j in pieces(offsets) if top else ():
                h, row = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                may = bits[(h >> U64(48)).astype(np.int64)]
                h, row = h[may], row[may]
                at = np.minimum(np.searchsorted(model.features, h), top - 1)
                hit = model.features[at] == h
                once = np.unique(row[hit] * top + at[hit])
                score[i:j] = np.bincount(once // top, model.weights[once % top], j - i)
            p = 1 / (1 + np.exp(-np.clip(score[:, None] - model.thresholds[None, :], -30, 30)))
            yield pa.StructArray.from_arrays([pa.array(p.sum(axis=1)), pa.array(p[:, 0].copy()), pa.array((p >= 0.5).sum(axis=1).astype(np.int32))], names=["severity", "p_toxic", "grade"])
        give_back()

    return run


def severity(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with severity, p_toxic and grade of every whole text (columns of these names are replaced).

    severity is the expected grade, p_toxic P(y >= 1), grade the median grade.  Only the texts go to
    Python; rows are neither moved nor joined, so repeated rows and rows without an id count like others.
    """
    score = F.arrow_udf(_scores(model), "severity double, p_toxic double, grade int").asNondeterministic()
    rows = docs.drop("severity", "p_toxic", "grade", "_score").withColumn("_score", score(F.col(text_col)))
    return rows.select(*(c for c in rows.columns if c != "_score"), "_score.severity", "_score.p_toxic", "_score.grade")

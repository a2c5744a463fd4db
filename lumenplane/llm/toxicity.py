"""Toxicity: a convolutional text classifier.

Words are hashed to 64 bits and folded into BUCKETS embedding rows (rows that fewer than MIN_DOCS
training documents use share one). Filters of widths 1, 2 and 3 slide over a whole text, the largest
response of each is kept, and a logistic layer scores the responses. Everything is trained in numpy
on the driver from at most TRAIN_DOCS labelled documents; scoring is one Arrow pass.

Thresholds are calibrated by language: the language a text is calibrated for comes from the text's
own words, and shifts the logit so that 0.3 is the threshold that did best for that language on
training documents kept aside.

Defined results: null and empty texts have no words and score 0.0 (predicted 0). Repeated rows stay;
of rows that share a labelled doc_id one text is learned from, that of the least hash. Extra columns pass
through; one that bears the name of a result, in any case, gets `_given` added to its name. Without a
label of each class every score is 0.0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenplane.llm.common import beside, give_back, tidily, word_hashes

#: Labelled documents learned from, at most; a third of them toxic where there are as many.
TRAIN_DOCS = 6000
BUCKETS = 1 << 20
MIN_DOCS = 3
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
CUT = 0.3
#: Texts are scored in groups of about so many bytes.
GROUP_BYTES = 4 << 20
SLICE = 200


def _rows(hashes: np.ndarray, index: np.ndarray) -> np.ndarray:
    return index[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]


class Model:
    """Embedding rows by bucket (0: rare words), a table of filter responses by row, and the head."""

    def __init__(self, index, embedding, filters, bias, weights, offset, lang_logp, shifts):
        self.index, self.weights, self.offset, self.lang_logp, self.shifts = index, weights, offset, lang_logp, shifts
        self.bias = bias
        # response of a filter at one place: the sum over its positions of one gather each
        self.tables = {w: [(embedding @ filters[w][k]).astype(np.float32) for k in range(w)] for w in WIDTHS}

    def pooled(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each text; 0 where a text is shorter than a filter."""
        out = np.zeros((len(bounds) - 1, len(WIDTHS) * FILTERS), np.float32)
        sizes = np.diff(bounds)
        for j, w in enumerate(WIDTHS):
            has = np.flatnonzero(sizes >= w)
            if not len(has):
                continue
            value = self.tables[w][0][rows[: len(rows) - w + 1]]
            for k in range(1, w):
                value += self.tables[w][k][rows[k : len(rows) - w + 1 + k]]
            # spans of one text each; what lies between them crosses texts and is left out
            edges = np.stack((bounds[has], bounds[has + 1] - w + 1), 1).ravel()
            edges = edges[:-1] if edges[-1] >= len(value) else edges
            out[has, j * FILTERS : (j + 1) * FILTERS] = np.maximum(np.maximum.reduceat(value, edges, axis=0)[::2] + self.bias[w], 0)
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.weights + self.offset

    def language(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The language of each text by its words' log-probabilities."""
        if self.lang_logp.shape[1] < 2 or not len(rows):
            return np.zeros(len(bounds) - 1, np.int64)
        sums = np.concatenate((np.zeros((1, self.lang_logp.shape[1])), np.cumsum(self.lang_logp[rows], axis=0, dtype=np.float64)))
        return (sums[bounds[1:]] - sums[bounds[:-1]]).argmax(1)

    def score(self, texts: list) -> np.ndarray:
        hashes, bounds, _, _ = word_hashes(texts)
        rows = _rows(hashes, self.index)
        logit = self.logits(self.pooled(rows, bounds)) + self.shifts[self.language(rows, bounds)]
        score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        score[np.diff(bounds) == 0] = 0.0
        return score


def train(texts: list, labels: np.ndarray, langs: list, clean_weight: float = 1.0, seed: int = 11) -> Model | None:
    """clean_weight: documents labelled 0 that each of those given stands for, against those labelled 1."""
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    buckets, sizes = [], [0]  # the driver has little memory: some hundred texts at a time
    in_docs, toxic_docs = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for i in range(0, len(texts), SLICE):
        hashes, part, _, _ = word_hashes(texts[i : i + SLICE])
        bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int32)
        buckets.append(bucket)
        sizes += np.diff(part).tolist()
        for d in range(len(part) - 1):
            own = np.unique(bucket[part[d] : part[d + 1]])
            in_docs[own] += 1
            toxic_docs[own] += int(labels[i + d])
    bounds = np.cumsum(sizes)
    bucket = np.concatenate(buckets)
    used = np.flatnonzero(in_docs >= MIN_DOCS)
    index = np.zeros(BUCKETS, np.int32)
    index[used] = np.arange(1, len(used) + 1)
    rows = index[bucket]
    del bucket, buckets

    # embeddings begin with the lower bound of each word's log-odds, the other dimensions small
    n1, n, base = toxic_docs[used].astype(float), in_docs[used].astype(float), labels.mean()
    odds = np.log((n1 + 0.5) / (n - n1 + 0.5)) - np.log(base / (1 - base))
    wide = np.sqrt(1 / (n1 + 0.5) + 1 / (n - n1 + 0.5))
    embedding = rng.normal(0, 0.05, (len(used) + 1, DIMENSIONS))
    embedding[0] = 0
    embedding[1:, 0] = np.clip(np.maximum(odds - 2.5 * wide, 0) - np.maximum(-odds - 2.5 * wide, 0), -3, 3)
    filters = {w: rng.normal(0, 0.1, (w, DIMENSIONS, FILTERS)) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][:, 0, : FILTERS // 2] += 1 / w
    bias = {w: np.zeros(FILTERS) for w in WIDTHS}
    weights, offset = np.full(len(WIDTHS) * FILTERS, 0.1), np.array([-1.0])

    kinds = sorted({l for l in langs if l is not None}) or [""]
    number = np.array([kinds.index(l) if l in kinds else -1 for l in langs])
    counts = np.ones((len(used) + 1, len(kinds)))
    for k in range(len(kinds)):
        for d in np.flatnonzero(number == k):
            np.add.at(counts[:, k], rows[bounds[d] : bounds[d + 1]], 1)
    counts[0] = 1
    lang_logp = np.log(counts / counts.sum(0)).astype(np.float32)
    lang_logp -= lang_logp.mean(1, keepdims=True)

    aside = rng.permutation(len(texts)) < len(texts) // 4
    learn = np.flatnonzero(~aside)
    params = [embedding, *(filters[w] for w in WIDTHS), *(bias[w] for w in WIDTHS), weights, offset]
    moment, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = np.where(labels == 1, 0.5 / base, 0.5 / (1 - base))
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for i in range(0, len(learn), 128):
            docs = learn[i : i + 128]
            grads = [np.zeros_like(p) for p in params]
            pooled, where = np.zeros((len(docs), len(WIDTHS) * FILTERS)), {}
            for j, w in enumerate(WIDTHS):
                for d, doc in enumerate(docs):
                    r = rows[bounds[doc] : bounds[doc + 1]]
                    if len(r) >= w:
                        value = sum(embedding[r[k : len(r) - w + 1 + k]] @ filters[w][k] for k in range(w))
                        at = value.argmax(0)
                        pooled[d, j * FILTERS : (j + 1) * FILTERS] = np.maximum(value[at, np.arange(FILTERS)] + bias[w], 0)
                        where[d, w] = r, at
            error = (1 / (1 + np.exp(-(pooled @ weights + offset))) - labels[docs]) * weight[docs] / len(docs)
            grads[-2], grads[-1] = pooled.T @ error, np.array([error.sum()])
            back = np.outer(error, weights) * (pooled > 0)
            for (d, w), (r, at) in where.items():
                j = WIDTHS.index(w)
                g = back[d, j * FILTERS : (j + 1) * FILTERS]
                grads[1 + len(WIDTHS) + j] += g
                for k in range(w):
                    word = r[at + k]
                    grads[1 + j][k] += embedding[word].T * g
                    np.add.at(grads[0], word, g[:, None] * filters[w][k].T)
            grads[0][0] = 0
            step += 1
            for p, g, m, v in zip(params, grads, moment, square):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    model = Model(index, embedding, filters, bias, weights, offset[0], lang_logp, np.zeros(len(kinds)))
    logits, guess = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for i in range(0, len(texts), SLICE):
        part = bounds[i : i + SLICE + 1]
        own = rows[part[0] : part[-1]]
        logits[i : i + SLICE] = model.logits(model.pooled(own, part - part[0]))
        guess[i : i + SLICE] = model.language(own, part - part[0])
    cut = np.log(CUT / (1 - CUT))
    overall = _threshold(logits[aside], labels[aside], clean_weight)
    for k in range(len(kinds)):
        mine = aside & (guess == k)
        at = _threshold(logits[mine], labels[mine], clean_weight) if labels[mine].sum() >= 10 and (1 - labels[mine]).sum() >= 10 else overall
        model.shifts[k] = cut - at
    return model


def _threshold(logits: np.ndarray, labels: np.ndarray, clean_weight: float) -> float:
    """The middle of the widest stretch of thresholds whose F1 is best."""
    if not len(logits):
        return 0.0
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (hits + clean_weight * np.cumsum(1 - labels[order]) + max(labels.sum(), 1e-9))
    ranked = logits[order]
    gap = ranked - np.append(ranked[1:], ranked[-1] - 1)
    best = np.flatnonzero((f1 >= f1.max() - 1e-9) & (gap > 0))
    at = best[gap[best].argmax()] if len(best) else int(f1.argmax())
    return float(ranked[at] - min(gap[at], 2.0) / 2)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """A model from labelled training rows only; of several labels of a document the largest counts."""
    known = labels.where("toxic is not null").groupBy(key).agg(F.max("toxic").alias("toxic"))
    counts = dict(map(tuple, known.groupBy("toxic").count().collect()))
    if not {0, 1} <= set(counts):
        return None
    few = min(counts[1], TRAIN_DOCS // 3)
    share = {1: few / counts[1], 0: min(1.0, (TRAIN_DOCS - few) / counts[0])}
    drawn = F.shiftrightunsigned(F.xxhash64(key, F.lit(5)), 11) / float(1 << 53)
    chosen = known.where(drawn < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))  # TRAIN_DOCS rows or so
    texts = docs.select(key, F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("t"), F.col(lang).alias("l")).alias("row"))
    rows = texts.join(F.broadcast(chosen), key).groupBy(key, "toxic").agg(F.min("row").alias("row")).select("row.*", "toxic").collect()
    rows.sort(key=lambda r: (r.h, r.t or "", r.l or "", r.toxic))  # the fit must not hang on the order of arrival
    texts, toxic, langs = [r.t for r in rows], [r.toxic for r in rows], [r.l for r in rows]
    del rows
    model = train(texts, toxic, langs, share[1] / share[0])
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with score (double) and predicted (int)."""
    new = ("score", "predicted")
    at = docs.columns.index(text)
    carried = beside(docs, *new)
    fields = carried.schema.fields
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            scores, i = [np.zeros(0)], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= GROUP_BYTES):
                    size += len(texts[j] or "")
                    j += 1
                scores.append(model.score(texts[i:j]) if model else np.zeros(j - i))
                i = j
            values = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64()), pa.array((values >= CUT).astype(np.int32))], names=[*(f.name for f in fields), *new])

    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return carried.mapInArrow(tidily(run), schema)

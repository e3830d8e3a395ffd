"""Quality classifier: random-indexing word vectors pooled for each document, then a two-layer network.

Random indexing: every word has a sparse ternary index vector, made from its hash; a word's context vector is the sum of
the index vectors of its neighbours (two on either side) over a bounded sample of documents. A word's form (which classes of
characters it holds, how it begins and ends) gets a context vector in the same way and stands for words the sample lacks.
A document is the mean of its words' vectors, of its words' forms, and of its distinct words' vectors, with the share of
distinct words and of distinct word pairs, the logarithm of its length and the share of words with a vector: so repetition
and odd spelling are visible, which pooled means alone hide.

Network: standardised inputs, one hidden tanh layer, one logit; numpy, full-batch Adam, early choice of the best round on
every fourth sampled row; there the temperature that calibrates the probabilities is fitted too. Vectors and network are
each fitted in one executor task, so the driver holds the finished model alone.

Bounds (documented parameters): SAMPLE labelled rows fit the network, CONTEXTS of them give the context vectors, whole texts
in both cases; VOCABULARY words have a vector. Labels, lang, source and doc_id are inputs of no score.

Defined results: null and empty texts pool to zeros and are scored as such; repeated rows score alike; without labelled
rows of both values every score is the share of label 1 (0.5 without any); an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import gram_hashes, mix, pieces, span_hashes, text_bytes, word_spans
from parlance.llm.samples import fitted, fold, labelled

SAMPLE, CONTEXTS, VOCABULARY = 5_000, 1_500, 1 << 15
WIDTH, ACTIVE, HIDDEN = 32, 4, 24
THRESHOLD = 0.3  # fixed value: predicted 1 from this score on

_CLASS = np.full(256, 32, np.uint8)  # bytes of other scripts
_CLASS[:128] = 16  # symbols
_CLASS[[0x20, *range(9, 14)]] = 0
_CLASS[[*b".,;:!?'\"-()"]] = 8
_CLASS[[*b"0123456789"]] = 4
_CLASS[65:91] = 2
_CLASS[97:123] = 1


@dataclass
class Vectors:
    """Context vectors by a slot of the word's hash (with the hash, to tell whether the slot is this word's) and by form."""

    tags: np.ndarray
    words: np.ndarray
    forms: np.ndarray


def _index_vectors(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hashes), WIDTH), np.float32)
    rows = np.arange(len(hashes))
    for k in range(ACTIVE):
        h = mix(hashes, k + 1)
        np.add.at(out, (rows, (h % np.uint64(WIDTH)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1).astype(np.float32))
    return out


def _forms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number under 4,096 for each word's form: classes it holds, class at its start and at its end."""
    if not len(starts):
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    held = np.bitwise_or.reduceat(kind, starts).astype(np.int64)
    place = np.zeros(33, np.int64)
    place[[1, 2, 4, 8, 16, 32]] = range(1, 7)
    return held * 64 + place[kind[starts]] * 8 + place[kind[ends - 1]]


def _slots(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(VOCABULARY - 1)).astype(np.int64)


class Contexts:
    """Sums of context vectors of words and forms, whole numbers, so texts may come in any order and number of parts."""

    def __init__(self):
        self.words, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sums, self.forms = np.zeros((0, WIDTH), np.int64), np.zeros((4096, WIDTH), np.int64)

    def add(self, array: pa.Array) -> None:
        data, offsets = text_bytes(array)
        starts, ends, first = word_spans(data, offsets)
        words, forms = span_hashes(data, starts, ends), _forms(data, starts, ends)
        if not len(words):
            return
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        distinct, place, n = np.unique(words, return_inverse=True, return_counts=True)
        index = _index_vectors(distinct).astype(np.int32)
        context = np.zeros((len(words), WIDTH), np.int32)
        for k in (1, 2):
            if len(words) > k:
                same = (doc[k:] == doc[:-k])[:, None]
                context[k:] += index[place[:-k]] * same
                context[:-k] += index[place[k:]] * same
        sums = _grouped(context, place, len(distinct))
        self.forms += _grouped(context, forms, len(self.forms))
        both, at = np.unique(np.concatenate([self.words, distinct]), return_inverse=True)
        old, new = at[: len(self.words)], at[len(self.words) :]
        merged, counts = np.zeros((len(both), WIDTH), np.int64), np.zeros(len(both), np.int64)
        merged[old], counts[old] = self.sums, self.counts
        merged[new] += sums
        counts[new] += n
        self.words, self.sums, self.counts = both, merged, counts

    def vectors(self) -> Vectors:
        unit = lambda x: (x / np.maximum(1e-6, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)
        tags, vectors = np.zeros(VOCABULARY, np.uint64), np.zeros((VOCABULARY, WIDTH), np.float32)
        kept = np.flatnonzero(self.counts >= 3)
        kept = kept[np.argsort(self.counts[kept], kind="stable")]  # the most frequent word of a slot is written last
        slots = _slots(self.words[kept])
        tags[slots] = self.words[kept]
        vectors[slots] = unit(self.sums[kept].astype(float))
        return Vectors(tags, vectors, unit(self.forms.astype(float)))


def _grouped(rows: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of each group."""
    order = np.argsort(group, kind="stable")
    head = np.flatnonzero(np.diff(group[order], prepend=-1))
    out = np.zeros((n, rows.shape[1]), np.int64)
    out[group[order[head]]] = np.add.reduceat(rows[order], head, axis=0)
    return out


def learn_vectors(batches: Iterator[pa.RecordBatch]) -> Vectors:
    sums = Contexts()
    for batch in pieces(batches, "text", 1_000_000):
        sums.add(batch.column("text"))
    return sums.vectors()


def _pool(rows: np.ndarray, table: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of the table's rows between neighbouring bounds."""
    n = np.diff(bounds)
    out = np.zeros((len(n), table.shape[1]))
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(table[rows], bounds[:-1][some], axis=0) / n[some, None]
    return out


def pooled(array: pa.Array, vectors: Vectors) -> np.ndarray:
    """The documents' inputs of the network."""
    data, offsets = text_bytes(array)
    starts, ends, first = word_spans(data, offsets)
    words, forms = span_hashes(data, starts, ends), _forms(data, starts, ends)
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    slots = _slots(words)
    # Unknown words take their form's vector: one table, words first.
    table = np.concatenate([vectors.words, vectors.forms])
    rows = np.where(vectors.tags[slots] == words, slots, VOCABULARY + forms)
    with np.errstate(over="ignore"):
        keys = mix(words + mix(doc))
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[order[1:]] = keys[order[1:]] != keys[order[:-1]]
        pairs = gram_hashes(words, 2)
        at = np.flatnonzero(doc[1:] == doc[:-1]) if len(pairs) else np.zeros(0, np.int64)
        _, first_pair = np.unique(mix(pairs[at] + mix(doc[at])), return_index=True)
    n = np.diff(first)
    distinct = np.bincount(doc[new].astype(np.int64), minlength=len(n))
    pair_n, pair_distinct = np.bincount(doc[at].astype(np.int64), minlength=len(n)), np.bincount(doc[at[first_pair]].astype(np.int64), minlength=len(n))
    known = np.concatenate([[0], np.cumsum(rows < VOCABULARY)])
    more = [distinct / np.maximum(1, n), pair_distinct / np.maximum(1, pair_n), np.log1p(n), (known[first[1:]] - known[first[:-1]]) / np.maximum(1, n)]
    return np.concatenate([_pool(rows, table, first), _pool(forms, vectors.forms, first), _pool(rows[new], table, np.concatenate([[0], np.cumsum(distinct)])), np.stack(more, axis=1)], axis=1)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.01, decay: float = 1e-3, seed: int = 0) -> Network:
    rng, width = np.random.default_rng(seed), x.shape[1]
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    net = Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return net
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held].tolist())) < 2:
        held[:] = False
    net.mean, net.scale = x.mean(axis=0), np.maximum(1e-6, x.std(axis=0))
    net.w1 = rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN))
    net.w2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
    z, t = (x[~held] - net.mean) / net.scale, y[~held].astype(float)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    best, kept = np.inf, None
    for step in range(1, rounds + 1):
        hidden = np.tanh(z @ params[0] + params[1])
        gap = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -30, 30))) - t) / len(t)
        back = gap[:, None] * params[2] * (1 - hidden**2)
        grads = [z.T @ back + decay * params[0], back.sum(axis=0), hidden.T @ gap + decay * params[2], np.array([gap.sum()])]
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        if step % 10 == 0:
            net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
            loss = _loss(net.logits(x[held]), y[held], 1.0) if held.any() else -step
            if loss < best:
                best, kept = loss, [p.copy() for p in params]
    net.w1, net.b1, net.w2, net.b2 = kept[0], kept[1], kept[2], float(kept[3][0])
    if held.any():
        logits = net.logits(x[held])
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda c: _loss(logits, y[held], c)))
    return net


def _loss(logits: np.ndarray, y: np.ndarray, temperature: float) -> float:
    z = logits / temperature
    return float(np.mean(np.logaddexp(0, z) - y * z))


def learn(docs: DataFrame, labels: DataFrame, seed: int = 0) -> tuple[Vectors, Network]:
    """Vectors and network of bounded samples of the labelled rows whose crc32 mod 5 is not 0."""
    where = fold(F.col("doc_id"), 5) != 0
    vectors = fitted(labelled(docs, labels, where, CONTEXTS, seed + 1).select("doc_id", "text"), learn_vectors) or Contexts().vectors()
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # two tables of fixed size, about 5 MB
    width = 3 * WIDTH + 4

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1_500_000):
            x = pooled(batch.column("text"), shared.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([r.tobytes() for r in x], pa.binary()), batch.column("quality").cast(pa.int32())], ["doc_id", "x", "quality"])

    def network(batches: Iterator[pa.RecordBatch]) -> Network:
        held = [(b"".join(b.column("x").to_pylist()), b.column("quality").to_numpy()) for b in batches if b.num_rows]
        x = np.frombuffer(b"".join(h[0] for h in held), np.float32).reshape(-1, width).astype(np.float64)
        return fit(x, np.concatenate([h[1] for h in held]) if held else np.zeros(0, np.int64), seed=seed)

    rows = labelled(docs, labels, where, SAMPLE, seed).mapInArrow(inputs, "doc_id long, x binary, quality int")
    return vectors, fitted(rows, network) or fit(np.zeros((0, width)), np.zeros(0, np.int64), seed=seed)


def score(docs: DataFrame, model: tuple[Vectors, Network], threshold: float = THRESHOLD) -> DataFrame:
    """The columns of `docs` with `score` and `predicted`: names of `docs` that clash with these two are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    kept = docs.select(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for batch in pieces(batches, "text", 1_500_000):
            p = net.score(pooled(batch.column("text"), vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: tuple[Vectors, Network], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are predicted 1, with all their columns, whatever these are called."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for batch in pieces(batches, "text", 1_500_000):
            yield batch.filter(pa.array(net.score(pooled(batch.column("text"), vectors)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, seed: int = 0) -> DataFrame:
    """One row for each document: doc_id, held_out (no label of it was learned from), score, predicted."""
    out = score(docs.select("doc_id", "text"), learn(docs, labels, seed), threshold)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")

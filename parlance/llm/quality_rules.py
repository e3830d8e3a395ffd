"""Quality rules: exact counts of a text, and a hashed n-gram logistic regression with calibrated probabilities.

Counts, over every whole text: words, code points in words, symbols, lines equal to an earlier line, words that lie in a
3-word window found twice or more. Line, word and window identity are 64-bit hashes within one document.

Model: a text's features are the shares of its hashed 4-character windows (of code points, in any script) and of its hashed
words and word pairs, so the score of a text is three means of weights and costs a table lookup for each character and word.
Fitted in one executor task by full-batch Adam on the whole texts of at most `SAMPLE` labelled rows (a documented sample; the
larger part fits the weights, every fourth row the calibration by Platt's method); a sampled text comes there as its distinct
features, which hashing bounds however long it is. Scoring sees whole texts, in Arrow batches, against fixed thresholds.

Defined results: null and empty texts have no words, so `base_failed` is true and `kept` false; repeated rows are judged
alike; without labelled rows of both values the model keeps everything that passes the counts; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import gram_hashes, mix, pieces, span_hashes, text_bytes, word_spans
from parlance.llm.samples import fitted, fold, labelled

SAMPLE = 4_000
CHAR_BITS, WORD_BITS = 15, 17
#: A text fails below so many words, above such a share (%) of repeated words, or below such a probability.
MIN_WORDS, MAX_REPEATED, MIN_PROBABILITY = 50, 50, 0.5
SYMBOLS = b"#*$%&|<>"
SCALE = 40.0
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


@dataclass
class Model:
    chars_w: np.ndarray
    words_w: np.ndarray
    bias: float
    slope: float
    shift: float


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring bounds."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _docs_of(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one anywhere, and which have an equal one before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = same
    some = later.copy()
    some[order[:-1]] |= same
    return some, later


def counts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """The exact counts of each text."""
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    doc = _docs_of(first)
    out = {"n_words": np.diff(first), "word_chars": _sums(points[ends] - points[starts], first), "n_symbols": _sums(_IS_SYMBOL[data], offsets)}

    line_start = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    line_doc = np.searchsorted(offsets[1:], line_start, side="right")
    line_start, line_doc = line_start[line_doc < len(offsets) - 1], line_doc[line_doc < len(offsets) - 1]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - (data[np.maximum(line_end - 1, 0)] == 10) * (line_end > line_start) if len(data) else line_end
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[worded], line_end[worded], line_doc[worded]
    with np.errstate(over="ignore"):
        _, later = _repeated(mix(span_hashes(data, line_start, line_end) + mix(line_doc.astype(np.uint64))))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=len(offsets) - 1)

    grams = gram_hashes(words, 3)
    covered = np.zeros(len(words), bool)
    if len(grams):
        at = np.flatnonzero(doc[:-2] == doc[2:])
        with np.errstate(over="ignore"):
            some, _ = _repeated(mix(grams[at] + mix(doc[at])))
        for k in range(3):
            covered[at[some] + k] = True
    out["n_repeat_words"] = _sums(covered, first)
    return out


def _windows(data: np.ndarray) -> np.ndarray:
    """Number of the 4 characters from each one on, under 1 << CHAR_BITS."""
    x = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(x) < 4:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        x = x[:-3] | (x[1:-2] << np.uint64(21)) | (x[2:-1] << np.uint64(42)) ^ (x[3:] * np.uint64(0xD6E8FEB86659FD93))
        return (mix(x) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple:
    """Feature numbers of 4-character windows and of words and word pairs, each with the bounds of every text."""
    grams = _windows(data)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    bounds = np.minimum(np.stack([at[:-1], np.clip(at[1:] - 3, at[:-1], None)]), len(grams))
    ones = (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pairs = (gram_hashes(words, 2) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pair_bounds = np.minimum(np.stack([first[:-1], np.clip(first[1:] - 1, first[:-1], None)]), len(pairs))
    return (grams, bounds), (ones, np.stack([first[:-1], first[1:]])), (pairs, pair_bounds)


def shares(parts: tuple) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features of each text and their shares: characters first, then words and pairs, which have one table."""
    out = []
    for i in range(parts[0][1].shape[1]):
        index, value = [], []
        for (numbers, bounds), offset in zip(parts, (0, 1 << CHAR_BITS, 1 << CHAR_BITS), strict=True):
            own, n = np.unique(numbers[bounds[0, i] : bounds[1, i]], return_counts=True)
            index.append(own + offset)
            value.append(n / max(1, n.sum()))
        out.append((np.concatenate(index).astype(np.int32), np.concatenate(value).astype(np.float32)))
    return out


def _means(parts: tuple, model: Model) -> np.ndarray:
    out = 0.0
    for (index, bounds), table in zip(parts, (model.chars_w, model.words_w, model.words_w), strict=True):
        total = np.concatenate([[0.0], np.cumsum(table[index], dtype=np.float64)])
        out = out + (total[bounds[1]] - total[bounds[0]]) / np.maximum(1, bounds[1] - bounds[0])
    return SCALE * out + model.bias


def probability(parts: tuple, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * _means(parts, model) + model.shift, -30, 30)))


def _prepare(array: pa.Array) -> tuple:
    data, offsets = text_bytes(array)
    starts, ends, first = word_spans(data, offsets)
    return data, offsets, starts, ends, first, span_hashes(data, starts, ends)


def keeps_all() -> Model:
    return Model(np.zeros(1 << CHAR_BITS), np.zeros(1 << WORD_BITS), 4.0, 1.0, 0.0)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], quality: np.ndarray, rounds: int = 60, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """The model of rows of `shares` and their labels."""
    if len(set(quality.tolist())) < 2:
        return keeps_all()
    bounds = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])])
    index, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(bounds))

    def logits() -> np.ndarray:
        return SCALE * np.bincount(owner, weights=weights[index] * value, minlength=len(rows)) + bias

    train = np.arange(len(rows)) % 4 != 3
    if len(set(quality[train].tolist())) < 2:
        train[:] = True
    share = np.where(quality == 1, 0.5 / max(1, quality[train].sum()), 0.5 / max(1, (1 - quality[train]).sum())) * train
    weights, bias = np.zeros((1 << CHAR_BITS) + (1 << WORD_BITS)), 0.0
    m, v, bias_m, bias_v = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for step in range(1, rounds + 1):
        gap = (1 / (1 + np.exp(-np.clip(logits(), -30, 30))) - quality) * share
        g = np.bincount(index, weights=(gap * SCALE)[owner] * value, minlength=len(weights)) + decay * weights
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        bias_m += 0.1 * (gap.sum() - bias_m)
        bias_v += 0.01 * (gap.sum() ** 2 - bias_v)
        bias -= rate * (bias_m / (1 - 0.9**step)) / (np.sqrt(bias_v / (1 - 0.99**step)) + 1e-7)
    model = Model(weights[: 1 << CHAR_BITS].astype(np.float32), weights[1 << CHAR_BITS :].astype(np.float32), float(bias), 1.0, 0.0)
    raw, held = logits(), ~train
    if len(set(quality[held].tolist())) == 2:
        x, y = raw[held], quality[held].astype(float)
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(500):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            a, b = max(1e-3, a - 0.05 * np.mean((p - target) * x)), b - 0.05 * np.mean(p - target)
        model.slope, model.shift = float(a), float(b)
    return model


def learn(docs: DataFrame, labels: DataFrame, seed: int = 0) -> Model:
    """The model of a bounded sample of labelled rows whose crc32 mod 5 is not 0."""

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1_500_000):
            data, offsets, _, _, first, words = _prepare(batch.column("text"))
            found = shares(features(data, offsets, first, words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["doc_id", "quality", "features", "shares"])

    def model(batches: Iterator[pa.RecordBatch]) -> Model:
        rows, quality = [], []
        for batch in batches:
            quality += batch.column("quality").to_pylist()
            rows += [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(batch.column("features").to_pylist(), batch.column("shares").to_pylist(), strict=True)]
        return fit(rows, np.array(quality, dtype=np.int64))

    sample = labelled(docs, labels, fold(F.col("doc_id"), 5) != 0, SAMPLE, seed)
    return fitted(sample.mapInArrow(inputs, "doc_id long, quality int, features binary, shares binary"), model) or keeps_all()


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document: the counts, base_failed, kept, and the model's probability as score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of fixed size, under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, "text"):
            data, offsets, starts, ends, first, words = _prepare(batch.column("text"))
            n = counts(data, offsets, starts, ends, first, words)
            score = probability(features(data, offsets, first, words), model)
            failed = (n["n_words"] < MIN_WORDS) | (100 * n["n_repeat_words"] > MAX_REPEATED * n["n_words"])
            columns = [pa.array(n[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns, pa.array(failed), pa.array(~failed & (score >= MIN_PROBABILITY)), pa.array(score)], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    return judge(docs, learn(docs, labels, seed))

"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built: it accepts exactly the substrings of that text. A whole
document is cross-parsed against each automaton: from the root the longest match is followed, where it ends a phrase is
counted and the root is entered again. The text's own language has long matches, so few phrases. A count is normalised to the
Ziv-Merhav estimate, phrases * log2(size of the automaton's text) / symbols; the language with the smallest wins, ties by
code point.

Symbols are the UTF-8 bytes of a text's lower-case letters (with their marks) and one blank in front of every word; digits
and signs separate words. So no script makes the tables wide, and phrases run across words.

The goto function and the return to the root are folded into one table of (state, symbol) for each language. Texts are cut
into lanes of LANE symbols that are parsed side by side in NumPy. A lane that begins within a text is first parsed as if a
phrase began there; then the parse that arrives from the lane before is followed into it until both are in one state, from
where on they are the same. So the phrases are those of one parse of the whole text.

Bounds (documented parameters): the automata learn from DOCS documents a language, those with the smallest hash, each with an
excerpt from a seeded place; TEXT symbols a language, less where there are so many languages that they would be over TOTAL.
Every language that occurs is learned. Catalyst keeps DOCS rows for each language and task before its exchange, so one
frequent language moves little.

Defined results: `und` and score 0 where the text is null or holds no letter, or where no language was learned; repeated rows
score alike; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import pieces, text_bytes
from parlance.llm.samples import fold

TEXT, TOTAL, DOCS, LANE = 30_000, 160_000, 60, 256
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double"
BLANK = 32


@dataclass
class Model:
    """Tables of all languages in one array: row = offset of the language + state, column = symbol; an entry is the next
    state, doubled, plus 1 where a phrase ends before the symbol. symbols: the column of each byte."""

    names: list[str]
    symbols: np.ndarray
    table: np.ndarray
    offsets: np.ndarray
    bits: np.ndarray


_folded: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or minus itself for a mark; 0 for all others."""
    if "table" not in _folded:
        table = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            if kind[0] == "L":
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
            elif kind[0] == "M":
                table[c] = -c
        _folded["table"] = table
    return _folded["table"]


def symbols_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all texts (bytes), the bounds of each, and whether a text has a letter."""
    data, offsets = text_bytes(array)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    kind = np.insert(_letters()[points], at[:-1], 0)  # a blank in front of each text
    at = at + np.arange(len(at))
    inside = kind != 0
    keep = inside.copy()
    keep[:-1] |= inside[1:]
    kept = np.where(inside, np.abs(kind), BLANK)[keep].astype("<u4")
    place = np.concatenate([[0], np.cumsum(keep)])[at]
    size = 1 + (kept > 0x7F) + (kept > 0x7FF) + (kept > 0xFFFF)
    letters = np.concatenate([[0], np.cumsum(kind > 0)])
    out = np.frombuffer(kept.tobytes().decode("utf-32-le").encode(), np.uint8)
    return out, np.concatenate([[0], np.cumsum(size)])[place], letters[at[1:]] > letters[at[:-1]]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton that accepts the substrings of `text`; state 0 is the root."""
    goto: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        here = len(goto)
        goto.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = here
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                copy = len(goto)
                goto.append(dict(goto[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    return goto


def learn_model(samples: dict[str, list[str]], text: int = TEXT, total: int = TOTAL) -> Model:
    """Automata of each language's texts, joined and cut to an equal share of `total` each, `text` at most."""
    names = sorted(samples)
    share = max(1, min(text, total // max(1, len(names))))
    joined = {n: symbols_of(pa.array([" ".join(samples[n])], pa.string()))[0][:share] for n in names}
    names = [n for n in names if len(joined[n])]
    known = np.unique(np.concatenate([joined[n] for n in names])) if names else np.zeros(0, np.uint8)
    symbols = np.full(256, len(known), np.int64)  # the last column: a symbol no language has
    symbols[known] = np.arange(len(known))
    tables, offsets = [], []
    for n in names:
        goto = suffix_automaton(symbols[joined[n]].tolist())
        lone = len(goto)  # the state after a symbol that no phrase holds: every symbol begins a phrase there
        root = np.full(len(known) + 1, 2 * lone + 1, np.int32)
        for c, state in goto[0].items():
            root[c] = 2 * state + 1
        table = np.tile(root, (lone + 1, 1))
        for state, row in enumerate(goto):
            for c, to in row.items():
                table[state, c] = 2 * to
        table[0] -= table[0] & 1  # the root is where a parse begins: its first phrase is counted already
        offsets.append(sum(len(t) for t in tables))
        tables.append(table)
    bits = np.array([np.log2(max(2, len(joined[n]))) for n in names])
    return Model(names, symbols, np.concatenate(tables) if tables else np.zeros((0, len(known) + 1), np.int32), np.array(offsets, np.int64), bits)


def phrases(codes: np.ndarray, bounds: np.ndarray, model: Model, lane: int = LANE) -> np.ndarray:
    """Phrases of each text (columns of the table between neighbouring bounds) in each language: (texts, languages)."""
    sizes = np.diff(bounds)
    n_lanes = -(-sizes // lane)
    text = np.repeat(np.arange(len(sizes)), n_lanes)
    within = np.arange(len(text)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
    begin = bounds[:-1][text] + within * lane
    size = np.minimum(lane, bounds[1:][text] - begin)
    order = np.argsort(-size, kind="stable")  # longest first: the lanes with a symbol at a step are the first ones
    live = [int(np.searchsorted(-size[order], -step, side="left")) for step in range(int(size.max()) if len(size) else 0)]
    width, flat = model.table.shape[1], model.table.ravel()
    out = np.zeros((len(sizes), len(model.names)), np.int64)
    trace = np.zeros(len(codes), np.int32)
    for k, offset in enumerate(model.offsets):
        state = np.zeros(len(order), np.int64)
        for step, n in enumerate(live):
            here = begin[order[:n]] + step
            got = flat[(offset + state[:n]) * width + codes[here]]
            trace[here] = got
            state[:n] = got >> 1
        todo = np.flatnonzero(within > 0)
        while len(todo):
            changed = []
            lanes, state, step = todo, (trace[begin[todo] - 1] >> 1).astype(np.int64), 0
            while len(lanes):
                here = begin[lanes] + step
                got = flat[(offset + state) * width + codes[here]]
                same = (trace[here] >> 1) == (got >> 1)
                trace[here] = got
                step += 1
                ended = size[lanes] == step
                changed.append(lanes[ended & ~same])
                go = ~same & ~ended
                lanes, state = lanes[go], (got[go] >> 1).astype(np.int64)
            after = np.concatenate(changed) + 1
            after = after[after < len(text)]
            todo = np.sort(after[within[after] > 0])
        total = np.concatenate([[0], np.cumsum(trace & 1, dtype=np.int64)])
        out[:, k] = total[bounds[1:]] - total[bounds[:-1]] + (sizes > 0)
    return out


def predict(array: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. Score: the share of the best in 2 ** (-bits of each symbol), sharpened."""
    names, scores = [UNKNOWN] * len(array), np.zeros(len(array))
    symbols, bounds, lettered = symbols_of(array)
    some = np.flatnonzero(lettered)
    if not len(some) or not model.names:
        return names, scores
    rate = phrases(model.symbols[symbols], bounds, model)[some] * model.bits / np.diff(bounds)[some, None]
    best = np.argmin(rate, axis=1)
    for i, b in zip(some.tolist(), best.tolist(), strict=True):
        names[i] = model.names[b]
    scores[some] = 1 / np.exp2(-8 * (rate - rate.min(axis=1, keepdims=True))).sum(axis=1)
    return names, scores


def learn(docs: DataFrame, seed: int = 0) -> Model:
    """A model of documents with a language whose crc32 mod 3 is not 1."""
    may = docs.where((fold(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull())
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id"))
    chosen = may.select("lang", "doc_id").distinct().withColumn("_place", place).where(F.col("_place") <= DOCS)
    long = 2 * TEXT // DOCS  # characters of an excerpt: signs and digits in it are no symbols
    start = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.greatest(F.lit(1), F.char_length("text") - long + 1)).cast("int") + 1
    rows = may.where("text is not null").select("lang", "doc_id", F.substring(F.col("text"), start, F.lit(long)).alias("text"))
    rows = rows.join(F.broadcast(chosen), ["lang", "doc_id"])  # at most DOCS ids a language
    rows = rows.groupBy("lang", "doc_id").agg(F.min(F.struct("_place", "text")).alias("x")).select("lang", "x.*").orderBy("lang", "_place")
    samples: dict[str, list[str]] = {}
    for r in rows.collect():
        samples.setdefault(r.lang, []).append(r.text)
    return learn_model(samples)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TOTAL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2_000_000):
            names, scores = predict(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def language_id(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row for each document: doc_id, held_out (it was not learned from), lang_pred, score."""
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return identify(docs, learn(docs, seed)).select("doc_id", held.alias("held_out"), "lang_pred", "score")

"""Substring dedup: words in windows that another document has first are removed, found by suffix automata.

A suffix automaton of a whole corpus would have to be sent to every task, so the reference is cut into shards that hold only
what can match, and documents are sent to the shard that can match them:

1. Every window of `window` words is named by its smallest hash of GRAM consecutive words (its minimizer), which depends on
   the window's words alone: equal windows meet under equal names. Runs of neighbouring windows with one name form a
   fragment, of at most RUN windows.
2. Names are counted in one exchange of packed arrays. A name that only one document has cannot matter. A name of at least
   HOT documents is hot; a task that finds HOT of its own documents under a name sends one entry for all of them.
3. Documents with names that repeat are read again, and their fragments go to the name's shard with their places, copies in
   a task merged, so a shard holds fewer than HOT documents' fragments under one name. A hot name's fragments do not go there:
   the distinct ones are cut into windows, whose first documents are a partial aggregate over 128-bit hashes, and only that
   result meets the places.
4. A shard's automaton takes its distinct fragments in the order of doc_id. Before a fragment is added it is streamed through
   for matching statistics, each state knowing the first document that made it: a match of `window` words gives the first
   document with that window. Names whose fragments are all equal need no automaton.
5. Each window whose first document is smaller than the one it stands in is removed, all its words. Windows are judged on the
   input, not on what is left.

Windows are compared by their words; fragments are told apart by 128-bit hashes. The text crosses two exchanges by doc_id.

Defined results: null or empty texts have no words, and the hash of the empty text; texts shorter than a window, and rows
with a null doc_id, are kept whole; rows that repeat a doc_id are one document as far as removal goes (nothing is removed
for a row of the same id); an empty table gives an empty result; `deduplicated` keeps other columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import gram_hashes, materialize, mix, partitions, pieces, span_hashes, text_bytes, word_spans

GRAM, RUN, HOT, FLUSH, SHARD_WORDS, TASK_BYTES = 6, 64, 1_024, 1_000_000, 50_000, 16_000_000


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of `width` neighbouring values from each position on."""
    out, step = values, 1
    while step * 2 <= width:
        out, step = np.minimum(out[:-step], out[step:]), step * 2
    return np.minimum(out[: len(out) - (width - step)], out[width - step :]) if step < width else out


class Words:
    """The words of a batch of texts, their hashes, and the runs of windows that share a name."""

    def __init__(self, array: pa.Array, window: int):
        self.data, self.offsets = text_bytes(array)
        self.starts, self.ends, self.first = word_spans(self.data, self.offsets)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        gram = min(GRAM, window)
        empty = np.zeros(0, np.int64)
        self.run_start, self.run_n, self.run_doc, self.run_name = empty, empty, empty, np.zeros(0, np.uint64)
        if len(self.hashes) < window:
            return
        names = _window_minima(gram_hashes(self.hashes, gram), window - gram + 1)
        at = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
        if not len(at):
            return
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (names[at[1:]] != names[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
        head = np.flatnonzero(new)
        within = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
        head = np.flatnonzero(within % RUN == 0)
        self.run_start, self.run_n = at[head], np.diff(np.append(head, len(at)))
        self.run_doc, self.run_name = doc[at[head]], names[at[head]]

    def text(self, start: int, n: int) -> bytes:
        return b" ".join(self.data[self.starts[start] : self.ends[start + n - 1]].tobytes().split())


def _pack(names: np.ndarray, docs: np.ndarray, hot: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(names, prepend=np.uint64(0)).tobytes() + docs.tobytes() + hot.tobytes(), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n = len(raw) // 17
    with np.errstate(over="ignore"):
        return np.cumsum(np.frombuffer(raw, np.uint64, n)), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.uint8, n, 16 * n)


NAMED = "part int, known boolean, names binary"
FLAGGED = "doc_id long, name long, hot boolean"


def name_counts(docs: DataFrame, window: int, n_parts: int, hot_from: int = HOT) -> DataFrame:
    """FLAGGED: for each document the names that other documents have too, and which of them are hot."""
    parts = 8 * n_parts

    def emit(names: list[np.ndarray], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        name, doc = np.concatenate(names), np.concatenate(ids)
        order = np.lexsort((doc, name))
        name, doc = name[order], doc[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        name, doc = name[new], doc[new]
        head = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
        size = np.repeat(np.diff(np.append(head, len(name))), np.diff(np.append(head, len(name))))
        hot = size >= hot_from
        first = np.zeros(len(name), bool)
        first[head] = True
        known = _pack(name[hot], doc[hot], hot[hot].astype(np.uint8)) if hot.any() else None
        sent = ~hot | first
        name, doc, hot = name[sent], doc[sent], hot[sent].astype(np.uint8)
        part = (name % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((name, part))
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, False, _pack(name[o], doc[o], hot[o])) for p in range(parts) if len(o := order[bounds[p] : bounds[p + 1]])]
        rows += [(int(doc[0]) % parts, True, known)] if known else []
        for k in range(0, len(rows), 1_000):
            a, b, c = zip(*rows[k : k + 1_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.bool_()), pa.array(c, pa.binary())], ["part", "known", "names"])

    def name_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, n = [], [], 0
        for batch in pieces(batches, "text", 2_000_000):
            words = Words(batch.column("text"), window)
            names.append(words.run_name)
            ids.append(batch.column("doc_id").to_numpy()[words.run_doc])
            n += len(words.run_name)
            if n >= FLUSH:
                yield from emit(names, ids)
                names, ids, n = [], [], 0
        if n:
            yield from emit(names, ids)

    def flagged(doc: np.ndarray, name: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(doc), 50_000):
            part = slice(k, k + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(doc[part]), pa.array(name[part].view(np.int64)), pa.array(hot[part])], ["doc_id", "name", "hot"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for known, blob in zip(batch.column("known").to_pylist(), batch.column("names").to_pylist(), strict=True):
                name, doc, hot = _unpack(blob)
                if known:
                    yield from flagged(doc, name, hot > 0)
                else:
                    held.append((name, doc, hot))
        if not held:
            return
        name, doc, hot = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(name, kind="stable")
        name, doc, hot = name[order], doc[order], hot[order]
        head = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        size = np.diff(np.append(head, len(name)))
        weight = np.add.reduceat(np.where(hot > 0, hot_from, 1), head)
        back = np.repeat(weight >= 2, size) & (hot == 0)
        yield from flagged(doc[back], name[back], np.repeat(weight >= hot_from, size)[back])

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(name_runs, NAMED)
    return rows.repartition(n_parts, "part").mapInArrow(count, FLAGGED)


FRAGMENTS = "name long, key1 long, key2 long, hot boolean, doc_id long, words binary, docs binary, starts binary"


def fragments(docs: DataFrame, flagged: DataFrame, window: int) -> DataFrame:
    """A row for each fragment and task: its words, its smallest document, and the documents (8 bytes each) and places (4 bytes)
    where it stands."""
    lists = flagged.groupBy("doc_id").agg(F.collect_list("name").alias("names"), F.collect_list("hot").alias("hot"))
    rows = docs.select("doc_id", "text").join(lists, "doc_id")
    names_of = [x.split()[0] for x in FRAGMENTS.split(", ")]

    def places(batch: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of the batch's fragments: hot, doc_id, first word, windows, place in the text, name and keys."""
        words, ids = Words(batch.column("text"), window), batch.column("doc_id").to_numpy()
        bounds = np.searchsorted(words.run_doc, np.arange(len(ids) + 1))
        keep, hot = np.zeros(len(words.run_name), bool), np.zeros(len(words.run_name), bool)
        names, hots = batch.column("names"), batch.column("hot")
        for k in range(len(ids)):
            have = names[k].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            is_hot = hots[k].values.to_numpy(zero_copy_only=False).astype(bool)
            own = slice(bounds[k], bounds[k + 1])
            keep[own] = np.isin(words.run_name[own], have)
            hot[own] = np.isin(words.run_name[own], have[is_hot])
        at = np.flatnonzero(keep)
        start, n = words.run_start[at], words.run_n[at]
        with np.errstate(over="ignore"):
            keys = [_sequence_hash(words.hashes, start, n + window - 1, seed) for seed in (1, 2)]
        return words, hot[at], ids[words.run_doc[at]], start, n, start - words.first[words.run_doc[at]], [words.run_name[at], *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int, bool], list] = {}
        size = 0

        def merged() -> Iterator[pa.RecordBatch]:
            rows = list(held.items())
            for k in range(0, len(rows), 20_000):
                part = rows[k : k + 20_000]
                docs = [np.concatenate(v[1]) for _, v in part]
                columns = [pa.array(np.array([key[j] for key, _ in part], np.uint64).view(np.int64)) for j in range(3)]
                columns += [pa.array([key[3] for key, _ in part], pa.bool_()), pa.array([int(d.min()) for d in docs], pa.int64()), pa.array([v[0] for _, v in part], pa.binary())]
                columns += [pa.array([d.tobytes() for d in docs], pa.binary()), pa.array([np.concatenate(v[2]).astype(np.int32).tobytes() for _, v in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names_of)

        for batch in pieces(batches, "text", 2_000_000):
            words, hot, doc, start, n, where, keys = places(batch)
            order = np.lexsort((doc, keys[2], keys[1]))
            new = np.ones(len(order), bool)
            new[1:] = (keys[1][order[1:]] != keys[1][order[:-1]]) | (keys[2][order[1:]] != keys[2][order[:-1]])
            head = np.flatnonzero(new)
            for i, j in zip(head.tolist(), [*head[1:].tolist(), len(order)], strict=True):
                k = order[i]
                at = held.get(key := (int(keys[0][k]), int(keys[1][k]), int(keys[2][k]), bool(hot[k])))
                if at is None:
                    at = held[key] = [words.text(int(start[k]), int(n[k]) + window - 1), [], []]
                    size += len(at[0]) + 200
                own = order[i:j]
                at[1].append(doc[own])
                at[2].append(where[own])
                size += 12 * len(own) + 200
            if size >= TASK_BYTES:
                yield from merged()
                held.clear()
                size = 0
        yield from merged()

    return rows.mapInArrow(run, FRAGMENTS)


_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def _sequence_hash(hashes: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each run of words, from prefix sums."""
    n = len(hashes)
    base = _BASE + np.uint64(2 * seed)
    up = np.full(n + 1, base, np.uint64)
    down = np.full(n + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
    up[0] = down[0] = 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes, seed) * np.multiply.accumulate(up)[:n])])
    return mix((total[start + size] - total[start]) * np.multiply.accumulate(down)[start] + size.astype(np.uint64), seed)


class Automaton:
    """A generalised suffix automaton of word sequences; every state knows the first document that reached it."""

    def __init__(self, window: int):
        self.window = window
        self.goto: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def matches(self, words: list, own: int) -> list[int]:
        """First document of the window that ends at each word from the window-th on; `own` where it is new."""
        goto, link, length, first, window = self.goto, self.link, self.length, self.first, self.window
        state, match, out = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in goto[state]:
                state = link[state]
                match = length[state]
            if w in goto[state]:
                state, match = goto[state][w], match + 1
            while length[link[state]] >= window and state:
                state = link[state]
                match = length[state]
            match = min(match, window) if match >= window else match
            if i >= window - 1:
                out.append(first[state] if match >= window else own)
        return out

    def add(self, words: list, doc: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w, doc)

    def _extend(self, last: int, w, doc: int) -> int:
        goto, link, length = self.goto, self.link, self.length
        if (q := goto[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._copy(last, w, q)
        here = len(goto)
        goto.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.first.append(doc)
        p = last
        while p >= 0 and w not in goto[p]:
            goto[p][w] = here
            p = link[p]
        if p >= 0:
            q = goto[p][w]
            link[here] = q if length[q] == length[p] + 1 else self._copy(p, w, q)
        return here

    def _copy(self, p: int, w, q: int) -> int:
        goto, link = self.goto, self.link
        copy = len(goto)
        goto.append(dict(goto[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.first.append(self.first[q])
        link[q] = copy
        while p >= 0 and goto[p].get(w) == q:
            goto[p][w] = copy
            p = link[p]
        return copy


def first_documents(rows: list[tuple], window: int) -> Iterator[tuple[tuple[int, int], list[int], list[tuple]]]:
    """Keys, first document of each window (one number where all are alike) and rows of each distinct fragment of a shard.
    rows: (name, key1, key2, doc_id, words, ...), whole names together."""
    same: dict[tuple[int, int, int], list[tuple]] = {}
    for row in rows:
        same.setdefault(row[:3], []).append(row)
    names: dict[int, int] = {}
    for name, _, _ in same:
        names[name] = names.get(name, 0) + 1
    shard = []
    for (name, *keys), own in same.items():
        least = min(own, key=lambda r: r[3])
        if names[name] == 1:
            yield tuple(keys), [least[3]], own
        else:
            shard.append((least[3], *keys, least[4], own))
    automaton = Automaton(window)
    for doc, key1, key2, words, own in sorted(shard, key=lambda x: x[:3]):
        split = words.split()
        found = automaton.matches(split, doc)
        automaton.add(split, doc)
        yield (key1, key2), found if len(set(found)) > 1 else found[:1], own


REMOVED = "doc_id long, start int, n int"


def removals(firsts: list[int], n: int, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first window and number of windows of each stretch that goes."""
    if len(firsts) == 1:
        gone = docs > firsts[0]
        return docs[gone], starts[gone], np.full(int(gone.sum()), n, np.int32)
    gone = docs[:, None] > np.array(firsts)
    edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return docs[row], (starts[row] + begin).astype(np.int32), (end - begin).astype(np.int32)


def _removed(rows: list[tuple[list[int], int, bytes, bytes]]) -> pa.RecordBatch:
    """REMOVED of (first documents, windows, docs, starts)."""
    gone = [removals(f, n, np.frombuffer(d, np.int64), np.frombuffer(s, np.int32)) for f, n, d, s in rows]
    columns = [np.concatenate([g[i] for g in gone]) if gone else np.zeros(0) for i in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "start", "n"])


def judge(found: DataFrame, window: int, n_parts: int) -> DataFrame:
    """REMOVED of the fragments of names that are not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        out = lambda: _removed([(firsts, own[0][4].count(b" ") + 2 - window, b"".join(r[5] for r in own), b"".join(r[6] for r in own)) for _, firsts, own in first_documents(held, window)])
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("name", "key1", "key2", "doc_id", "words", "docs", "starts")), strict=True):
                if size >= SHARD_WORDS and row[0] != held[-1][0]:
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += row[4].count(b" ") + 1
        if held:
            yield out()

    rows = found.where("not hot").select("name", "key1", "key2", "doc_id", "words", "docs", "starts")
    return rows.repartition(n_parts, "name").sortWithinPartitions("name").mapInArrow(run, REMOVED)


WINDOWS = "key1 long, key2 long, idx int, w1 long, w2 long, doc_id long"


def judge_hot(found: DataFrame, window: int) -> DataFrame:
    """REMOVED of the fragments of hot names, which are few distinct ones in very many places: each distinct one is cut into
    its windows once, a window's first document is a partial aggregate, and only the result meets the places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key1, key2, doc, words in zip(*(batch.column(c).to_pylist() for c in ("key1", "key2", "doc_id", "words")), strict=True):
                split = words.split()
                for i in range(len(split) - window + 1):
                    digest = hashlib.blake2b(b" ".join(split[i : i + window]), digest_size=16).digest()
                    rows.append((key1, key2, i, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), doc))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in WINDOWS.split(", ")])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = [[x["first"] for x in f] for f in batch.column("firsts").to_pylist()]
            short = [f if len(set(f)) > 1 else f[:1] for f in firsts]
            yield _removed([(s, len(f), d, p) for s, f, d, p in zip(short, firsts, batch.column("docs").to_pylist(), batch.column("starts").to_pylist(), strict=True)])

    hot = found.where("hot")
    distinct = hot.groupBy("key1", "key2").agg(F.min("doc_id").alias("doc_id"), F.first("words").alias("words"))
    windows = materialize(distinct.mapInArrow(cut, WINDOWS), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"))
    firsts = windows.join(first, ["w1", "w2"]).groupBy("key1", "key2").agg(F.array_sort(F.collect_list(F.struct("idx", "first"))).alias("firsts"))
    return hot.select("key1", "key2", "docs", "starts").join(firsts, ["key1", "key2"]).select("firsts", "docs", "starts").mapInArrow(meet, REMOVED)


def removed_windows(docs: DataFrame, window: int, hot_from: int = HOT) -> DataFrame:
    """(doc_id, windows): start and number of the windows of each document that go, for documents that have any."""
    n_parts = partitions(docs)
    found = materialize(fragments(docs, name_counts(docs, window, n_parts, hot_from), window), "fragments")
    rows = materialize(judge(found, window, n_parts).union(judge_hot(found, window)), "removed")
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("windows"))


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, windows: list[dict] | None, window: int) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept words joined by blanks."""
    gone = np.zeros(len(starts) + 1, np.int64)
    for x in windows or ():
        gone[x["start"]] += 1
        gone[x["start"] + x["n"] + window - 1] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    if keep.all():
        return len(starts), 0, b" ".join(data.tobytes().split())
    words = data.tobytes().split()
    return len(starts), int((~keep).sum()), b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def _apply(docs: DataFrame, window: int, schema: T.StructType, result, hot_from: int = HOT) -> DataFrame:
    names = docs.columns
    marks = removed_windows(docs, window, hot_from).select(F.col("doc_id").alias("sd__id"), F.col("windows").alias("sd__windows"))
    rows = docs.join(marks, F.col("doc_id") == F.col("sd__id"), "left").select(*names, "sd__windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2_000_000):
            data, offsets = text_bytes(batch.column("text"))
            starts, ends, first = word_spans(data, offsets)
            marks = batch.column("sd__windows").to_pylist()
            done = [_kept(data[offsets[i] : offsets[i + 1]], starts[first[i] : first[i + 1]], ends, marks[i], window) for i in range(batch.num_rows)]
            yield result(batch.select(names), done)

    return rows.mapInArrow(run, schema)


def substring_digest(docs: DataFrame, window: int = 13, hot_from: int = HOT) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256."""

    def result(batch: pa.RecordBatch, done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([hashlib.sha256(d[2]).hexdigest() for d in done])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return _apply(docs.select("doc_id", "text"), window, schema, result, hot_from)


def deduplicated(docs: DataFrame, window: int = 13) -> DataFrame:
    """`docs` with the removed words gone from `text` (and `n_chars` set anew); texts that lose nothing stay as they are."""
    names = docs.columns

    def result(batch: pa.RecordBatch, done: list) -> pa.RecordBatch:
        old = batch.column("text").to_pylist()
        new = [t if d[1] == 0 else d[2].decode() for t, d in zip(old, done, strict=True)]
        columns = [pa.array(new, pa.string()) if n == "text" else pa.array([None if x is None else len(x) for x in new], batch.column(n).type) if n == "n_chars" else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays(columns, names)

    return _apply(docs, window, docs.schema, result)

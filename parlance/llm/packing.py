"""Best-fit packing by sums of squares: documents as token ids, cut and placed into sequences of a fixed capacity.

Sum-of-squares rule: with N(g) open sequences of residual gap g, a piece goes to the open sequence that holds it and after
which the sum of N(g)^2 is smallest; closed sequences (gap 0) do not count. Ties go to the tightest gap. A sequence is opened
only where no open one holds the piece. Pieces come longest first, so that what cannot share a sequence opens one early
and small pieces close them; every place follows the rule. On the test documents that needs 0.01 % more sequences than the
tokens do (weighing a new sequence against the open ones, as the rule does for pieces in random order, 0.5 %).

Pieces are dealt evenly, whatever their ids, into shards of about SHARD pieces, each packed on its own in the order of
length, ids and place: a shard's memory is a few numbers for each piece, it leaves at most its last open sequences short, and
a task that is tried again finds the same places. Pieces that fill a sequence alone never enter the search.

Ids: those of the `tokenizers` file, which come through the rank file of the same vocabulary, three times as fast; texts
that hold a special token's string go to `tokenizers` itself. `tests/llm` compares the ids of all test documents, and of
long runs without a blank.

Defined results: null or empty text is one piece, the end mark alone; repeated rows are packed as rows of their own; an
empty table gives an empty result; other columns are never read. A null doc_id is kept as such.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import materialize, pieces

SHARD = 200_000
CAPACITY = 1024
END_ID = 2
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

_loaded: dict[tuple, object] = {}


def _encoders(json_path: str, ranks_path: str, pattern: str):
    if (key := (json_path, ranks_path)) not in _loaded:
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        full = Tokenizer.from_file(json_path)
        special = [t.content for t in full.get_added_tokens_decoder().values()]
        _loaded[key] = full, tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), special
    return _loaded[key]


def encode(texts: list[str | None], json_path: str, ranks_path: str, pattern: str) -> Iterator[np.ndarray]:
    """Token ids of each text, as `tokenizers` gives them without added special tokens; null: none."""
    full, fast, special = _encoders(json_path, ranks_path, pattern)
    for text in texts:
        if not text:
            yield np.zeros(0, "<u4")
        elif any(s in text for s in special):
            yield np.array(full.encode(text, add_special_tokens=False).ids, dtype="<u4")
        else:
            yield np.array(fast.encode_ordinary(text), dtype="<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only longer ones are cut, and only the first piece may be shorter."""
    head = n % capacity if n > capacity else n
    starts = ([0] if head else []) + [*range(head, n, capacity)]
    return [(s, head if s == 0 and head else capacity) for s in starts]


def pieces_of(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows of doc_id, piece, start, length, ids_crc32, and the ids themselves where `with_ids` is set."""
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows: list[list] = [[] for _ in range(6)]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist(), json_path, ranks_path, pattern), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    for column, value in zip(rows, (doc_id, k, start, length, zlib.crc32(part.tobytes()), part), strict=True):
                        column.append(value)
            arrays = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in rows[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences: longest first, by sums of squares."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)  # count[0], of closed sequences, stays 0
    new = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        gap = capacity
        if s < capacity:
            # Growth of the sum when gap g becomes g - s: 2 * (N(g - s) - N(g)) + 2, or 1 - 2 * N(s) when it closes.
            before, after = count[s:], count[: capacity + 1 - s]
            growth = np.where(before > 0, 2 * (after - before) + 2, np.iinfo(np.int64).max)
            if before[0] > 0:
                growth[0] = 1 - 2 * before[0]
            at = int(np.argmin(growth))
            gap = at + s if before[at] > 0 else capacity
        if gap == capacity:
            where[i] = new
            new += 1
        else:
            where[i] = open_by_gap[gap].pop()
            count[gap] -= 1
        offset[i] = capacity - gap
        if left := gap - s:
            open_by_gap[left].append(int(where[i]))
            count[left] += 1
    return where, offset, new


def pack(rows: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece, start, length and ids_crc32. The rows are counted once.

    `rows` should be a written table: they are dealt in turn, and only what is read again in the same order is dealt alike.
    """
    n = max(1, math.ceil(rows.count() / shard))
    at = rows.schema.names.index("length")
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        where, offset, _ = place(table.column(at).to_numpy(), capacity)
        where += np.int64(TaskContext.get().partitionId()) << 40
        yield from table.append_column("sequence_id", pa.array(where)).append_column("offset", pa.array(offset)).to_batches(max_chunksize=10_000)

    order = [F.desc("length"), *(c for c in ("doc_id", "piece", "start", "ids_crc32", "row") if c in rows.columns)]
    return rows.repartition(n).sortWithinPartitions(*order).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, shard: int = SHARD) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(pieces_of(docs, json_path, ranks_path, pattern, capacity, end_id), "pieces"), capacity, shard)


def sequences(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, shard: int = SHARD) -> DataFrame:
    """The packed sequences themselves: sequence_id, input_ids (at most `capacity`), doc_ids and the pieces' offsets. Every
    piece has a row number, so repeated documents and null ids are placed as often as they occur."""
    made = materialize(pieces_of(docs, json_path, ranks_path, pattern, capacity, end_id, with_ids=True).withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = pack(made.drop("ids"), capacity, shard).select("row", "sequence_id", "offset", "doc_id")
    item = F.struct("offset", "doc_id", "ids")
    rows = placed.join(made.select("row", "ids"), "row").groupBy("sequence_id").agg(F.array_sort(F.collect_list(item)).alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("input_ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["offset"]).alias("offsets"))

"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors are compared only within a label. Equal vectors are one class, named by its smallest vec_id and weighted by its
copies. The classes of a label are dealt into blocks of about BLOCK by a hash of the name; every pair of blocks is a tile,
a task's unit of work, found by an equi-join on (label, tile) in which each block row stands for BLOCK vectors.

In a tile, unit vectors x = s q + e (q int8, s a scale, e the error) give x.y = s_x s_y q_x.q_y + r with
|r| <= |e_x| |s_y q_y| + |e_y| |s_x q_x| + |e_x| |e_y|: the norms are computed for every vector, so the bound is rigorous (a
slack of 1e-9 covers rounding). Products of int8 are exact in float32 up to 1,000 dimensions, which the matrix product
uses. Blocks are quantised once, and only int8 values and three numbers a vector go to the tiles. Pairs whose estimate less the
bound reaches the threshold are links, those whose estimate plus the bound does not are none; the places of all others are kept
in packed arrays, and full vectors are sent to the tiles that have some, where these pairs are computed in double precision.
A tile returns counts of links and the links of a spanning forest, never all pairs.

All pairs of a label are compared, so the work grows as the square of a label's distinct vectors, in tiles that machines
share; no tile holds more than two blocks.

Defined results: vectors that are null, zero or empty, or hold null or non-finite components, and rows with a null label
link with nothing; vectors of another length than their partner do not link; a null vec_id gets a null component and is
kept, and links with nothing; repeated rows count as copies; vectors are scaled by a power of two before use, so very large
and very small components neither overflow nor vanish; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import discard, materialize
from parlance.llm.components import connected_components

BLOCK = 2_048
SLACK = 1e-9
BLOCKS = "label string, width int, block int, ids binary, copies binary, small binary, bounds binary, vectors binary"
FOUND = "label string, width int, tile_a int, tile_b int, id long, n long, a long, b long, i binary, j binary"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors times powers of two, the largest component of each between 1/2 and 1."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, norm of what they stand for and norm of the error, of each unit vector."""
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def exact_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (place in a, place in b) have a cosine >= threshold, in double precision."""
    na, nb = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 100_000):
        s = slice(k, k + 100_000)
        keep[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) / (na[i[s]] * nb[j[s]]) >= threshold
    return keep


def tile_pairs(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """By the bounds of quantised blocks: which pairs are links, and which may be."""
    (qa, sa, ha, ea), (qb, sb, hb, eb) = a, b
    exact = qa.shape[1] * 127 * 127 < 1 << 24
    near = (qa.astype(np.float32 if exact else np.float64) @ qb.astype(np.float32 if exact else np.float64).T).astype(np.float64)
    near *= sa[:, None] * sb
    bound = ea[:, None] * (hb + eb) + ha[:, None] * eb + SLACK
    sure = near - bound >= threshold
    return sure, ~sure & (near + bound >= threshold)


def forest(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each linked position with the smallest that it reaches: (position, smallest)."""
    n = int(max(i.max(), j.max())) + 1 if len(i) else 0
    low = np.arange(n)
    while True:
        was = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == was).all():
            at = np.flatnonzero(low != np.arange(n))
            return np.stack([at, low[at]], axis=1)


def _classes(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as text), width, key1, key2 and the vector of rows that can link."""
    value = F.col("embedding").cast("array<double>")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    ok = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine, F.lit(False))
    plus = F.transform(value, lambda x: x + F.lit(0.0))  # -0.0 as 0.0
    cols = ["vec_id", F.col("label").cast("string").alias("label"), F.size(value).alias("width"), F.xxhash64(plus).alias("key1"), F.xxhash64(F.lit(1), plus).alias("key2"), ok.alias("ok"), value.alias("vector")]
    return vectors.select("vec_id", "label", "embedding").select(*cols)


def _binary(array: np.ndarray, kind: type) -> pa.Array:
    return pa.array([np.ascontiguousarray(array, dtype=kind).tobytes()], pa.binary())


def _result(key: tuple, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, i: np.ndarray, j: np.ndarray, one: bool, open_i: np.ndarray, open_j: np.ndarray) -> pa.Table:
    """FOUND of a tile's links (i, j): links of each vector, a forest of them, and the pairs that are open."""
    links_a = np.bincount(i, weights=n_b[j], minlength=len(ids_a)).astype(np.int64)
    links_b = np.bincount(j, weights=n_a[i], minlength=len(ids_b)).astype(np.int64)
    tree = forest(i, j + (0 if one else len(ids_a)))
    ids = np.concatenate([ids_a, ids_b])
    kept_a, kept_b = np.flatnonzero(links_a), np.flatnonzero(links_b)
    n, m, k = len(kept_a) + len(kept_b), len(tree), int(len(open_i) > 0)
    none = lambda size, kind=pa.int64(): pa.nulls(size, kind)
    columns = [pa.chunked_array([pa.array([x.as_py()] * (n + m + k), t)]) for x, t in zip(key, (pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
    columns.append(pa.chunked_array([pa.array(np.concatenate([ids_a[kept_a], ids_b[kept_b]])), none(m + k)]))
    columns.append(pa.chunked_array([pa.array(np.concatenate([links_a[kept_a], links_b[kept_b]])), none(m + k)]))
    columns += [pa.chunked_array([none(n), pa.array(ids[tree[:, side]]), none(k)]) for side in (0, 1)]
    columns += [pa.chunked_array([none(n + m, pa.binary()), _binary(x, np.int32) if k else none(0, pa.binary())]) for x in (open_i, open_j)]
    return pa.Table.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])


def near_embeddings(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """One row for each vector: vec_id, n_links (other vectors linked directly), component_id, kept."""
    keys = ["label", "width", "key1", "key2"]
    rows = _classes(vectors)
    classes = materialize(rows.where("ok").groupBy(*keys).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "vectors")
    sizes = materialize(classes.groupBy("label", "width").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks")), "blocks")
    dealt = classes.join(sizes, ["label", "width"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))

    def to_blocks(key, batch):
        order = np.argsort(batch.column("id").to_numpy())
        flat = scaled(batch.column("vector").combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order])
        q, *bounds = quantise(flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None])
        columns = [pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.int32())]
        columns += [_binary(batch.column(c).to_numpy()[order], np.int64) for c in ("id", "copies")] + [_binary(q, np.int8), _binary(np.stack(bounds), np.float64), _binary(flat, np.float64)]
        return pa.Table.from_arrays(columns, [x.split()[0] for x in BLOCKS.split(", ")])

    blocks = materialize(dealt.select("label", "width", "block", "id", "copies", "vector").groupBy("label", "width", "block").applyInArrow(to_blocks, BLOCKS), "blocks")
    tile = ["label", "width", "tile_a", "tile_b"]

    def dealt_to_tiles(*columns: str) -> DataFrame:
        sides = blocks.select("label", "width", "block", "ids", "copies", *columns).join(sizes, ["label", "width"])
        sides = sides.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        return sides.select("label", "width", F.least("block", "other").alias("tile_a"), F.greatest("block", "other").alias("tile_b"), "block", "ids", "copies", *columns)

    def sides_of(table: pa.Table) -> list[dict]:
        return sorted((r for r in table.to_pylist() if r["ids"] is not None), key=lambda r: r["block"])

    def compare(key, table):
        parts = []
        for r in sides_of(table):
            bounds = np.frombuffer(r["bounds"], np.float64).reshape(3, -1)
            parts.append((np.frombuffer(r["ids"], np.int64), np.frombuffer(r["copies"], np.int64), (np.frombuffer(r["small"], np.int8).reshape(-1, key[1].as_py()), *bounds)))
        one = len(parts) == 1
        (ids_a, n_a, a), (ids_b, n_b, b) = parts[0], parts[-1]
        sure, may = tile_pairs(a, b, threshold)
        if one:
            sure, may = np.triu(sure, 1), np.triu(may, 1)
        return _result(key, ids_a, ids_b, n_a, n_b, *np.nonzero(sure), one, *np.nonzero(may))

    def decide(key, table):
        pairs = next(r for r in table.to_pylist() if r["i"] is not None)
        parts = [(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["copies"], np.int64), np.frombuffer(r["vectors"], np.float64).reshape(-1, key[1].as_py())) for r in sides_of(table)]
        (ids_a, n_a, a), (ids_b, n_b, b) = parts[0], parts[-1]
        i, j = np.frombuffer(pairs["i"], np.int32), np.frombuffer(pairs["j"], np.int32)
        keep = exact_pairs(a, b, i, j, threshold)
        none = np.zeros(0, np.int32)
        return _result(key, ids_a, ids_b, n_a, n_b, i[keep], j[keep], len(parts) == 1, none, none)

    found = materialize(dealt_to_tiles("small", "bounds").groupBy(*tile).applyInArrow(compare, FOUND), "tiles")
    opened = found.where("i is not null").select(*tile, "i", "j")
    whole = dealt_to_tiles("vectors").join(opened.select(*tile), tile, "left_semi").unionByName(opened, allowMissingColumns=True)
    found = found.unionByName(materialize(whole.groupBy(*tile).applyInArrow(decide, FOUND), "tiles"))
    discard(blocks)
    component = connected_components(found.where("a is not null").select("a", "b"))
    counts = found.where("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    of_class = classes.select(*keys, "id", "copies").join(counts, "id", "left").join(component, "id", "left")
    of_class = of_class.select(*keys, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"), F.lit(True).alias("ok"))
    out = rows.drop("vector").join(of_class, [*keys, "ok"], "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))

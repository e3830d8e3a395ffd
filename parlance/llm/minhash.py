"""MinHash near-duplicates by a chosen-path set similarity join.

1. One Arrow pass gives each document's set of distinct word shingles (64-bit hashes), its size, a 128-bit key of the set
   and its tokens: one byte of the minwise value of each of COORDINATES random functions. Two sets agree in a token with
   a probability equal to their similarity (and 1/256 of the rest by chance).
2. Equal sets are one class; from here on a class is its smallest doc_id. (Groups of exact copies cost one row each.)
3. Each of a number of independent trees branches the classes: a node's name chooses coordinates, 1 / similarity of them on
   average, one at least, and a class goes to the child named by its token at each. So a pair at the similarity has one
   common child on average, and dissimilar ones fewer with every level. A node that has one class ends; one of at most LIMIT
   is compared exhaustively by tokens; a larger one branches on, from the depth DEPTHS[0] to DEPTHS[1], unless half of its
   classes are alike to its smallest one: branching would not part these. Trees are as many as a pair at the similarity
   needs to share a node of the last depth with probability RECALL (`trees_for` computes it with the chance that a pair's
   tokens agree less than its sets); a pair whose nodes end earlier meets more often.
4. A node gives no pairs but a forest of its alike ones: for each class the most alike class with a smaller id, and what is
   needed to connect all that are alike. A node of more than LIMIT classes that ends counts as connected, by an edge from its
   smallest class to each; for alike ones each class is compared in a seeded part of one such node, that with the smallest
   first class.
5. Edges are confirmed on full sets, made again from the texts, in rounds: the most alike edge of every class, then of every
   component of confirmed links, as long as most of them are links. So the many copies of one text become one component,
   and no round holds more pairs than classes. Which texts are read is told by a bitmap of ids (bounded; a false hit costs a
   set too many), so texts cross no exchange.
6. Classes that edges connect are a family; all pairs that may be links are within one. In each family of several components
   all pairs of classes of different components are compared by tokens, once, and alike ones on their full sets, where they
   meet: a task returns only links that join components. Families of more than TILE classes or TILE_BYTES are compared by
   tiles of two blocks; a component of n classes and r others in a family cost n * r comparisons.

The token threshold lies five standard deviations below the similarity. Nothing but counts and the bitmap reaches the driver.

Defined results: null texts and texts without words have an empty set, size 0, and are linked with nothing; a text with
fewer words than a shingle has its whole word sequence as one shingle; a null doc_id gets a null component and is kept;
repeated rows are one class; of different texts under one doc_id one (with the smallest key) is compared, and the others
share its component; an empty table gives an empty result; other columns are never read. Ties go to smaller ids, so reruns
and retried tasks agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import counted, discard, gram_hashes, materialize, mix, partitions, pieces, span_hashes, text_bytes, word_spans
from parlance.llm.components import connected_components

COORDINATES, DEPTHS, LIMIT, RECALL = 128, (4, 8), 64, 0.9999
TILE, TILE_BYTES = 512, 16_000_000  # classes and bytes of a block: a family of more is compared block by block
MAX_BITS = (1 << 26) - 5  # a prime: the bitmap of documents in candidates has at most 8 MB
SETS = "doc_id long, n_shingles long, key1 long, key2 long, sketch binary"
FOUND = "a long, b long, alike int"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(array: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text."""
    data, offsets = text_bytes(array)
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            short = gram_hashes(words[a:b], b - a)
            out.append(mix(short, b - a))  # never equal to a full shingle's
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _functions(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(members: np.ndarray, functions: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(members), 2048):
            out = np.minimum(out, ((members[k : k + 2048, None] * functions) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def set_key(members: np.ndarray) -> tuple[np.int64, np.int64]:
    with np.errstate(over="ignore"):
        mixed = mix(members, 11)
        keys = np.array([np.sum(mixed), np.bitwise_xor.reduce(mix(mixed, 12)) if len(members) else 0], np.uint64).view(np.int64)
    return keys[0], keys[1]


def describe(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """SETS of all documents; `sketch` has a set's tokens."""
    functions = _functions(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1_500_000):
            sets = shingle_sets(batch.column("text"), n)
            tokens = [(minwise(s, functions) & 0xFF).astype(np.uint8).tobytes() for s in sets]
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array(tokens, pa.binary())], [x.split()[0] for x in SETS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def meets(agreement: np.ndarray, depth: int, similarity: float) -> np.ndarray:
    """Probability that two sets whose tokens agree in such a share have a common node at `depth` of a tree."""
    whole = int(1 / similarity + 1e-9)
    more, out = 1 / similarity - whole, np.ones_like(agreement)
    for _ in range(depth):
        out = 1 - (1 - agreement * out) ** whole * (1 - more * agreement * out)
    return out


def trees_for(recall: float, depth: int, similarity: float) -> int:
    """Trees in which a pair at the similarity meets once at least with probability `recall`, over the chances of its tokens."""
    k = np.arange(COORDINATES + 1)
    ways = np.array([math.lgamma(COORDINATES + 1) - math.lgamma(i + 1) - math.lgamma(COORDINATES - i + 1) for i in k])
    if similarity < 1:
        chance = np.exp(ways + k * math.log(similarity) + (COORDINATES - k) * math.log(1 - similarity))
    else:
        chance = (k == COORDINATES).astype(float)
    apart = 1 - meets(k / COORDINATES, depth, similarity)
    return next(r for r in range(1, 10_000) if (chance * apart**r).sum() <= 1 - recall)


def branch(names: np.ndarray, owners: np.ndarray, tokens: np.ndarray, levels: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Names and owners of the nodes `levels` below those named. tokens: (owners, COORDINATES)."""
    whole = int(1 / similarity + 1e-9)
    more = 1 / similarity - whole
    with np.errstate(over="ignore"):
        for _ in range(levels):
            first, step = mix(names, 1), mix(names, 2) | np.uint64(1)
            extra = (mix(names, 3) >> np.uint64(11)).astype(np.float64) < more * (1 << 53)
            at, made = [], []
            for j in range(whole + 1):
                own = np.arange(len(names)) if j < whole else np.flatnonzero(extra)
                chosen = (first[own] + np.uint64(j) * step[own]) % np.uint64(COORDINATES)  # an odd step: all differ
                token = tokens[owners[own], chosen.astype(np.int64)].astype(np.uint64)
                made.append(mix(names[own] * np.uint64(0x9E3779B97F4A7C15) + (chosen << np.uint64(8)) + token, 4))
                at.append(owners[own])
            names, owners = np.concatenate(made), np.concatenate(at)
    return names, owners


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def nodes_below(rows: DataFrame, levels: int, similarity: float, seed: int, trees: int = 0) -> DataFrame:
    """(node, id) of the nodes `levels` below the rows' (node, id, sketch); with `trees` below as many roots of (id, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                part = batch.slice(k, 2_000)
                tokens, owners = _tokens(part.column("sketch")), np.arange(part.num_rows)
                if trees:
                    names = np.tile(mix(np.arange(trees, dtype=np.uint64), seed + 7), part.num_rows)
                    owners = np.repeat(owners, trees)
                else:
                    names = part.column("node").to_numpy().astype(np.int64).view(np.uint64)
                names, owners = branch(names, owners, tokens, levels, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(part.column("id").to_numpy()[owners])], ["node", "id"])

    return rows.mapInArrow(run, "node long, id long")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole nodes, of rows sorted by node."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        node = held.column("node").to_numpy()
        other = np.flatnonzero(node != node[-1])  # the last node may go on in the next batch
        if len(other):
            yield held.slice(0, int(other[-1]) + 1)
            held = held.slice(int(other[-1]) + 1)
    if held is not None:
        yield held


def alike_pairs(node: np.ndarray, size: np.ndarray, sketch: np.ndarray, percent: int, component: np.ndarray | None = None, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of alike pairs within nodes, the earlier row first, and how many tokens agree. With components only pairs of
    different ones; rows of sides 0 and 1 are compared with the other side only, rows of side 2 with all."""
    least, found = math.ceil(sketch_threshold(percent) * COORDINATES), []
    for d in range(1, len(node)):
        at = np.flatnonzero(node[d:] == node[:-d])
        if not len(at):
            break
        x, y = size[at], size[at + d]
        meet = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
        if component is not None:
            meet &= (component[at] != component[at + d]) & ((side[at] != side[at + d]) | (side[at] == 2))
        at = at[meet]
        for k in range(0, len(at), 20_000):
            own = at[k : k + 20_000]
            same = (sketch[own] == sketch[own + d]).sum(axis=1)
            found.append((own[same >= least], own[same >= least] + d, same[same >= least]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def reached(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the first row that pairs connect it with."""
    low = np.arange(n)
    while True:
        was = low.copy()
        np.minimum.at(low, left, low[right])
        np.minimum.at(low, right, low[left])
        low = low[low]
        if (low == was).all():
            return low


def node_forests(rows: DataFrame, percent: int, n_parts: int) -> DataFrame:
    """FOUND of rows (node, id, size, sketch): in each node the most alike class of a smaller id for every class, and edges
    with alike 0 where these leave apart what alike pairs connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            ids = table.column("id").to_numpy()
            left, right, alike = alike_pairs(table.column("node").to_numpy(), table.column("size").to_numpy(), _tokens(table.column("sketch")), percent)
            order = np.lexsort((left, -alike, right))  # rows stand in the order of node and id
            left, right, alike = left[order], right[order], alike[order]
            best = np.ones(len(order), bool)
            best[1:] = right[1:] != right[:-1]
            by_best, by_all = (reached(left[w], right[w], len(ids)) for w in (best, slice(None)))
            apart = np.flatnonzero((by_best == np.arange(len(ids))) & (by_all != by_best))
            a, b = np.concatenate([left[best], by_all[apart]]), np.concatenate([right[best], apart])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(np.concatenate([alike[best], np.zeros(len(apart), np.int64)]).astype(np.int32))], ["a", "b", "alike"])

    return rows.select("node", "id", "size", "sketch").repartition(n_parts, "node").sortWithinPartitions("node", "id").mapInArrow(run, FOUND)


def links_between(rows: DataFrame, percent: int, n_parts: int) -> DataFrame:
    """(a, b) of rows (node, id, component, side, size, sketch, members): in each node links of different components that join
    all components that links join there. Pairs go from the most alike on; one is intersected only while its components are
    still apart."""

    def joined(table: pa.Table) -> list[tuple[int, int]]:
        ids, component, size = (table.column(c).to_numpy() for c in ("id", "component", "size"))
        left, right, alike = alike_pairs(np.zeros(len(ids), np.int64), size, _tokens(table.column("sketch")), percent, component, table.column("side").to_numpy())
        column = table.column("members").combine_chunks()
        flat, bounds = column.values.to_numpy(), column.offsets.to_numpy()
        sets = [np.sort(flat[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        names, own = np.unique(component, return_inverse=True)
        up = list(range(len(names)))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        out = []
        for k in np.lexsort((right, left, -alike)).tolist():
            i, j = int(left[k]), int(right[k])
            if (x := root(own[i])) != (y := root(own[j])):
                place = np.minimum(sets[i].searchsorted(sets[j]), len(sets[i]) - 1)
                both = int((sets[i][place] == sets[j]).sum())
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    up[max(x, y)] = min(x, y)
                    out.append((int(ids[i]), int(ids[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            node = table.column("node").to_numpy()
            head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            found = [p for i, j in zip(head, [*head[1:], len(node)], strict=True) for p in joined(table.slice(int(i), int(j - i)))]
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    columns = ["node", "id", "component", "side", "size", "sketch", "members"]
    return rows.select(*columns).repartition(n_parts, "node").sortWithinPartitions("node", "id").mapInArrow(run, "a long, b long")


def sketch_threshold(percent: int) -> float:
    similarity = percent / 100
    return similarity - 5 * (similarity * (1 - similarity) / COORDINATES) ** 0.5


def shared_nodes(live: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Rows (node, id, n, low) of nodes of several classes, low the smallest, and how many stand in nodes of more than LIMIT."""
    sizes = live.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).where("n > 1")
    rows, (large,) = counted(live.join(sizes, "node").select("node", "id", "n", "low"), label, F.count_if(F.col("n") > LIMIT))
    return rows, large


def alike_to_first(rows: DataFrame, percent: int) -> DataFrame:
    """(node, id, n, low, near) of rows with sketch and low_sketch: whether a class is alike to its node's first one."""
    least = math.ceil(sketch_threshold(percent) * COORDINATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_tokens(batch.column("sketch")) == _tokens(batch.column("low_sketch"))).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "id", "n", "low")), pa.array(near)], ["node", "id", "n", "low", "near"])

    return rows.select("node", "id", "n", "low", "sketch", "low_sketch").mapInArrow(run, "node long, id long, n long, low long, near boolean")


def edges_of(classes: DataFrame, percent: int, seed: int) -> tuple[DataFrame, int]:
    """Edges (a, b, alike) of classes (id, size, sketch) from the nodes of all trees, each once, and how many they are."""
    similarity = percent / 100
    trees = trees_for(RECALL, DEPTHS[-1], similarity)
    bare = classes.select("id", "sketch")
    rows, large = shared_nodes(nodes_below(bare, DEPTHS[0], similarity, seed, trees), "nodes")
    met, wide = rows.where(F.col("n") <= LIMIT).select("node", "id"), None
    if large:
        firsts = bare.select(F.col("id").alias("low"), F.col("sketch").alias("low_sketch"))
        more = materialize(alike_to_first(rows.where(F.col("n") > LIMIT).join(bare, "id").join(firsts, "low"), percent), "large")
        dense = more.groupBy("node").agg((2 * F.count_if("near") >= F.count(F.lit(1))).alias("dense")).where("dense").select("node")
        parted = more.join(dense, "node", "left_anti").select("node", "id").join(bare, "id").select("node", "id", "sketch")
        deep, _ = shared_nodes(nodes_below(parted, DEPTHS[1] - DEPTHS[0], similarity, seed), "nodes")
        met = met.unionByName(deep.where(F.col("n") <= LIMIT).select("node", "id"))
        wide = materialize(more.join(dense, "node", "left_semi").drop("near").unionByName(deep.where(F.col("n") > LIMIT)), "wide")
        home = wide.groupBy("id").agg(F.min(F.struct("low", "node", "n")).alias("m")).select("id", "m.*")
        part = F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(2 * F.col("n") / LIMIT))
        met = met.unionByName(home.select(F.xxhash64("node", part).alias("node"), "id"))
    found = node_forests(met.join(classes, "id"), percent, max(partitions(classes), partitions(rows, 4)))
    if wide is not None:
        found = found.unionByName(wide.where("low <> id").select(F.col("low").alias("a"), F.col("id").alias("b"), F.lit(1).alias("alike")))
    edges, (n,) = counted(found.groupBy("a", "b").agg(F.max("alike").alias("alike")), "edges", F.count(F.lit(1)))
    for done in (rows, *((more, deep, wide) if large else ())):
        discard(done)
    return edges, n


def tiles(wide: DataFrame, seed: int) -> DataFrame:
    """Rows (node, id, component, size) of large nodes dealt to tiles of two blocks: (node, id, component, side), node the tile.

    A component of more than a block has blocks of its own, the node's other classes share blocks. Two blocks of one
    component have nothing to compare, so a large component costs as many tiles as it has blocks for each block of others.
    """
    weight = F.lit(1 / TILE) + 8 * F.col("size") / F.lit(TILE_BYTES)  # share of a block
    counts = materialize(wide.groupBy("node", "component").agg(F.sum(weight).alias("own")), "counts")
    large = counts.where("own > 1")
    others = counts.where("own <= 1").groupBy("node").agg(F.sum("own").alias("others"))
    rows = wide.join(large, ["node", "component"], "left").join(others, "node", "left")
    owner = F.when(F.col("own").isNotNull(), F.col("component"))
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.coalesce("own", "others")))
    rows = rows.select("node", "id", "component", owner.alias("owner"), F.xxhash64(owner.isNotNull(), owner, part).alias("block"))
    rows = materialize(rows, "blocks")
    blocks = materialize(rows.select("node", "owner", "block").distinct(), "blocks")
    a, b = blocks.alias("a"), blocks.alias("b")
    meet = "a.node = b.node and a.block <= b.block and (a.owner is null or b.owner is null or a.owner <> b.owner)"
    pairs = a.join(b, F.expr(meet)).select("a.node", F.col("a.block").alias("x"), F.col("b.block").alias("y")).withColumn("tile", F.xxhash64("node", "x", "y"))
    one, two = F.col("x") == F.col("y"), F.col("x") != F.col("y")
    sides = pairs.select("node", F.col("x").alias("block"), "tile", F.when(one, 2).otherwise(0).alias("side"))
    sides = sides.union(pairs.where(two).select("node", F.col("y").alias("block"), "tile", F.lit(1).alias("side")))
    return rows.join(sides, ["node", "block"]).select(F.col("tile").alias("node"), "id", "component", "side")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with `linked`: 100 * intersection >= percent * union of the full sets of a and b."""
    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return rows.select(*pairs.columns, (100 * both >= percent * (F.size("x") + F.size("y") - both)).alias("linked"))


def id_bitmap(ids: DataFrame) -> tuple[np.ndarray, int]:
    """Bits at id mod a prime, for the distinct ids, lowest bit first, and the prime: as many bits as are useful, MAX_BITS at
    most. 4 KB come back for each 32,768 bits, already merged."""
    wanted = 16 * max(1, ids.count())
    size = next((p for p in (65_521, 1_048_573, 16_777_213) if p >= wanted), MAX_BITS)
    place = F.pmod(F.col("id"), F.lit(size))
    rows = ids.groupBy((F.floor(place / 32_768)).alias("part")).agg(F.bitmap_construct_agg(place % 32_768).alias("bits")).collect()
    out = np.zeros(((size >> 15) + 1, 4_096), np.uint8)
    for r in rows:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel(), size


def members(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, key1, key2, members): the full sets, as distinct hashes, of the documents in `ids`, and of few others."""
    bits, size = id_bitmap(ids)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            place = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64) % size
            batch = batch.filter(pa.array((packed[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            for part in pieces([batch], "text", 1_500_000):
                sets = shingle_sets(part.column("text"), n)
                keys = [set_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "key1", "key2", "members"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, key1 long, key2 long, members array<long>")


def outer(edges: DataFrame, component: DataFrame | None) -> DataFrame:
    """The edges between components, with these (low, high)."""
    if component is None:
        return edges.select("a", "b", "alike", F.col("a").alias("low"), F.col("b").alias("high"))
    of = lambda side: component.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}"))
    rows = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    x, y = F.coalesce("of_a", "a"), F.coalesce("of_b", "b")
    return rows.where(x != y).select("a", "b", "alike", F.least(x, y).alias("low"), F.greatest(x, y).alias("high"))


def joined_by(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) after links (low, high) of components."""
    new = connected_components(links.select(F.col("low").alias("a"), F.col("high").alias("b")))
    if component is None:
        return new
    over = new.select(F.col("id").alias("component"), F.col("component").alias("over"))
    old = component.join(over, "component", "left").select("id", F.coalesce("over", "component").alias("component"))
    return materialize(old.unionByName(new.join(component, "id", "left_anti")), "component")


def first_links(edges: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame | None, DataFrame]:
    """(id, component) of the links among the edges that are the most alike of a class, then of a component with smaller ones,
    round by round as long as most of a round's edges are links (None: no links), and the edges between its components."""
    component, refused, rest = None, None, outer(edges, None)
    while True:
        rows = rest.where("alike > 0")
        if refused is not None:
            rows = rows.join(refused, ["a", "b"], "left_anti")
        best = F.max(F.struct("alike", *(F.bitwise_not(c).alias(c) for c in ("a", "b", "low")))).alias("m")
        picked = rows.groupBy("high").agg(best).select(*(F.bitwise_not(f"m.{c}").alias(c) for c in ("a", "b", "low")), "high")
        judged, (n, linked) = counted(confirm(picked, sets, percent), "links", F.count(F.lit(1)), F.count_if("linked"))
        if linked:
            component = joined_by(component, judged.where("linked"))
            rest = materialize(outer(rest.select("a", "b", "alike"), component), "edges")
        if not linked or 2 * linked < n:
            return component, rest
        no = judged.where("not linked").select("a", "b")
        refused = no if refused is None else refused.unionByName(no)


def families(rest: DataFrame, classes: DataFrame, component: DataFrame | None) -> DataFrame:
    """(node, id, component, size): the classes of all families of several components, which the edges between them connect."""
    family = connected_components(rest.select(F.col("low").alias("a"), F.col("high").alias("b")).distinct()).select(F.col("id").alias("component"), F.col("component").alias("node"))
    rows = classes.select("id", "size")
    rows = rows.withColumn("component", F.col("id")) if component is None else rows.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return rows.join(family, "component").select("node", "id", "component", "size")


def last_links(rest: DataFrame, classes: DataFrame, sets: DataFrame, component: DataFrame | None, percent: int, seed: int) -> DataFrame | None:
    """(id, component) after all links between components of one family."""
    rows = materialize(families(rest, classes, component), "families")
    weight = F.greatest(F.count(F.lit(1)) / F.lit(TILE), 8 * F.sum("size") / F.lit(TILE_BYTES))
    sizes, (wide,) = counted(rows.groupBy("node").agg((weight > 1).alias("wide")), "families", F.count_if("wide"))
    fit = rows.join(sizes.where("not wide"), "node", "left_semi").select("node", "id", "component", F.lit(2).alias("side"))
    if wide:
        fit = fit.unionByName(tiles(rows.join(sizes.where("wide"), "node", "left_semi"), seed))
    whole = fit.join(classes.select("id", "size", "sketch"), "id").join(sets, "id")
    links, (n,) = counted(links_between(whole, percent, partitions(sets, 4)), "links", F.count(F.lit(1)))
    if not n:
        return component
    return joined_by(component, outer(links.withColumn("alike", F.lit(0)), component))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, seed: int = 0) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    described = materialize(describe(docs, shingle, seed), "sets")
    keys = ["key1", "key2", "n_shingles"]
    first = materialize(described.where("n_shingles > 0 and doc_id is not null").groupBy(*keys).agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch")), "classes")
    classes = first.groupBy("id").agg(F.min(F.struct("key1", "key2", F.col("n_shingles").alias("size"), "sketch")).alias("c")).select("id", "c.*")
    classes = materialize(classes, "classes")
    edges, n = edges_of(classes.select("id", "size", "sketch"), percent, seed)
    component = None
    if n:
        ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        key = classes.select("id", F.col("key1").alias("of1"), F.col("key2").alias("of2"))
        sets = members(docs, ids, shingle).join(key, "id").where("((key1 ^ of1) | (key2 ^ of2)) = 0").select("id", "members")
        sets = materialize(sets.dropDuplicates(["id"]), "members")
        component, rest = first_links(edges, sets, percent)
        component = last_links(rest, classes, sets, component, percent, seed)
        if component is not None:
            component = materialize(component, "component")
        discard(sets)
    discard(edges)
    discard(classes)
    label = first.select(*keys, "id")
    if component is None:
        label = label.withColumnRenamed("id", "component")
    else:
        label = label.join(component, "id", "left").select(*keys, F.coalesce("component", "id").alias("component"))
    out = described.select("doc_id", *keys).join(label, keys, "left").withColumn("component_id", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

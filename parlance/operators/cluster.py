"""Voices from embeddings: distances, centroids, average-linkage clustering, and the labels of a meeting's chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import constants as C
from parlance.operators.segmentation import fill_labels, first_appearance, merge_turns

M = "meeting_id"
MAX_CHUNKS = 4_000  # a distance matrix of 128 MB: larger groups are clustered by parts that no merge can join


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-12)))


def pairwise_distances(rows: DataFrame, keys: list[str], item: str, vector: str = "embedding") -> DataFrame:
    """(keys, a, b, distance) of the pairs a < b within the keys: an equi-join on the keys, for groups of bounded size."""
    left = rows.select(*keys, F.col(item).alias("a"), F.col(vector).alias("va"))
    right = rows.select(*keys, F.col(item).alias("b"), F.col(vector).alias("vb"))
    return left.join(right, keys).where("a < b").select(*keys, "a", "b", cosine_distance(F.col("va"), F.col("vb")).alias("distance"))


def nearest_other(rows: DataFrame, keys: list[str], item: str, vector: str = "embedding", block: int = 1_024) -> DataFrame:
    """(keys, item, nearest, n): distance to the nearest other row of the keys, and how many others there are.

    No rows of pairs: a group is cut into blocks of about `block` rows, a task compares two blocks and gives each row's
    minimum only. A group of n rows sends n * n / block vectors. Rows alone in their group, and null keys, give nothing.
    """
    kinds = dict(rows.dtypes)
    counts = rows.where(F.col(vector).isNotNull()).groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).alias("no__blocks"))
    dealt = rows.where(F.col(vector).isNotNull()).select(*keys, item, vector).join(counts, keys)
    dealt = dealt.withColumn("no__own", F.pmod(F.xxhash64(item), F.col("no__blocks"))).withColumn("no__other", F.explode(F.expr("sequence(0, no__blocks - 1)")))
    dealt = dealt.withColumn("no__i", F.least("no__own", "no__other")).withColumn("no__j", F.greatest("no__own", "no__other")).drop("no__blocks", "no__other")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        x /= np.clip(np.linalg.norm(x, axis=1, keepdims=True), 1e-12, None)
        own = pdf["no__own"].to_numpy()
        first, second = np.flatnonzero(own == pdf["no__i"].iloc[0]), np.flatnonzero(own == pdf["no__j"].iloc[0])
        d = 1.0 - x[first] @ x[second].T
        if same := pdf["no__i"].iloc[0] == pdf["no__j"].iloc[0]:
            np.fill_diagonal(d, np.inf)
        sides = [(first, 1, len(second) - same)] + ([] if same else [(second, 0, len(first))])
        out = [pdf[[*keys, item]].iloc[at].assign(nearest=d.min(axis=axis), n=n) for at, axis, n in sides if n > 0 and len(at)]
        return pd.concat(out) if out else pdf[[*keys, item]].iloc[:0].assign(nearest=0.0, n=0)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, item]) + ", nearest double, n long"
    found = dealt.groupBy(*keys, "no__i", "no__j").applyInPandas(tile, schema)
    return found.groupBy(*keys, item).agg(F.min("nearest").alias("nearest"), F.sum("n").alias("n"))


def centroids(rows: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """(keys, n, centroid): means of unit vectors, unit again. One row for each key and place is shuffled, not the vectors."""
    parts = rows.select(*keys, F.posexplode(unit(F.col(vector))).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return parts.groupBy(*keys).agg(F.max("n").alias("n"), mean.alias("mean")).select(*keys, "n", unit(F.col("mean")).alias("centroid"))


def nearest_centroid(rows: DataFrame, cents: DataFrame, keys: list[str], item: str, label: str, vector: str = "embedding") -> DataFrame:
    """(keys, item, label, distance): the closest centroid, the smallest label on ties. Without keys all centroids compete:
    they are one row of an array then, so their number must be small, as labels are."""
    if keys:
        pairs = rows.select(*keys, item, vector).join(cents.select(*keys, label, "centroid"), keys)
        pairs = pairs.withColumn("distance", cosine_distance(F.col(vector), F.col("centroid")))
        best = pairs.groupBy(*keys, item).agg(F.min(F.struct("distance", label)).alias("b"))
        return best.select(*keys, item, f"b.{label}", "b.distance")
    every = cents.agg(F.array_sort(F.collect_list(F.struct(label, "centroid"))).alias("cents"))
    scored = F.transform("cents", lambda c: F.struct(cosine_distance(F.col(vector), c["centroid"]).alias("distance"), c[label].alias(label)))
    return rows.crossJoin(F.broadcast(every)).select(item, F.array_min(scored).alias("b")).select(item, f"b.{label}", "b.distance")  # one row


def average_linkage(vectors: np.ndarray, threshold: float | None = C.CLUSTER_DISTANCE, n_clusters: int | None = None, heights: list[float] | None = None) -> np.ndarray:
    """Labels (by each cluster's first member) of agglomerative clustering on cosine distance; `heights` gets each merge's.

    The mean distance between clusters follows from the two merged ones' means. Each row remembers its nearest partner, so a
    merge costs O(n) and the whole O(n^2) in the usual case.
    """
    n = len(vectors)
    if n <= 1:
        return np.zeros(n, dtype=int)
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.clip(np.linalg.norm(x, axis=1, keepdims=True), 1e-12, None)
    d = 1.0 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, owner, live = np.ones(n), np.arange(n), np.ones(n, bool)
    near = np.argmin(d, axis=1)
    best = d[np.arange(n), near]
    left = n
    while left > max(1, n_clusters or 1):
        a = int(np.argmin(best))
        b = int(near[a])
        if n_clusters is None and threshold is not None and best[a] > threshold:
            break
        if heights is not None:
            heights.append(float(best[a]))
        a, b = min(a, b), max(a, b)
        row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        row[a] = np.inf
        d[b, :] = d[:, b] = np.inf
        row[~live] = row[b] = np.inf
        d[a, :] = d[:, a] = row
        size[a] += size[b]
        live[b] = False
        owner[owner == b] = a
        best[b] = np.inf
        left -= 1
        for k in np.flatnonzero(live & ((near == a) | (near == b) | (row < best) | (np.arange(n) == a))):
            near[k] = int(np.argmin(d[k]))
            best[k] = d[k, near[k]]
    _, first, labels = np.unique(owner, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[labels]


def apart(vectors: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Places of rows, in parts between which every distance is above the threshold: clusters whose mean distance is at most
    the threshold hold a pair that is, so no merge joins two parts. Memory grows with the rows, not with their square."""
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.clip(np.linalg.norm(x, axis=1, keepdims=True), 1e-12, None)
    left, parts = np.arange(len(x)), []
    while len(left):
        part, front, left = [left[:1]], left[:1], left[1:]
        while len(front) and len(left):
            others, near, step = x[left].T, np.zeros(len(left), bool), max(1, 4_000_000 // len(left))
            for k in range(0, len(front), step):
                near |= (1.0 - x[front[k : k + step]] @ others).min(axis=0) <= threshold + 1e-9
            front, left = left[near], left[~near]
            part.append(front)
        parts.append(np.sort(np.concatenate(part)))
    return parts


def linked(vectors: np.ndarray, threshold: float | None, n_clusters: int | None = None, limit: int = MAX_CHUNKS) -> np.ndarray:
    """`average_linkage` of any number of rows, as floats: beyond `limit` part by part. Rows of a part that is itself beyond
    it have no label (NaN), and all rows where the number of clusters is given, which parts cannot tell."""
    if len(vectors) <= limit:
        return average_linkage(vectors, threshold, n_clusters).astype(float)
    out, n = np.full(len(vectors), np.nan), 0
    for part in apart(vectors, threshold) if threshold is not None and n_clusters is None else []:
        if len(part) <= limit:
            labels = average_linkage(vectors[part], threshold)
            out[part] = labels + n
            n += int(labels.max()) + 1
    known = ~np.isnan(out)
    _, first, labels = np.unique(out[known], return_index=True, return_inverse=True)
    out[known] = np.argsort(np.argsort(first))[labels]
    return out


def cluster(rows: DataFrame, keys: list[str], item: str, vector: str = "embedding", threshold: float | None = C.CLUSTER_DISTANCE, n_clusters: int | None = None) -> DataFrame:
    """(keys, item, cluster) by average linkage within the keys. A group is one task's; its distance matrix is bounded by
    MAX_CHUNKS rows, larger groups are clustered by parts, and rows of a part beyond that have a null cluster."""
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        labels = linked(np.stack(pdf[vector].to_numpy()), threshold, n_clusters)
        return pdf[[*keys, item]].assign(cluster=pd.array(labels, dtype="Float64").astype("Int32"))

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, item]) + ", cluster int"
    return rows.select(*keys, item, vector).groupBy(*keys).applyInPandas(run, schema)


def label_chunks(chunks: DataFrame, threshold: float | None = C.CLUSTER_DISTANCE, num_speakers: int | None = None) -> DataFrame:
    """chunks (meeting_id, chunk_idx, start, end, kind, embedding, ...) with `speaker` and `less_reliable`.

    Long chunks are clustered, short ones join the nearest centroid, tiny ones their neighbour; where no chunk is long the
    short ones vote. A meeting with chunks that could not be clustered (see `cluster`) takes neighbours' voices for them and
    is less reliable.
    """
    some = chunks.groupBy(M).agg(F.bool_or(F.col("kind") == "long").alias("lc__long"))
    rows = chunks.join(some, M).withColumn("lc__votes", (F.col("kind") == "long") | (~F.col("lc__long") & (F.col("kind") == "short")))
    votes = rows.where("lc__votes")
    clusters = cluster(votes, [M], "chunk_idx", threshold=threshold, n_clusters=num_speakers)
    cents = centroids(votes.join(clusters.where("cluster is not null"), [M, "chunk_idx"]), [M, "cluster"])
    near = nearest_centroid(rows.where("not lc__votes and kind = 'short'"), cents, [M], "chunk_idx", "cluster")
    labels = clusters.unionByName(near.select(M, "chunk_idx", "cluster"))
    rows = rows.join(labels, [M, "chunk_idx"], "left")
    open_ = F.bool_or(F.col("lc__votes") & F.col("cluster").isNull()).over(Window.partitionBy(M))
    rows = rows.withColumn("lc__long", F.col("lc__long") & ~open_)
    rows = fill_labels(rows, [M], "cluster", ["chunk_idx"], 0)
    rows = first_appearance(rows, [M], "cluster", "chunk_idx")
    return rows.withColumn("less_reliable", ~F.col("lc__long")).drop("lc__long", "lc__votes")


def label_words(words: DataFrame, labelled: DataFrame) -> DataFrame:
    """Words with their chunk's speaker."""
    refs = labelled.select(M, "speaker", F.explode("word_refs").alias("r")).select(M, F.col("r.segment_id"), F.col("r.word_idx"), F.col("speaker").alias("lw__speaker"))
    return words.join(refs, [M, "segment_id", "word_idx"], "left").withColumn("speaker", F.coalesce("lw__speaker", "speaker")).drop("lw__speaker")


def speaker_turns(labelled: DataFrame) -> DataFrame:
    return merge_turns(labelled, [M], "speaker", ["chunk_idx"])


def threshold_sweep(rows: DataFrame, keys: list[str], item: str, thresholds: list[float]) -> DataFrame:
    """(keys, threshold, n_clusters) from one linkage of each group: heights of average linkage never fall, so the clusters at
    a threshold are those that merges up to it leave. Groups of more than MAX_CHUNKS are linked by parts at the largest
    threshold; where a part is beyond it too, their number of clusters is null."""
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values(item)["embedding"].to_numpy())
        parts = [np.arange(len(x))] if len(x) <= MAX_CHUNKS else apart(x, max(thresholds))
        found: list[float] = []
        known = all(len(part) <= MAX_CHUNKS for part in parts)
        for part in parts if known else []:
            average_linkage(x[part], None, None, found)
        n = [len(pdf) - int(sum(h <= t for h in found)) if known else None for t in thresholds]
        out = pd.DataFrame({"threshold": thresholds, "n_clusters": pd.array(n, dtype="Int64")})
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "threshold", "n_clusters"]]

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", threshold double, n_clusters long"
    return rows.select(*keys, item, "embedding").groupBy(*keys).applyInPandas(run, schema)


def plateau_centre(scores: DataFrame, tolerance: float = 0.005, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, threshold, der): the middle one of the thresholds within `tolerance` of the best; an aggregate to one short list."""
    item = F.struct("threshold", "der")
    rows = scores.groupBy(*keys).agg(F.min("der").alias("best"), F.array_sort(F.collect_list(item)).alias("all"))
    near = rows.withColumn("all", F.filter("all", lambda x: x["der"] <= F.col("best") + tolerance)).where(F.size("all") > 0)
    return near.select(*keys, F.element_at("all", F.floor(F.size("all") / 2).cast("int") + 1).alias("x")).select(*keys, "x.threshold", "x.der")


def longest(chunks: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k longest chunks of each group, ties to the earlier one, with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.col("end") - F.col("start")), "chunk_idx")
    return chunks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def separability(rows: DataFrame, keys: list[str], label: str, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(spread, apart): mean and 90th percentile of the distance to the own centroid, and distances between centroids."""
    cents = centroids(rows, [*keys, label], vector)
    own = rows.join(cents, [*keys, label]).withColumn("d", cosine_distance(F.col(vector), F.col("centroid")))
    spread = own.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_distance"), F.percentile("d", 0.9).alias("p90_distance"))
    a = cents.select(*keys, F.col(label).alias("a"), F.col("centroid").alias("ca"))
    b = cents.select(*keys, F.col(label).alias("b"), F.col("centroid").alias("cb"))
    pairs = a.join(b, keys) if keys else a.crossJoin(b)  # as many rows as labels
    return spread, pairs.where("a < b").select(*keys, "a", "b", cosine_distance(F.col("ca"), F.col("cb")).alias("distance"))

"""Mixing sources to target weights, in DataFrame operations only.

Capped water-filling: every source asks for its share of all words by weight. Sources whose share exceeds `epochs` times
their own words are clamped there, and what they cannot take is reshared among the others by weight, until no share is
above its clamp. Each round is one aggregate over the sources that returns three numbers, so the driver never holds the
sources. Sampling: with target = whole * words + rest, each document of the source is taken `whole` times, and a seeded
order of its documents (md5 of seed and id) is taken once more up to `rest` words; the document on the boundary gives its
first words only, so a source's words equal its target's whole part.

A hot source: words are summed by (source, 4,096 slices of the order) with partial aggregation. Only the slice on the
boundary is put in order, which is 1/4,096 of a source's rows.

Defined results: null text or a text without words has size 0 and is taken 0 words; a null source is a source of its own,
last; repeated rows count as rows (with equal ids they stand beside each other in the order); an empty table gives an
empty result; other columns of the input are kept by `mixed` and never read here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import WORD, materialize, partitions, words_count

SLICE = 3  # hex digits of the order: 4,096 slices


def source_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Weights by the code-point order of the sources, repeating; null comes last. One row for each source.

    Sources may be very many: they are sorted in ranges, and a source's place is its place in the range plus the sizes of
    the ranges before, of which there is one row for each partition.
    """
    order = F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(partitions(sources), order).sortWithinPartitions(order)
    ranged = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()), "mix-sources").withColumn("_range", F.shiftright("_id", 33))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    rows = ranged.join(before, "_range").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    return rows.drop("_id", "_range", "_before")


def water_fill(sources: DataFrame, epochs: int) -> DataFrame:
    """Adds `target` to (source, source_size, weight): shares of all words by weight, none above epochs * source_size."""
    caps = sources.withColumn("_cap", F.col("source_size") * epochs)
    row = caps.agg(F.sum("source_size"), F.sum("weight")).first()
    total, clamped, free = int(row[0] or 0), 0, int(row[1] or 0)
    above = lambda: F.col("_cap").cast("decimal(38,0)") * F.lit(free).cast("decimal(38,0)") < F.lit(total - clamped).cast("decimal(38,0)") * F.col("weight")
    while free:
        row = caps.agg(F.sum(F.when(above(), F.col("_cap"))), F.sum(F.when(~above(), F.col("weight")))).first()
        now = int(row[0] or 0), int(row[1] or 0)
        if now == (clamped, free):
            break
        clamped, free = now
    share = (F.lit(float(total - clamped)) * F.col("weight") / F.lit(float(free))) if free else F.col("_cap").cast("double")
    return caps.withColumn("target", F.when(above(), F.col("_cap").cast("double")).otherwise(share) if free else share).drop("_cap")


def _order(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 0) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target (its source's), taken (words, repeats counted)."""
    return _planned(docs, weights, epochs, seed, [])


def _planned(docs: DataFrame, weights: tuple[int, ...], epochs: int, seed: int, carried: list[Column]) -> DataFrame:
    """`mix_sources` with further columns of each row."""
    sized = materialize(docs.select("doc_id", "source", words_count(F.col("text")).alias("size"), _order(seed).alias("_at"), *carried), "mix-sizes")
    own = sized.columns[4:]
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(source_weights(by_source, weights), "mix-sources")
    sources = water_fill(sources, epochs).withColumn("_words", F.floor("target").cast("long"))
    sources = sources.withColumn("_whole", F.when(F.col("source_size") > 0, F.expr("_words div source_size")).otherwise(F.lit(0)).cast("long"))
    sources = materialize(sources.withColumn("_rest", F.col("_words") - F.col("_whole") * F.col("source_size")), "mix-targets")

    by_slice = sized.groupBy("source", F.substring("_at", 1, SLICE).alias("_slice")).agg(F.sum("size").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("source").orderBy("_slice")) - F.col("_size")
    by_slice = by_slice.withColumn("_before", before).alias("x").join(sources.alias("s"), F.expr("x.source <=> s.source"))
    edge = by_slice.where("_before <= _rest and _rest < _before + _size").select("x.source", "_slice", "_before")
    plan = materialize(sources.alias("s").join(edge.alias("e"), F.expr("s.source <=> e.source"), "left").select("s.*", "_slice", "_before"), "mix-plan")

    rows = sized.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source")).select("doc_id", "size", "source_size", "target", "p.source", "_whole", "_rest", "_slice", "_before", "_at", *own)
    mine = F.substring("_at", 1, SLICE)
    clear = rows.where(F.col("_slice").isNull() | (mine != F.col("_slice")))
    clear = clear.withColumn("_once", F.when((F.col("_rest") > 0) & (mine < F.col("_slice")), F.col("size")).otherwise(F.lit(0)))
    within = Window.partitionBy("source").orderBy("_at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge_rows = rows.where(mine == F.col("_slice")).withColumn("_before", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    edge_rows = edge_rows.withColumn("_once", F.least("size", F.greatest(F.lit(0), F.col("_rest") - F.col("_before"))))
    out = clear.unionByName(edge_rows)
    return out.select("doc_id", "size", "source_size", "target", (F.col("_whole") * F.col("size") + F.col("_once")).cast("long").alias("taken"), *own)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for each whole repetition, and one with the first words of the
    text where a document is taken in part. Every row has its own plan, whether its doc_id is null, repeated or neither."""
    plan = _planned(docs, weights, epochs, seed, [F.struct(*docs.columns).alias("mx__row")]).where("taken > 0")
    plan = plan.select("mx__row.*", F.col("size").alias("mx__size"), F.col("taken").alias("mx__taken"))
    part = F.when(F.col("mx__size") > 0, F.col("mx__taken") % F.greatest(F.col("mx__size"), F.lit(1))).otherwise(F.lit(0))
    whole = F.when(F.col("mx__size") > 0, F.expr("mx__taken div greatest(mx__size, 1)")).otherwise(F.lit(0))
    rows = plan.withColumn("mx__part", part).withColumn("mx__whole", whole)
    lengths = F.concat(F.array_repeat(F.col("mx__size"), F.col("mx__whole").cast("int")), F.when(F.col("mx__part") > 0, F.array(F.col("mx__part"))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("mx__take", F.explode(lengths))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("mx__take").cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("mx__take") < F.col("mx__size"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)

"""The driver's tables, and engine tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.text import white_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_segments(conversations: DataFrame) -> DataFrame:
    """A conversation is a meeting, a turn a segment of 10 seconds, a role a speaker."""
    return conversations.select(F.col("conv_id").alias("meeting_id"), F.col("turn").cast("int").alias("segment_id"), F.col("turn").cast("int").alias("seg_idx"), F.col("turn").cast("int").alias("utt_idx"), F.col("role").alias("speaker"), "text", (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 8.0).alias("end"), F.lit(-0.5).alias("avg_logprob"))


def conversation_words(conversations: DataFrame, most: int | None = None) -> DataFrame:
    """Words of each turn, half a second apart; a word's probability follows from its length, so runs agree."""
    toks = white_tokens(F.col("text"))
    rows = conversations.select("conv_id", "turn", F.posexplode(F.slice(toks, 1, most) if most else toks).alias("word_idx", "word"))
    start = F.col("turn") * 1000.0 + F.col("word_idx") * 0.5
    prob = F.when(F.char_length("word") % 3 == 0, 0.35).otherwise(0.95)
    return rows.select(F.col("conv_id").alias("meeting_id"), F.col("turn").cast("int").alias("segment_id"), "word_idx", "word", start.alias("start"), (start + 0.4).alias("end"), prob.alias("probability"), F.lit(None).cast("string").alias("speaker"))


def event_spans(events: DataFrame, hours: float = 1.0) -> DataFrame:
    """Events of a user as timed words: a start in hours since 1970, and an end `hours` later; ordinals by time."""
    start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 3.6e9
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events.select("user_id", "event_id", "event_type", "value", "ts", place.cast("int").alias("idx"), start.alias("start"), (start + hours).alias("end"))

"""Segmentation and window operators over words, segments and turns.

All windows are partitioned by meeting (most by meeting and segment). Order keys are ordinals, never times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import constants as C
from parlance.functions.text import strip, white_tokens


def runs(rows: DataFrame, changed: Column, keys: list[str], order: list[str], name: str = "run") -> DataFrame:
    """Number of the run that each row belongs to; `changed` says that a row begins one (null: it does)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.sum(F.when(F.coalesce(changed, F.lit(True)), 1).otherwise(0)).over(window).cast("int"))


def chunk_kind(duration: Column) -> Column:
    return F.when(duration >= C.EMBED_S, "long").when(duration >= C.ASSIGN_S, "short").otherwise("tiny")


def pause_chunks(words: DataFrame, segments: DataFrame, gap: float = C.PAUSE_S) -> DataFrame:
    """CHUNKS: words of a segment that no pause above `gap` parts; a segment without words is one chunk."""
    window = Window.partitionBy("meeting_id", "segment_id").orderBy("word_idx")
    rows = runs(words, F.col("start") - F.lag("end").over(window) > gap, ["meeting_id", "segment_id"], ["word_idx"])
    spoken = rows.groupBy("meeting_id", "segment_id", "run").agg(
        F.min_by("start", "word_idx").alias("start"),
        F.max_by("end", "word_idx").alias("end"),
        F.array_sort(F.collect_list(F.struct("segment_id", "word_idx"))).alias("word_refs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", strip(F.col("word")).alias("w")))), lambda x: x["w"]), " ").alias("text"),
    ).withColumn("whole_segment", F.lit(None).cast("int"))
    silent = segments.join(words.select("meeting_id", "segment_id").distinct(), ["meeting_id", "segment_id"], "left_anti")
    silent = silent.select("meeting_id", "segment_id", F.lit(1).alias("run"), "start", "end", F.array().cast("array<struct<segment_id:int,word_idx:int>>").alias("word_refs"), strip(F.col("text")).alias("text"), F.col("segment_id").alias("whole_segment"))
    out = spoken.unionByName(silent).withColumn("chunk_idx", (F.row_number().over(Window.partitionBy("meeting_id").orderBy("segment_id", "run")) - 1).cast("int"))
    return out.withColumn("kind", chunk_kind(F.col("end") - F.col("start"))).drop("run")


def word_lists(words: DataFrame) -> DataFrame:
    """(meeting_id, segment_id, ws): each segment's words in order, as structs (word_idx, w, p)."""
    item = F.struct("word_idx", strip(F.col("word")).alias("w"), F.col("probability").alias("p"))
    return words.groupBy("meeting_id", "segment_id").agg(F.array_sort(F.collect_list(item)).alias("ws"))


def low_confidence_ngrams(words: DataFrame, longest: int = C.MAX_NGRAM, unsure: float = C.LOW_CONFIDENCE) -> DataFrame:
    """Phrases of 1 to `longest` words of a segment with an unsure word, none across a sentence's end, shorter ones first."""
    rows = word_lists(words)
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("ws")))))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("n"))))
    rows = rows.withColumn("part", F.slice("ws", F.col("i") + 1, F.col("n"))).drop("ws")
    ends = F.exists(F.slice("part", F.lit(1), F.col("n") - 1), lambda x: x["w"].rlike("[.?!]$"))
    rows = rows.where(~ends & F.exists("part", lambda x: x["p"] < unsure))
    rows = rows.withColumn("phrase", strip(F.array_join(F.transform("part", lambda x: x["w"]), " "))).where("phrase <> ''")
    return rows.select("meeting_id", "segment_id", "n", "i", "phrase")


def merge_turns(rows: DataFrame, keys: list[str], who: str, order: list[str], text: str = "text") -> DataFrame:
    """Neighbouring rows of one speaker as a turn: turn_idx (from 0), speaker, start of the first, end of the last, text."""
    window = Window.partitionBy(*keys).orderBy(*order)
    changed = ~F.col(who).eqNullSafe(F.lag(who).over(window)) | (F.row_number().over(window) == 1)
    rows = runs(rows, changed, keys, order, "turn_idx")
    place = F.struct(*order)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("part_text")))), lambda x: x["part_text"])
    out = rows.groupBy(*keys, "turn_idx").agg(F.first(who).alias(who), F.min_by("start", place).alias("start"), F.max_by("end", place).alias("end"), F.count(F.lit(1)).alias("n_parts"), F.array_join(parts, " ").alias("text"))
    return out.withColumn("turn_idx", F.col("turn_idx") - 1)


def first_appearance(rows: DataFrame, keys: list[str], label: str, order: str, name: str = "speaker", prefix: str = "Speaker ") -> DataFrame:
    """Labels renamed by the order in which they appear first."""
    first = rows.groupBy(*(F.col(k).alias(f"fa__{k}") for k in [*keys, label])).agg(F.min(order).alias("fa__at"))
    place = F.dense_rank().over(Window.partitionBy(*(f"fa__{k}" for k in keys)).orderBy("fa__at"))
    first = first.withColumn("fa__name", F.concat(F.lit(prefix), place)).drop("fa__at")
    mine = [F.col(k).eqNullSafe(F.col(f"fa__{k}")) for k in [*keys, label]]
    return rows.join(first, mine).select(*rows.columns, F.col("fa__name").alias(name))


def fill_labels(rows: DataFrame, keys: list[str], label: str, order: list[str], default=0) -> DataFrame:
    """Missing labels take the one before, else the one after, else the default."""
    window = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(label, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(label, ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(label, F.coalesce(before, after, F.lit(default)))


def assemble(segments: DataFrame) -> DataFrame:
    """One row for each meeting: text, number of segments, warnings for empty and unsure speech."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("segment_id", strip(F.col("text")).alias("t")))), lambda x: x["t"])
    rows = segments.groupBy("meeting_id").agg(strip(F.array_join(texts, " ")).alias("text"), F.count(F.lit(1)).alias("n_segments"), F.count_if(F.col("avg_logprob") < C.LOW_LOGPROB).alias("n_low"), F.sort_array(F.collect_list(F.when(F.col("avg_logprob") < C.LOW_LOGPROB, F.col("segment_id")))).alias("low_confidence_segment_ids"), F.max("end").alias("duration"))
    empty = F.when(F.col("text") == "", "No speech was detected.")
    low = F.when(F.col("n_low") > 0, F.format_string("%d segment(s) were transcribed with low confidence.", "n_low"))
    return rows.withColumn("is_empty", F.col("text") == "").withColumn("warnings", F.array_compact(F.array(empty, low)))


def render_segments(segments: DataFrame) -> DataFrame:
    """`[12s] (segment 3) text`, with the speaker where there is a speaker column. Half seconds go to the even one."""
    who = F.concat(F.coalesce("speaker", F.lit("Unknown")), F.lit(": ")) if "speaker" in segments.columns else F.lit("")
    return segments.withColumn("line", F.concat(F.lit("["), F.bround("start", 0).cast("long").cast("string"), F.lit("s] (segment "), F.col("segment_id").cast("string"), F.lit(") "), who, F.col("text")))


def context_windows(segments: DataFrame, before: int, text: str = "text", order: str = "segment_id", name: str = "context") -> DataFrame:
    """Each segment's text behind that of the `before` segments in front of it."""
    window = Window.partitionBy("meeting_id").orderBy(order).rowsBetween(-before, 0)
    return segments.withColumn(name, F.array_join(F.collect_list(text).over(window), " "))


def first_other_reply(utterances: DataFrame, who: str = "speaker", order: str = "utt_idx") -> DataFrame:
    """Adds reply_idx, reply_speaker, reply_text: the first later utterance in another voice.

    An utterance of a run is answered by the first of the next run, so one lead over runs does it, without a self-join.
    """
    window = Window.partitionBy("meeting_id").orderBy(order)
    changed = ~F.col(who).eqNullSafe(F.lag(who).over(window)) | (F.row_number().over(window) == 1)
    rows = runs(utterances, changed, ["meeting_id"], [order], "fr__run")
    heads = rows.groupBy("meeting_id", "fr__run").agg(F.min_by(F.struct(F.col(order).alias("i"), F.col(who).alias("w"), F.col("text").alias("t")), order).alias("fr__head"))
    heads = heads.withColumn("fr__run", F.col("fr__run") - 1)
    out = rows.join(heads, ["meeting_id", "fr__run"], "left")
    return out.withColumn("reply_idx", F.col("fr__head.i")).withColumn("reply_speaker", F.col("fr__head.w")).withColumn("reply_text", F.col("fr__head.t")).drop("fr__run", "fr__head")


def inject_errors(segments: DataFrame, corruptions: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(segments, words) with terms replaced by mis-hearings: whole words in any case; injected words are unsure (0.35).

    `applied` of the segments lists (wrong, term) pairs that occurred.
    """
    bare = lambda t: F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}_]", ""))
    text, hits = F.col("text"), []
    for term, wrong in corruptions.items():
        pattern = F.concat(F.lit("(?i)\\b\\Q"), F.lit(term), F.lit("\\E\\b"))
        hits.append(F.when(F.regexp_like(text, pattern), F.struct(F.lit(wrong).alias("wrong"), F.lit(term).alias("term"))))
        text = F.regexp_replace(text, pattern, F.lit(wrong.replace("\\", "\\\\").replace("$", "\\$")))
    out = segments.withColumn("applied", F.array_compact(F.array(*hits)) if hits else F.array().cast("array<struct<wrong:string,term:string>>")).withColumn("text", text)
    toks = white_tokens(F.col("text"))
    step = (F.col("end") - F.col("start")) / F.greatest(F.size(toks), F.lit(1))
    injected = F.flatten(F.transform("applied", lambda x: F.split(F.lower(x["wrong"]), " ")))
    rows = out.select("meeting_id", "segment_id", "start", step.alias("ie__step"), injected.alias("ie__bad"), F.posexplode(toks).alias("word_idx", "word"))
    begin = F.col("start") + F.col("word_idx") * F.col("ie__step")
    prob = F.when(F.array_contains("ie__bad", bare(F.col("word"))), 0.35).otherwise(0.95)
    words = rows.select("meeting_id", "segment_id", "word_idx", "word", begin.alias("start"), (begin + F.col("ie__step")).alias("end"), prob.alias("probability"), F.lit(None).cast("string").alias("speaker"))
    return out, words

"""Exports, one row for each meeting. Nulls are kept in JSON and read "unspecified" in Markdown."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import constants as C
from parlance.functions.text import clock

M = "meeting_id"


def keeper(folder: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a table below `folder`, which driver and executors share, and reads it back."""

    def keep(rows: DataFrame, name: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    return keep


def to_json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def ordered(rows: DataFrame, order: list[str], item: Column, name: str, where: Column | None = None) -> DataFrame:
    """(meeting_id, name): the items of a meeting in order, as an array."""
    rows = rows.where(where) if where is not None else rows
    return rows.groupBy(M).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, item.alias("item")))), lambda x: x["item"]).alias(name))


def owner_display(owner: Column, source: Column) -> Column:
    shown = F.when(source == "inferred", F.concat(owner, F.lit(" (inferred)"))).when(source == "speaker", F.concat(owner, F.lit(" (voice only)"))).otherwise(owner)
    return F.when(F.coalesce(owner, F.lit("")) == "", F.lit(C.UNSPECIFIED)).otherwise(shown)


def deadline_display(deadline: Column) -> Column:
    return F.when(F.coalesce(deadline, F.lit("")) == "", F.lit(C.UNSPECIFIED)).otherwise(deadline)


def transcript_json(transcripts: DataFrame) -> DataFrame:
    """(meeting_id, json) with is_empty, low_confidence_segment_ids and the real-time factor to three places."""
    factor = F.when(F.col("duration") > 0, F.round(F.col("processing_seconds") / F.col("duration"), 3)).otherwise(0.0)
    return transcripts.withColumn("realtime_factor", factor).select(M, to_json("text", "duration", "is_empty", "low_confidence_segment_ids", "realtime_factor", "warnings").alias("json"))


def record_json(records: DataFrame, decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """(meeting_id, json) of records (summary, minutes, model, warnings) with their kept decisions and actions."""
    d = ordered(decisions, ["ordinal"], F.struct("statement", "evidence", "segment_id", "timestamp"), "decisions", F.col("status") == "kept")
    a = ordered(actions, ["ordinal"], F.struct("task", "owner", "deadline", "evidence", "segment_id", "timestamp", "owner_source", "owner_evidence", "owner_label"), "action_items", F.col("status") == "kept")
    rows = records.join(d, M, "left").join(a, M, "left")
    none = lambda n: F.coalesce(F.col(n), F.expr(f"filter({n}, x -> false)"), F.from_json(F.lit("[]"), rows.schema[n].dataType)).alias(n)
    return rows.select(M, to_json("summary", "minutes", none("decisions"), none("action_items"), "model", "warnings").alias("json"))


def _section(title: str, lines: Column, empty: str) -> Column:
    body = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(empty))
    return F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n"))


def markdown(records: DataFrame, decisions: DataFrame, actions: DataFrame, edits: DataFrame | None = None, naming: dict[str, DataFrame] | None = None) -> DataFrame:
    """(meeting_id, markdown) in a fixed order of sections."""
    evidence = F.when(F.coalesce("evidence", F.lit("")) != "", F.concat(F.lit('\n  - evidence: "'), F.col("evidence"), F.lit('"'))).otherwise(F.lit(""))
    d = ordered(decisions, ["ordinal"], F.concat(F.lit("- **"), F.col("statement"), F.lit("**"), evidence), "d_lines", F.col("status") == "kept")
    kept = F.col("status") == "kept"
    row = F.concat(F.lit("| "), F.col("task"), F.lit(" | "), owner_display(F.col("owner"), F.col("owner_source")), F.lit(" | "), deadline_display(F.col("deadline")), F.lit(" |"))
    a = ordered(actions, ["ordinal"], row, "a_lines", kept)
    how = ordered(actions, ["ordinal"], F.concat(F.lit("- *"), F.col("task"), F.lit("*: "), F.col("owner_evidence")), "how_lines", kept & F.col("owner_source").isin("inferred", "speaker"))
    rows = records.join(d, M, "left").join(a, M, "left").join(how, M, "left")
    none = F.array().cast("array<string>")
    if naming is not None:
        rows = rows.join(ordered(naming["name_bindings"], ["speaker"], F.concat(F.lit("- "), F.col("description")), "n_lines"), M, "left").join(ordered(naming["name_conflicts"], ["conflict"], F.concat(F.lit("- _not named:_ "), F.col("conflict")), "c_lines"), M, "left")
    else:
        rows = rows.withColumn("n_lines", none).withColumn("c_lines", none)
    if edits is not None:
        rows = rows.join(ordered(edits, ["ordinal"], F.concat(F.lit("| "), F.col("original"), F.lit(" | "), F.col("replacement"), F.lit(" | "), F.col("reason"), F.lit(" |")), "e_lines", F.col("accepted")), M, "left")
    else:
        rows = rows.withColumn("e_lines", none)
    for name in ("d_lines", "a_lines", "how_lines", "n_lines", "c_lines", "e_lines", "warnings"):
        rows = rows.withColumn(name, F.coalesce(F.col(name), none))
    when = lambda cond, text: F.when(cond, text)
    parts = F.array_compact(F.array(
        F.lit("# Meeting Record\n"),
        when(F.size("warnings") > 0, F.concat(F.lit("> **Notes**\n"), F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("> - "), w)), "\n"), F.lit("\n"))),
        when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("## Summary\n\n"), F.col("summary"), F.lit("\n"))),
        _section(C.TITLES[0], F.transform(F.coalesce("minutes", none), lambda m: F.concat(F.lit("- "), m)), C.PLACEHOLDERS[0]),
        _section(C.TITLES[1], F.col("d_lines"), C.PLACEHOLDERS[1]),
        _section(C.TITLES[2], F.when(F.size("a_lines") > 0, F.concat(F.array(F.lit("| Task | Owner | Deadline |"), F.lit("| :-- | :-- | :-- |")), F.col("a_lines"))).otherwise(none), C.PLACEHOLDERS[2]),
        when(F.size("how_lines") > 0, F.concat(F.lit("**How owners marked _(inferred)_ / _(voice only)_ are known:**\n\n"), F.array_join("how_lines", "\n"), F.lit("\n"))),
        when(F.size("n_lines") + F.size("c_lines") > 0, F.concat(F.lit("## Speaker Names (inferred from the conversation)\n\n"), F.array_join(F.concat("n_lines", "c_lines"), "\n"), F.lit("\n"))),
        when(F.size("e_lines") > 0, F.concat(F.lit("## Terminology Corrections Applied\n\n| Original | Corrected | Reason |\n| :-- | :-- | :-- |\n"), F.array_join("e_lines", "\n"), F.lit("\n"))),
    ))
    return rows.select(M, F.array_join(parts, "\n").alias("markdown"))


def turns_markdown(turns: DataFrame, shown: str = "shown") -> DataFrame:
    """(meeting_id, markdown): `**Speaker** [m:ss]: text` of each turn."""
    line = F.concat(F.lit("**"), F.col(shown), F.lit("** ["), clock(F.col("start")), F.lit("]: "), F.col("text"))
    return ordered(turns, ["turn_idx"], line, "lines").select(M, F.array_join("lines", "\n\n").alias("markdown"))


def transcripts_markdown(raw: DataFrame, refined: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """(meeting_id, markdown) of raw and refined texts (meeting_id, text), and of speakers' turns where there are any."""
    rows = raw.select(M, F.col("text").alias("raw")).join(refined.select(M, F.col("text").alias("refined")), M, "left")
    out = F.concat(F.lit("# Raw Transcript\n\n"), F.col("raw"), F.lit("\n\n# Refined Transcript\n\n"), F.coalesce("refined", "raw"), F.lit("\n"))
    if turns is not None:
        rows = rows.join(turns_markdown(turns).withColumnRenamed("markdown", "t"), M, "left")
        out = F.concat(out, F.coalesce(F.concat(F.lit("\n# Speaker-labelled Transcript\n\n"), F.col("t"), F.lit("\n")), F.lit("")))
    return rows.select(M, out.alias("markdown"))


def timestamp_index(decisions: DataFrame, actions: DataFrame, lead_seconds: float = 2.0) -> DataFrame:
    """Replay points: decisions, then actions, that have a time; replay starts two seconds early, at 0 at the least."""
    rows = decisions.select(M, F.lit("decision").alias("kind"), "ordinal", F.col("statement").alias("label"), "timestamp").unionByName(actions.select(M, F.lit("action").alias("kind"), "ordinal", F.col("task").alias("label"), "timestamp"))
    rows = rows.where("timestamp is not null").withColumn("replay_from", F.greatest(F.lit(0.0), F.col("timestamp") - lead_seconds)).withColumn("clock", clock(F.col("timestamp")))
    place = Window.partitionBy(M).orderBy(F.desc("kind"), "ordinal")
    return rows.withColumn("position", F.row_number().over(place))

"""From words and segments to verified meeting records.

`MeetingPlan` composes the operators lazily. Laziness changes what a failure is: a plan that is built cannot fail, a job can.
So models return errors as rows, and `run` materialises each stage by itself, and within a stage each table that is read more
than once, so no plan holds more than one step; it goes on without a stage that may degrade, leaving a row in the stage log.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators import cluster, grounding, naming, refine, segmentation
from parlance.operators.refine import Keep, as_it_is
from parlance.plans import models
from parlance.sinks import export

M = "meeting_id"

PROMPTS = {
    "edits": "Correct mis-heard technical terms only. Answer with JSON: {\"edits\": [{\"segment_id\", \"original\", \"replacement\", \"reason\", \"confidence\"}]}.",
    "review": "Judge each proposed correction in its context. Answer with JSON: {\"verdicts\": [{\"index\", \"keep\", \"why\"}]}.",
    "record": "Write the record of this meeting; quote evidence for every item; null for what was not said. Answer with JSON: {\"summary\", \"minutes\", \"decisions\": [{\"statement\", \"evidence\"}], \"action_items\": [{\"task\", \"owner\", \"deadline\", \"evidence\"}]}.",
}


@dataclass
class Result:
    """Tables of a run by name, what each stage took, and warnings."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    stage_log: list[tuple[str, float, str | None]] = field(default_factory=list)
    failed_stage: str | None = None

    @property
    def ok(self) -> bool:
        return self.failed_stage is None

    def warnings(self) -> list[str]:
        return [f"{name} could not run ({error}); continuing without it." for name, _, error in self.stage_log if error and name != self.failed_stage]


@dataclass
class MeetingPlan:
    """Inputs and options. diarize: "auto" labels speakers where chunks have embeddings, "on" raises where they have none,
    "off" does not label."""

    segments: DataFrame
    words: DataFrame
    terms: DataFrame
    embeddings: DataFrame | None = None
    editor: Callable[[], models.ChatModel] | None = None
    reviewer: Callable[[], models.ChatModel] | None = None
    recorder: Callable[[], models.ChatModel] = lambda: models.silent_model
    fallback: Callable[[], models.ChatModel] | None = None
    diarize: str = "auto"
    num_speakers: int | None = None

    def speakers(self, keep: Keep = as_it_is) -> dict[str, DataFrame]:
        chunks = keep(segmentation.pause_chunks(self.words, self.segments), "chunks")
        if self.embeddings is None:
            if self.diarize == "on":
                raise ValueError("speaker labels were asked for, and no embeddings were given")
            return {"chunks": chunks}
        voiced = keep(chunks.join(self.embeddings.select(M, "chunk_idx", "embedding"), [M, "chunk_idx"], "left"), "voiced_chunks")
        labelled = keep(cluster.label_chunks(voiced, num_speakers=self.num_speakers), "labelled")
        return {"chunks": chunks, "labelled": labelled, "words": cluster.label_words(self.words, labelled), "turns": cluster.speaker_turns(labelled)}

    def refined(self, words: DataFrame, keep: Keep = as_it_is) -> dict[str, DataFrame]:
        verdicts = model_edits = None
        if self.reviewer is not None:
            proposals = refine.glossary_proposals(words, self.terms).join(self.segments.select(M, "segment_id", "text"), [M, "segment_id"])
            line = F.format_string('%d. in "%s"\n   replace \'%s\' with \'%s\'?', "ordinal", "text", "original", "replacement")
            asked = export.ordered(proposals, ["ordinal"], line, "lines").select(M, F.lit(PROMPTS["review"]).alias("system"), F.array_join("lines", "\n").alias("user"))
            verdicts = keep(models.parse_verdicts(models.ask(asked, self.reviewer)), "verdicts")
        if self.editor is not None:
            marked = self.segments.join(refine.unsure_words(words), [M, "segment_id"], "left")
            line = F.concat(F.lit("segment "), F.col("segment_id").cast("string"), F.coalesce("marker", F.lit("")), F.lit(': "'), F.col("text"), F.lit('"'))
            asked = export.ordered(marked, ["segment_id"], line, "lines").select(M, F.lit(PROMPTS["edits"]).alias("system"), F.array_join("lines", "\n").alias("user"))
            model_edits = keep(models.parse_edits(models.ask(asked, self.editor)), "model_edits")
        segments, edits = refine.refine(self.segments, words, self.terms, verdicts, model_edits, keep)
        return {"refined": segments, "edits": edits}

    def named(self, refined: DataFrame, words: DataFrame, edits: DataFrame, keep: Keep = as_it_is) -> dict[str, DataFrame]:
        utterances = keep(naming.speaker_utterances(refined, words, edits), "utterances")
        return {"utterances": utterances, **naming.infer_names(utterances, self.terms, keep)}

    def recorded(self, utterances: DataFrame, keep: Keep = as_it_is) -> dict[str, DataFrame]:
        lines = segmentation.render_segments(utterances)
        texts = export.ordered(lines, ["utt_idx"], F.col("line"), "lines").select(M, F.array_join("lines", "\n").alias("text"))
        routed = keep(models.route(texts), "routed")
        prompts = routed.select(M, F.lit(PROMPTS["record"]).alias("system"), F.concat(F.lit("Transcript:\n"), F.col("text")).alias("user"))
        replies = keep(models.ask(prompts, self.recorder, self.fallback), "replies").join(routed.select(M, "text", "size_warning"), M)
        records, decisions, actions = models.parse_records(replies)
        return {"records": records, "claimed_decisions": decisions, "claimed_actions": actions, "routing": routed.drop("text")}

    def grounded(self, t: dict[str, DataFrame], keep: Keep = as_it_is) -> dict[str, DataFrame]:
        names = {k: t[k] for k in ("name_bindings", "name_candidates", "turn_suspects")}
        decisions, actions = grounding.ground(t["claimed_decisions"], t["claimed_actions"], t["refined"], t["utterances"], names, keep)
        actions = keep(naming.attribute_owners(keep(actions, "merged_actions"), t["name_bindings"]), "action_items")
        return {"decisions": decisions, "action_items": actions, "record_warnings": grounding.record_warnings(decisions, actions)}

    def run(self, keep: Keep) -> Result:
        """`keep(table, name)` materialises a table at once, as a write and a read of a shared folder does (`export.keeper`)."""
        out = Result()
        t = out.tables
        t |= {"segments": self.segments, "words": self.words}

        def stage(name: str, make: Callable[[], dict[str, DataFrame]], otherwise: Callable[[], dict[str, DataFrame]] = dict, fatal: bool = False) -> None:
            began, error = time.time(), None
            try:
                made = {k: keep(v, k) for k, v in make().items()}
            except Exception as e:  # noqa: BLE001 - a stage that may degrade leaves its error in the log
                error, made = str(e).split("\n")[0][:300], otherwise()
                if fatal:
                    out.failed_stage = name
            t.update(made)
            out.stage_log.append((name, time.time() - began, error))

        stage("assemble", lambda: {"transcripts": segmentation.assemble(self.segments)}, fatal=True)
        if out.failed_stage:
            return out
        if self.diarize != "off":
            stage("diarize", lambda: self.speakers(keep))
            if self.diarize == "on" and out.stage_log[-1][2]:
                raise ValueError(out.stage_log[-1][2])
        edits = self.segments.sparkSession.createDataFrame([], "meeting_id string, ordinal int, segment_id int, original string, replacement string, reason string, accepted boolean")
        stage("refine", lambda: self.refined(t["words"], keep), lambda: {"refined": self.segments, "edits": edits})
        stage("name", lambda: self.named(t["refined"], t["words"], t["edits"], keep))
        if "utterances" in t:
            stage("record", lambda: self.recorded(t["utterances"], keep))
        if "records" in t:
            stage("verify", lambda: self.grounded(t, keep))
        return out


def exports(result: Result) -> DataFrame:
    """(meeting_id, json, markdown) of a run that has records."""
    t = result.tables
    records = t["records"].join(t["record_warnings"].withColumnRenamed("warnings", "w2"), M, "left").withColumn("warnings", F.concat("warnings", F.coalesce("w2", F.array().cast("array<string>")))).drop("w2").withColumn("model", F.lit("injected"))
    names = {k: t[k] for k in ("name_bindings", "name_conflicts")}
    return export.record_json(records, t["decisions"], t["action_items"]).join(export.markdown(records, t["decisions"], t["action_items"], t["edits"], names), M)


def windowed(utterances: DataFrame, minutes: float = 15) -> DataFrame:
    """Utterances with meeting_id of their window of so many minutes, for models that hold only part of a long meeting; the
    claims of all windows meet again in grounding and merging under `whole_meeting`."""
    part = F.floor(F.col("start") / (60 * minutes)).cast("int")
    rows = utterances.withColumn("whole_meeting", F.col(M)).withColumn("window_idx", part)
    return rows.withColumn(M, F.concat_ws("#", "whole_meeting", F.col("window_idx").cast("string"))).withColumn("utt_idx", (F.row_number().over(Window.partitionBy(M).orderBy("utt_idx")) - 1).cast("int"))

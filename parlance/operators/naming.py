"""Speakers' utterances, and names for voices where the conversation gives evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import constants as C
from parlance.functions.text import clock, introductions, is_request, named, normalize, opens_reply, sentences, strip, vocative_candidates
from parlance.operators.refine import Keep, as_it_is, edits_by_segment, fold_edits
from parlance.operators.segmentation import merge_turns, runs

M = "meeting_id"


def speaker_utterances(segments: DataFrame, words: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """UTTERANCES. A segment of one voice has its refined text; one of several is rebuilt from its words, voice by voice,
    and its accepted edits are applied to each part."""
    voices = words.groupBy(M, "segment_id").agg(F.collect_set("speaker").alias("v"))
    rows = segments.join(voices, [M, "segment_id"], "left")
    one = rows.where(F.coalesce(F.size("v"), F.lit(0)) <= 1).select(M, "segment_id", F.lit(0).alias("part"), F.try_element_at("v", F.lit(1)).alias("speaker"), "start", "end", strip(F.col("text")).alias("text"))
    many = words.join(rows.where(F.size("v") > 1).select(M, "segment_id"), [M, "segment_id"], "left_semi")
    order = Window.partitionBy(M, "segment_id").orderBy("word_idx")
    many = many.withColumn("speaker", F.last("speaker", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    changed = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(order)) | (F.row_number().over(order) == 1)
    many = runs(many, changed, [M, "segment_id"], ["word_idx"], "part")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", strip(F.col("word")).alias("w")))), lambda x: x["w"]), " ")
    many = many.groupBy(M, "segment_id", "part").agg(F.first("speaker").alias("speaker"), F.min_by("start", "word_idx").alias("start"), F.max_by("end", "word_idx").alias("end"), text.alias("text"))
    if edits is not None:
        many = many.join(edits_by_segment(edits), [M, "segment_id"], "left")
        many = many.withColumn("text", F.when(F.col("e__edits").isNull(), F.col("text")).otherwise(fold_edits(F.col("text"), F.col("e__edits")))).drop("e__edits")
    out = one.unionByName(many)
    place = F.row_number().over(Window.partitionBy(M).orderBy("segment_id", "part")) - 1
    return out.select(M, place.cast("int").alias("utt_idx"), "segment_id", "speaker", "start", "end", "text")


def _vocative(rows: DataFrame, sentence: str, terms: DataFrame | None, name: str = "name") -> DataFrame:
    """Rows whose sentence addresses somebody, with the name: a leading one, else a trailing one, that may be a name."""
    rows = rows.withColumn("voc__list", F.filter(vocative_candidates(F.col(sentence)), lambda n: (n != "") & named(n)))
    rows = rows.where(F.size("voc__list") > 0).withColumn(name, F.element_at("voc__list", 1)).drop("voc__list")
    return _no_terms(rows, name, terms)


def _no_terms(rows: DataFrame, name: str, terms: DataFrame | None) -> DataFrame:
    if terms is None:
        return rows
    return rows.join(terms.select(F.col("norm").alias("nt__norm")).distinct(), normalize(rows[name]) == F.col("nt__norm"), "left_anti")


def turn_sentences(turns: DataFrame, index: str) -> DataFrame:
    """A row for each sentence: pos, sentence, and n, the number of the text's sentences."""
    rows = turns.withColumn("ts__all", sentences(F.col("text"))).withColumn("n", F.size("ts__all"))
    return rows.select(*turns.columns, "n", F.posexplode("ts__all").alias("pos", "sentence"))


def name_votes(utterances: DataFrame, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(votes, exclusions). votes: (meeting_id, speaker, name, weight, kind, at, quote, reply, reply_at, place); exclusions:
    (meeting_id, speaker, name) of names that a voice addressed itself."""
    turns = merge_turns(utterances, [M], "speaker", ["utt_idx"])
    order = Window.partitionBy(M).orderBy("turn_idx")
    turns = turns.withColumn("next_speaker", F.lead("speaker").over(order)).withColumn("next_text", F.lead("text").over(order)).withColumn("next_start", F.lead("start").over(order))
    rows = turn_sentences(turns.where("speaker is not null"), "turn_idx")
    place = lambda phase: F.struct("turn_idx", F.lit(phase).alias("phase"), "pos").alias("place")
    own = rows.withColumn("name", F.explode(introductions(F.col("sentence")))).where(named(F.col("name")))
    none = F.lit(None)
    own = _no_terms(own, "name", terms).select(M, "speaker", "name", F.lit(C.INTRODUCTION_WEIGHT).alias("weight"), F.lit("self-introduction").alias("kind"), F.col("start").alias("at"), F.col("sentence").alias("quote"), F.lit("").alias("reply"), none.cast("double").alias("reply_at"), place(0))
    called = _vocative(rows, "sentence", terms)
    asked = called.where((F.col("pos") == F.col("n") - 1) & is_request(F.col("sentence")) & F.col("next_speaker").isNotNull() & (F.col("next_speaker") != F.col("speaker")))
    asked = asked.select(M, F.col("next_speaker").alias("speaker"), "name", F.lit(C.ADDRESSED_WEIGHT).alias("weight"), F.lit("addressed-then-answered").alias("kind"), F.col("start").alias("at"), F.col("sentence").alias("quote"), F.col("next_text").alias("reply"), F.col("next_start").alias("reply_at"), place(1))
    return own.unionByName(asked), called.select(M, "speaker", "name").distinct()


def describe_evidence(kind: Column, at: Column, quote: Column, reply: Column, reply_at: Column) -> Column:
    own = F.concat(F.lit("introduced themself at "), clock(at), F.lit(': "'), quote, F.lit('"'))
    asked = F.concat(F.lit("addressed by name at "), clock(at), F.lit(' ("'), quote, F.lit('") and answered next at '), clock(F.coalesce(reply_at, at)), F.lit(' ("'), F.left(reply, F.lit(60)), F.lit('")'))
    return F.when(kind == "self-introduction", own).otherwise(asked)


def resolve_names(votes: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bindings, conflicts, candidates) of any votes with (meeting_id, speaker, name, weight, evidence, place).

    A voice takes its heaviest name and a name its heaviest voice, names that the voice itself addressed left out; a tie at
    the top names nobody. candidates: each voice's names with any evidence.
    """
    item = F.struct("place", "evidence")
    rows = votes.groupBy(M, "speaker", "name").agg(F.sum("weight").cast("int").alias("support"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["evidence"]).alias("evidence"), F.min("place").alias("first_place"))
    candidates = rows.groupBy(M, "speaker").agg(F.array_sort(F.collect_set("name")).alias("names"))
    rows = rows.join(exclusions.distinct().withColumn("rn__own", F.lit(True)), [M, "speaker", "name"], "left")
    said = F.format_string("%s would be '%s', but %s addressed '%s' themself — rejected", "speaker", "name", "speaker", "name")
    conflicts = rows.where("rn__own").select(M, said.alias("conflict"))
    rows = rows.where("rn__own is null").drop("rn__own")

    mine = Window.partitionBy(M, "speaker").orderBy(F.desc("support"), "first_place", "name")
    every = Window.partitionBy(M, "speaker")
    rows = rows.withColumn("k", F.row_number().over(mine)).withColumn("top", F.max("support").over(every)).withColumn("tied", F.count_if(F.col("support") == F.col("top")).over(every) > 1)
    rows = rows.withColumn("names", F.collect_list(F.struct("name", "support")).over(mine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ties = rows.where("tied and k = 1").select(M, F.format_string("%s: equal evidence for %s and %s — left unnamed", F.col("speaker"), F.col("names")[0]["name"], F.try_element_at("names", F.lit(2))["name"]).alias("conflict"))
    best = rows.where("not tied and k = 1").withColumn("contested_by", F.map_from_entries(F.slice("names", F.lit(2), F.size("names")))).drop("k", "top", "tied", "names")

    theirs = Window.partitionBy(M, "name").orderBy(F.desc("support"), "first_place", "speaker")
    same = Window.partitionBy(M, "name")
    best = best.withColumn("k", F.row_number().over(theirs)).withColumn("top", F.max("support").over(same)).withColumn("tied", F.count_if(F.col("support") == F.col("top")).over(same) > 1)
    best = best.withColumn("winner", F.first("speaker").over(theirs)).withColumn("voices", F.collect_list("speaker").over(theirs.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    shared = best.where("tied and k = 1").select(M, F.concat(F.lit("'"), F.col("name"), F.lit("' fits "), F.array_join("voices", " and "), F.lit(" equally — none named")).alias("conflict"))
    lost = best.where("not tied and k > 1").select(M, F.format_string("'%s' also fit %s (weaker evidence) — kept for %s only", "name", "speaker", "winner").alias("conflict"))
    bindings = best.where("not tied and k = 1").select(M, "speaker", "name", "support", "evidence", "contested_by")
    return bindings, conflicts.union(ties).union(shared).union(lost), candidates


def infer_names(utterances: DataFrame, terms: DataFrame | None = None, keep: Keep = as_it_is) -> dict[str, DataFrame]:
    """name_votes, name_exclusions, name_bindings, name_conflicts, name_candidates and turn_suspects. `keep` may write the
    votes, which bindings, conflicts and candidates read."""
    votes, exclusions = name_votes(utterances, terms)
    votes = votes.withColumn("evidence", describe_evidence(F.col("kind"), F.col("at"), F.col("quote"), F.col("reply"), F.col("reply_at")))
    votes, exclusions = keep(votes, "name_votes"), keep(exclusions, "name_exclusions")
    bindings, conflicts, candidates = resolve_names(votes, exclusions)
    weaker = F.when(F.size("contested_by") > 0, F.concat(F.lit(" (weaker evidence for "), F.array_join(F.map_keys("contested_by"), ", "), F.lit(")"))).otherwise(F.lit(""))
    bindings = bindings.withColumn("description", F.concat(F.col("speaker"), F.lit(" identified as "), F.col("name"), F.lit(": "), F.array_join("evidence", "; "), weaker))
    return {"name_votes": votes, "name_exclusions": exclusions, "name_bindings": bindings, "name_conflicts": conflicts, "name_candidates": candidates, "turn_suspects": suspected_misses(utterances, terms)}


def suspected_misses(utterances: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Requests to someone by name that the next sentence answers in the asker's own voice: (meeting_id, speaker, addressee,
    asked_at, question, reply, segment_id, reply_at, description)."""
    rows = turn_sentences(utterances, "utt_idx")
    order = Window.partitionBy(M).orderBy("utt_idx", "pos")
    for column, source in (("reply", "sentence"), ("reply_speaker", "speaker"), ("reply_segment", "segment_id"), ("reply_start", "start")):
        rows = rows.withColumn(column, F.lead(source).over(order))
    rows = rows.where(F.col("speaker").isNotNull() & (F.col("reply_speaker") == F.col("speaker")) & is_request(F.col("sentence")) & opens_reply(F.col("reply")))
    rows = _vocative(rows, "sentence", terms, "addressee")
    text = F.concat(F.col("speaker"), F.lit(" asked "), F.col("addressee"), F.lit(" a question at "), clock(F.col("start")), F.lit(' and the reply ("'), F.left(F.col("reply"), F.lit(50)), F.lit('", '), clock(F.col("reply_start")), F.lit(") was attributed to the same voice — likely a speaker change diarization missed"))
    return rows.select(M, "speaker", "addressee", F.col("start").alias("asked_at"), F.col("sentence").alias("question"), "reply", F.col("reply_segment").alias("segment_id"), F.col("reply_start").alias("reply_at"), text.alias("description"))


def display_names(rows: DataFrame, bindings: DataFrame) -> DataFrame:
    """Adds `shown`: "Speaker 1 (Name?)" where the voice is bound, else its label."""
    names = bindings.select(M, "speaker", F.col("name").alias("dn__name"))
    shown = F.when(F.col("dn__name").isNotNull(), F.concat(F.col("speaker"), F.lit(" ("), F.col("dn__name"), F.lit("?)"))).otherwise(F.coalesce("speaker", F.lit("Unknown")))
    return rows.join(names, [M, "speaker"], "left").withColumn("shown", shown).drop("dn__name")


def attribute_owners(actions: DataFrame, bindings: DataFrame) -> DataFrame:
    """Owners that are a voice's label take its bound name, marked as inferred, with both pieces of evidence."""
    names = bindings.select(M, F.col("speaker").alias("owner"), F.col("name").alias("ao__name"), F.col("description").alias("ao__why"))
    rows = actions.join(names, [M, "owner"], "left").withColumn("ao__hit", (F.col("owner_source") == "speaker") & F.col("ao__name").isNotNull())
    hit = F.coalesce("ao__hit", F.lit(False))
    rows = rows.withColumn("owner_label", F.when(hit, F.col("owner")).otherwise(F.col("owner_label"))).withColumn("owner_evidence", F.when(hit, F.concat(F.col("owner_evidence"), F.lit("; "), F.col("ao__why"))).otherwise(F.col("owner_evidence")))
    rows = rows.withColumn("owner", F.when(hit, F.col("ao__name")).otherwise(F.col("owner"))).withColumn("owner_source", F.when(hit, F.lit("inferred")).otherwise(F.col("owner_source")))
    return rows.select(*actions.columns)

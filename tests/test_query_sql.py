"""Queries against their SQL, on turns that the driver's tables hardly have."""

import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from parlance.functions import constants as C
from parlance.functions.phonetic import phrase_codes
from parlance.operators import refine, segmentation
from parlance.plans import evidence  # noqa: F401 - registers its queries
from parlance.plans.queries import ORACLES, QUERIES
from parlance.sources.tables import conversation_words, table


def conversations(folder, turns):
    """turns: texts by conversation; returns the folder as a query's input."""
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", t) for c, texts in enumerate(turns) for i, t in enumerate(texts)]
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    pq.write_table(pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema), f"{folder}/conversations.parquet")
    return str(folder)


def same_as_sql(spark, name, sf_dir):
    got = sorted(map(repr, (tuple(r) for r in QUERIES[name](spark, sf_dir).collect())))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
        want = sorted(map(repr, db.execute(ORACLES[name]).fetchall()))
    assert got == want
    return got


def test_speech_acts_of_words_that_decline_or_name_the_speaker(spark, tmp_path):
    words = ["No", "not", "I", "my", "skip it", "don't", "won't go", "hold off now", "later", "plain words here", "ñno una", "oké then", "noël", " ", None]
    same_as_sql(spark, "speech_acts", conversations(tmp_path, [[w] * 6 for w in words]))


def test_speech_acts_read_all_words_of_all_turns(spark, tmp_path):
    words = ["a b c d e I stay", "a b c d e it is my turn", "a b c d e we\nskip it", "a b c d e would\n you go", "a b c d e plain", "Mine is later", "é é é é é don't, I’ll", "a\x0bb c\x0bno", "Speaker 7 said so", "Yes", None, " "]
    sf_dir = conversations(tmp_path, [[w] * 6 for w in words])
    same_as_sql(spark, "speech_acts", sf_dir)
    got = {(r.conv_id, r.turn): r for r in QUERIES["speech_acts"](spark, sf_dir).collect()}
    said = {(c, t): (a + " ".join((w or "").split()) + b) for c, w in enumerate(words) if (w or "").strip() for t, (a, b) in enumerate((("Could you ", " this"), ("Sounds good, ", ""), ("Speaker 2 said I'll ", ""), ("We will not ", ""), ("Please ", ""), ("", "?")))}
    assert got.keys() == said.keys()
    assert {k: (r.request, r.opener, r.first_person, r.declines) for k, r in got.items()} == {k: tuple(bool(re.search(p, s)) for p in (C.REQUEST, C.REPLY_OPENER, C.FIRST_PERSON, C.DECLINES)) for k, s in said.items()}
    assert got[8, 5].label == "Speaker 7" and got[0, 0].first_person and got[2, 4].declines and not got[4, 4].first_person


def sent_after_explosion(frame):
    """Lines of the executed plan that are exploded below a broadcast."""
    lines, depth, found = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n"), None, []
    for line in lines:
        at = len(line) - len(line.lstrip(" :+-*"))
        depth = None if depth is not None and at <= depth else depth
        depth = at if depth is None and "BroadcastExchange" in line else depth
        found += [line] if depth is not None and "Generate" in line and "_codes" not in line else []
    return found


TURNS = [["No no no.", "Cooper netties runs it, cooper netties is fine", "no no. it is the", "The sequel store"], ["Ünïted läb says no no no"] * 9, ["is it", "of the", None, " "]]


def test_short_quotes_send_no_exploded_segments(spark, tmp_path):
    sf_dir = conversations(tmp_path, TURNS)
    assert same_as_sql(spark, "short_quote_verbatim", sf_dir)
    frame = QUERIES["short_quote_verbatim"](spark, sf_dir)
    frame.collect()
    assert not sent_after_explosion(frame)


def test_corrections_send_no_phrases(spark, tmp_path):
    sf_dir = conversations(tmp_path, TURNS)
    words = conversation_words(table(spark, sf_dir, "conversations"))
    frame = refine.glossary_proposals(words, refine.glossary_of(spark))
    got = {(r.meeting_id, r.segment_id, r.original, r.replacement) for r in frame.collect()}
    codes = {c: t for t in reversed(C.DEFAULT_TERMS) for c in phrase_codes(t)}
    want = set()
    for r in segmentation.low_confidence_ngrams(words).collect():
        core = r.phrase.strip(C.EDGE_MARKS)
        term = next((codes[c] for c in phrase_codes(core) if c in codes), None)
        if term and " ".join(re.findall(r"\w+", core.lower())) != term.lower() and not all(w in C.COMMON_WORDS for w in re.findall(r"\w+", core.lower())):
            want.add((r.meeting_id, r.segment_id, core, term))
    lower = lambda rows: {(m, s, o.lower(), t) for m, s, o, t in rows}  # noqa: E731 - of phrases that differ in case only the first is proposed
    assert lower(got) == lower(want) and any(o.lower() == "cooper netties" for _, _, o, _ in got)
    assert not sent_after_explosion(frame)

import pytest

from parlance.operators import grounding, naming, refine

LINES = [
    ("Speaker 1", "Hello all. Sam, can you update the Grafana dashboard?"),
    ("Speaker 2", "Yes, I'll take the Grafana dashboard update this week."),
    ("Speaker 1", "Thanks. We moved the billing service to Postgres on Friday."),
    ("Speaker 3", "Hi, I'm Priya. We should document the rollback plan soon."),
    ("Speaker 1", "Do that. Priya, could you review the incident report tomorrow?"),
    ("Speaker 3", "Sure, I'll review the incident report tomorrow."),
]


@pytest.fixture(scope="module")
def utterances(spark):
    return spark.createDataFrame([("m", i, i, s, 5.0 * i, 5.0 * i + 4, t) for i, (s, t) in enumerate(LINES)], "meeting_id string, utt_idx int, segment_id int, speaker string, start double, end double, text string").cache()


@pytest.fixture(scope="module")
def names(spark, utterances):
    return {k: v.cache() for k, v in naming.infer_names(utterances, refine.glossary_of(spark)).items()}


def test_names(names):
    got = {r.speaker: (r.name, r.support) for r in names["name_bindings"].collect()}
    assert got == {"Speaker 2": ("Sam", 1), "Speaker 3": ("Priya", 3)}
    assert {(r.speaker, r.name) for r in names["name_exclusions"].collect()} == {("Speaker 1", "Sam"), ("Speaker 1", "Priya")}
    text = names["name_bindings"].where("speaker = 'Speaker 2'").first().description
    assert text.startswith("Speaker 2 identified as Sam: addressed by name at 0:00 (\"Sam, can you update the Grafana dashboard?\") and answered next at 0:05")


def votes(spark, rows):
    return spark.createDataFrame([("m", s, n, w, "e", (i,)) for i, (s, n, w) in enumerate(rows)], "meeting_id string, speaker string, name string, weight int, evidence string, place struct<i:int>")


def test_ties_and_conflicts(spark):
    none = spark.createDataFrame([("m", "D", "Eve")], "meeting_id string, speaker string, name string")
    rows = votes(spark, [("A", "Sam", 1), ("A", "Leo", 1), ("B", "Ann", 2), ("B", "Zoe", 1), ("C", "Ann", 1), ("D", "Eve", 2), ("E", "Kim", 1), ("F", "Kim", 1)])
    bindings, conflicts, candidates = naming.resolve_names(rows, none)
    got = bindings.collect()
    assert [(r.speaker, r.name, r.contested_by) for r in got] == [("B", "Ann", {"Zoe": 1})]
    assert sorted(r.conflict for r in conflicts.collect()) == ["'Ann' also fit C (weaker evidence) — kept for B only", "'Kim' fits E and F equally — none named", "A: equal evidence for Sam and Leo — left unnamed", "D would be 'Eve', but D addressed 'Eve' themself — rejected"]
    assert {r.speaker: r.names for r in candidates.collect()}["A"] == ["Leo", "Sam"]


def test_suspected_miss(spark):
    rows = spark.createDataFrame([("m", 0, 0, "Speaker 1", 0.0, 4.0, "Sam, can you update the board? Yes, I'll take it."), ("m", 1, 1, "Speaker 2", 5.0, 6.0, "Good.")], "meeting_id string, utt_idx int, segment_id int, speaker string, start double, end double, text string")
    got = naming.suspected_misses(rows).collect()
    assert [(r.speaker, r.addressee, r.reply, r.segment_id) for r in got] == [("Speaker 1", "Sam", "Yes, I'll take it.", 0)]


def test_merged_segment_is_split_by_voice(spark):
    words = spark.createDataFrame([("m", 0, i, w, i * 1.0, i + 0.5, 0.9, s) for i, (w, s) in enumerate([("red", "A"), ("is", None), ("up", "A"), ("yes", "B"), ("red", "B"), ("is", "B")])], "meeting_id string, segment_id int, word_idx int, word string, start double, end double, probability double, speaker string")
    segments = spark.createDataFrame([("m", 0, 0.0, 6.0, "Redis up yes Redis")], "meeting_id string, segment_id int, start double, end double, text string")
    edits = spark.createDataFrame([("m", 0, 0, "red is", "Redis", True)], "meeting_id string, ordinal int, segment_id int, original string, replacement string, accepted boolean")
    got = naming.speaker_utterances(segments, words, edits).orderBy("utt_idx").collect()
    assert [(r.speaker, r.text, r.start, r.end) for r in got] == [("A", "Redis up", 0.0, 2.5), ("B", "yes Redis", 3.0, 5.5)]


def ground(spark, utterances, names, actions, decisions=()):
    d = spark.createDataFrame(list(decisions) or [("m", 0, "none", "")], "meeting_id string, ordinal int, statement string, evidence string")
    a = spark.createDataFrame(actions, "meeting_id string, ordinal int, task string, owner string, deadline string, evidence string")
    segments = utterances.select("meeting_id", "segment_id", "start", "end", "text")
    return grounding.ground(d, a, segments, utterances, names)


def test_owners_deadlines_and_drops(spark, utterances, names):
    yes = "Yes, I'll take the Grafana dashboard update this week."
    decisions, actions = ground(
        spark, utterances, names,
        [
            ("m", 0, "Update the Grafana dashboard", "Speaker 2", "this week", yes),  # a voice that committed
            ("m", 1, "Document the rollback plan", "Speaker 3", "Monday", "We should document the rollback plan soon."),  # no commitment
            ("m", 2, "Review the incident report", "Speaker 1", None, "Priya, could you review the incident report tomorrow?"),  # asked by name
            ("m", 3, "Update the Grafana dashboard", "Arjun", None, yes),  # named nowhere near
            ("m", 4, "Build a rocket", None, None, "We will build a huge rocket together"),  # no evidence
            ("m", 5, "Update Grafana", "Sam", None, yes),  # named in the segment before
        ],
        [("m", 0, "The billing service moved to Postgres", "moved the billing service to Postgres"), ("m", 1, "Document the rollback plan", "Do that."), ("m", 2, "Invent things", "Do that.")],
    )
    d = {r.ordinal: r for r in decisions.collect()}
    assert [d[i].status for i in range(3)] == ["kept", "kept", "dropped"] and d[0].segment_id == 2 and d[1].segment_id == 4
    assert "short quote 'Do that.' found verbatim at 0:20" in d[1].context_note
    a = {r.ordinal: r for r in actions.collect()}
    assert (a[0].owner, a[0].owner_source, a[0].deadline) == ("Speaker 2", "speaker", "this week")
    assert a[1].owner is None and "not as a first-person commitment" in a[1].owner_note and a[1].deadline is None and "never stated" in a[1].deadline_note
    assert (a[2].owner, a[2].owner_source) == ("Priya", "stated")
    assert a[3].owner is None and "is not named near the evidence" in a[3].owner_note
    assert a[4].status == "dropped" and "no supporting quote found" in a[4].drop_reason
    assert (a[5].owner, a[5].owner_source) == ("Sam", "stated")
    bound = {r.ordinal: r for r in naming.attribute_owners(actions, names["name_bindings"]).collect()}
    assert (bound[0].owner, bound[0].owner_source, bound[0].owner_label) == ("Sam", "inferred", "Speaker 2")
    warnings = grounding.record_warnings(decisions, actions).first().warnings
    assert warnings[0].startswith("2 generated item(s)") and warnings[1].startswith("3 owner/deadline value(s)")


def test_split_quote_is_anchored_where_more_of_it_stands(spark):
    segments = spark.createDataFrame([("m", 0, "we agreed that the quarterly"), ("m", 1, "budget review moves after launch"), ("m", 2, "nothing here")], "meeting_id string, seg_idx int, text string")
    quotes = spark.createDataFrame([("m", 0, "quarterly budget review moves"), ("m", 1, "entirely different words here"), ("m", 2, "budget review")], "meeting_id string, quote_id int, quote string")
    got = {r.quote_id: r for r in grounding.ground_quotes(quotes, segments).collect()}
    assert (got[0].status, got[0].seg_idx, got[0].score) == ("supported", 1, 1.0)
    assert got[1].status == "dropped" and got[2].status == "dropped"


def test_merging_is_a_fold(spark):
    rows = spark.createDataFrame([("m", 0, "Update the Grafana dashboard", "Sam", None), ("m", 1, "Take ownership of the Grafana dashboard", "sam", "Friday"), ("m", 2, "Update the Grafana dashboard", None, None), ("m", 3, "Write release notes", "Sam", None)], "meeting_id string, claim_id int, task string, owner string, deadline string")
    got = {r.claim_id: (r.merged_into, r.deadline) for r in grounding.merge_tasks(rows).collect()}
    assert got == {0: (1, None), 1: (None, "Friday"), 2: (None, None), 3: (None, None)}

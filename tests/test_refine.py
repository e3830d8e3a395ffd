import pytest

from parlance.operators import refine, segmentation

TEXT = "we deployed it on cooper netties and the sequel store not 5 times"


@pytest.fixture(scope="module")
def meeting(spark):
    segments = spark.createDataFrame([("m", 0, 0.0, 10.0, TEXT, -0.2), ("m", 1, 10.0, 12.0, "all fine.", -1.5)], "meeting_id string, segment_id int, start double, end double, text string, avg_logprob double")
    words = [("m", 0, i, w, i * 0.5, i * 0.5 + 0.4, 0.3 if w in ("cooper", "netties", "sequel") else 0.9, None) for i, w in enumerate(TEXT.split())]
    words += [("m", 1, i, w, 10 + i * 0.5, 10.4 + i * 0.5, 0.95, None) for i, w in enumerate("all fine.".split())]
    return segments, spark.createDataFrame(words, "meeting_id string, segment_id int, word_idx int, word string, start double, end double, probability double, speaker string")


def judge(spark, meeting, *edits):
    rows = [("m", i, *e) for i, e in enumerate(edits)]
    frame = spark.createDataFrame(rows, "meeting_id string, ordinal int, segment_id int, original string, replacement string, confidence double, source string")
    return {r.ordinal: r for r in refine.verify(frame, *meeting, refine.glossary_of(spark)).collect()}


def test_glossary_path(spark, meeting):
    refined, edits = refine.refine(*meeting, refine.glossary_of(spark))
    got = {(e.original, e.replacement): e.accepted for e in edits.collect()}
    assert got[("cooper netties", "Kubernetes")] and got[("sequel", "SQL")]
    texts = {r.segment_id: r.text for r in refined.collect()}
    assert texts == {0: TEXT.replace("cooper netties", "Kubernetes").replace("sequel", "SQL"), 1: "all fine."}


def test_gates_both_sides(spark, meeting):
    got = judge(
        spark, meeting,
        (0, "cooper netties", "Kubernetes", 1.0, "glossary"),  # 0 passes
        (0, "absent words", "Kubernetes", 1.0, "glossary"),  # 1 anchor
        (0, "sequel", "Sequel!", 0.9, "llm"),  # 2 no-op
        (0, "", "Kubernetes", 0.9, "llm"),  # 3 insertion
        (0, "sequel", "", 0.9, "llm"),  # 4 deletion
        (0, "sequel", "will", 0.9, "llm"),  # 5 sound, ordinary
        (0, "sequel", "seekwell", 0.5, "llm"),  # 6 low confidence, not in the glossary
        (0, "sequel", "seekwell", 0.9, "llm"),  # 7 passes without glossary
        (0, "we deployed it on cooper netties", "Kubernetes", 1.0, "glossary"),  # 8 span
        (0, "sequel", "sql 5", 0.9, "llm"),  # 9 digits
        (0, "not", "knot", 0.9, "llm"),  # 10 negation, confident
        (7, "x", "y", 0.9, "llm"),  # 11 unknown segment
    )
    has = lambda i, text: any(text in r for r in got[i].rejections)
    assert got[0].accepted and got[0].glossary_backed and got[7].accepted and not got[7].glossary_backed
    assert has(1, "does not occur in segment 0") and has(2, "in case or marks only") and has(3, "an insertion") and has(4, "a deletion of more")
    assert has(5, "'sequel' does not sound like 'will'") and has(5, "consists of common words")
    assert has(6, "confidence 0.50 only") and has(8, "the original has 6 words, over 5") and has(9, "the numbers differ")
    assert has(10, "negation") and has(10, "confidence 0.90 or more") and got[11].rejections == ["there is no segment 7"]


def test_budget_keeps_the_first(spark):
    edits = spark.createDataFrame([("m", i, i != 1, []) for i in range(9)], "meeting_id string, ordinal int, accepted boolean, rejections array<string>")
    counts = spark.createDataFrame([("m", 100)], "meeting_id string, total_words int")
    got = {r.ordinal: (r.accepted, r.rejections) for r in refine.apply_budget(edits, counts).collect()}
    assert [i for i in got if got[i][0]] == [0, 2, 3, 4, 5]
    assert got[6][1] == ["over the meeting's budget: 8 edits passed, 5 are allowed for 100 words"] and got[1][1] == []


def test_edits_fold_in_order_on_whole_words(spark):
    segments = spark.createDataFrame([("m", 0, "red is colored island, red is. (a+b) the the")], "meeting_id string, segment_id int, text string")
    edits = spark.createDataFrame([("m", 0, 0, "red is", "Redis $1", True), ("m", 1, 0, "Redis", r"R\2", True), ("m", 2, 0, "(a+b)", "c", True), ("m", 3, 0, "the the", "", True), ("m", 4, 0, "island", "x", False)], "meeting_id string, ordinal int, segment_id int, original string, replacement string, accepted boolean")
    assert refine.apply_edits(segments, edits).first().text == "R\\2 $1 colored island, R\\2 $1. c the"


def test_veto_and_model_edits(spark, meeting):
    verdicts = spark.createDataFrame([("m", 0, 0, True, ""), ("m", 1, 0, False, "a colour"), ("m", 2, 9, False, "")], "meeting_id string, ordinal int, index int, keep boolean, why string")
    model = spark.createDataFrame([("m", 0, 0, "sequel", "SQL", "", 0.9, "llm"), ("m", 1, 0, "cooper netties", "Kubernetes", "", 0.9, "llm")], "meeting_id string, ordinal int, segment_id int, original string, replacement string, reason string, confidence double, source string")
    _, edits = refine.refine(*meeting, refine.glossary_of(spark), verdicts, model)
    rows = edits.collect()
    vetoed = [r for r in rows if r.vetoed]
    assert len(vetoed) == 1 and vetoed[0].rejections == ["refused in context: a colour"] and not vetoed[0].accepted
    assert sum(r.source == "llm" for r in rows) == 1  # the other original is proposed already


def test_ngrams_do_not_cross_sentences(spark):
    words = spark.createDataFrame([("m", 0, i, w, 0.0, 0.1, 0.3, None) for i, w in enumerate(["stage", "inn.", "Okay,"])], "meeting_id string, segment_id int, word_idx int, word string, start double, end double, probability double, speaker string")
    assert sorted(r.phrase for r in segmentation.low_confidence_ngrams(words).collect()) == ["Okay,", "inn.", "stage", "stage inn."]


def test_assembly_warnings(spark, meeting):
    row = segmentation.assemble(meeting[0]).first()
    assert row.text == TEXT + " all fine." and row.low_confidence_segment_ids == [1] and not row.is_empty
    assert row.warnings == ["1 segment(s) were transcribed with low confidence."]


def test_injected_errors(spark, meeting):
    out, words = segmentation.inject_errors(meeting[0], {"store": "stow"})
    assert out.where("segment_id = 0").first().applied[0].term == "store"
    assert {r.word: r.probability for r in words.where("segment_id = 0").collect()}["stow"] == 0.35

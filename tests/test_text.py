import random

from parlance.functions import phonetic
from parlance.functions import text as T
from parlance.functions.phonetic import double_metaphone, phrase_codes
from pyspark.sql import functions as F


def one(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in rows.select(column(F.col("x"))).collect()]


def test_normalize_and_tokens(spark):
    assert one(spark, T.normalize, "  Café—über\t the  REST_API! ", "", None) == ["café über the rest_api", "", None]
    assert one(spark, T.tokens, "Don't, stop", "", None) == [["don", "t", "stop"], [], []]
    assert one(spark, T.content, "The map is on a new, new table") == [["map", "new", "new", "table"]]


def test_stems(spark):
    assert one(spark, T.stem, "lazily", "loading", "bed", "tables", "yes", "quickly", "moved") == ["lazy", "load", "bed", "tabl", "yes", "quick", "mov"]
    assert one(spark, T.stems, "loading loads loaded") == [["load"]]


def test_sentences_and_names(spark):
    assert one(spark, T.sentences, " One. Two?  Three! 1.5 ") == [["One.", "Two?", "Three!", "1.5"]]
    assert one(spark, T.vocative_candidates, "Sam, can you go?", "Can you go, Sam?", "No name") == [["Sam", ""], ["", "Sam"], ["", ""]]
    assert one(spark, T.is_request, "Is it?", "could you go.", "Please go.", "I go.") == [True, True, True, False]
    assert one(spark, T.introductions, "Hi, I'm Arjun.", "This is Priya.", "this is Jenkins running", "My name is Bo") == [["Arjun"], ["Priya"], [], []]
    assert one(spark, T.opens_reply, "Yes, I will", "Yesterday", "on it") == [True, False, True]
    assert one(spark, T.first_person, "I'll do it", "Imagine", "that is mine") == [True, False, True]
    assert one(spark, T.speaker_label, " Speaker 12 said", "Speaker", "The Speaker 1") == ["Speaker 12", None, None]


def test_small_functions(spark):
    assert one(spark, T.clean_null, " TBD ", "-", "Sam ", "", None) == [None, None, "Sam", None, None]
    assert one(spark, T.numeric_content, "Two of 3, the 4th") == [["two", "3", "4th"]]
    assert one(spark, T.negations, "Don't, no NEVER", "notable") == [["dont", "never", "no"], []]
    assert one(spark, T.stutter, "the the", "the  The the", "the then") == [True, True, False]
    assert one(spark, T.declines, "We won't go", "Deferred to May", "We go") == [True, True, False]
    assert one(spark, T.quoted, "it", "it's", "a \"b\" c's") == ["'it'", '"it\'s"', "'a \"b\" c\\'s'"]
    assert one(spark, lambda x: T.clock(x.cast("double")), "59.9", "61", None) == ["0:59", "1:01", "0:00"]
    assert one(spark, T.token_estimate, "a b c", "") == [1203, 1200]


def test_json_recovery(spark):
    got = one(spark, lambda x: T.json_object(x, "a int"), '```json\n{"a": 1}\n```', 'so: {"a": 2} done', "nothing", "{broken", None)
    assert [r and r["a"] for r in got] == [1, 2, None, None, None]


def test_idea(spark):
    rows = spark.createDataFrame([("we will load orders lazily", "lazy loading orders"), ("nothing", "lazy loading"), ("x", "a b")], "t string, p string")
    assert [r[0] for r in rows.select(T.contains_idea(F.col("t"), F.col("p"))).collect()] == [True, False, False]


def test_double_metaphone_published_vectors():
    vectors = {
        "Smith": ("SM0", "XMT"), "Schmidt": ("XMT", "SMT"), "Thomas": ("TMS", ""), "Michael": ("MKL", "MXL"), "Xavier": ("SF", "SFR"),
        "Wagner": ("AKNR", "FKNR"), "Knight": ("NT", ""), "Arnow": ("ARN", "ARNF"), "laugh": ("LF", ""), "Filipowicz": ("FLPTS", "FLPFX"),
        "cabrillo": ("KPRL", "KPR"), "Accident": ("AKSTNT", ""), "edge": ("AJ", ""), "gallegos": ("KLKS", "KKS"), "sugar": ("XKR", "SKR"),
    }
    assert {w: double_metaphone(w) for w in vectors} == vectors


def test_wanted_codes_lose_no_phrase():
    rng, syllables = random.Random(5), ("spa", "rk", "se", "quel", "alle", "illo", "ch", "ía", "ña", "wr", "sql", "kna", "dg", "tion", "no.", "ó", "ucc", "x", "ph", "gh", "Red", "shift", "post", "gres", "é", "Ç", "w", "'s", "")
    terms = ("Spark", "SQL", "Redshift", "Postgres", "Snowflake", "gallego", "write-ahead log", "Kubernetes")
    wanted = phonetic.Wanted([c for t in terms for c in phonetic.phrase_codes(t)])
    hits = 0
    for _ in range(300):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(12)]
        unsure, ends = [rng.random() < 0.5 for _ in words], [w.endswith(".") for w in words]
        want = [(n, i, codes) for i in range(12) for n in range(1, 6) if i + n <= 12 and any(unsure[i : i + n]) and not any(ends[i : i + n - 1]) and not wanted.codes.isdisjoint(codes := phonetic.phrase_codes(" ".join(words[i : i + n])))]
        assert [(x["n"], x["i"], x["codes"]) for x in wanted.spans(words, unsure, ends, 5)] == want
        hits += len(want)
    assert hits > 50


def test_phrases_that_sound_alike():
    alike = lambda a, b: bool(set(phrase_codes(a)) & set(phrase_codes(b)))
    assert all(alike(a, b) for a, b in (("cooper netties", "Kubernetes"), ("post gres", "Postgres"), ("sequel", "SQL"), ("g r p c", "gRPC"), ("red is", "Redis")))
    assert not any(alike(a, b) for a, b in (("might", "will"), ("deadline", "headline"), ("stage inn", "staging"), ("", "")))

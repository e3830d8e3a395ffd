import json
import wave

import numpy as np
import pytest

from parlance.operators import refine, segmentation
from parlance.plans import meeting, models
from parlance.sinks import export
from parlance.sources import files


def test_readers(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"terms": [" SQL ", "", "Kafka", "SQL"]}))
    (tmp_path / "l.json").write_text(json.dumps(["Redis", "JWT"]))
    assert sorted(r.term for r in files.read_glossary(spark, str(tmp_path / "g.json")).collect()) == ["Kafka", "SQL"]
    assert sorted(r.term for r in files.read_glossary(spark, str(tmp_path / "l.json")).collect()) == ["JWT", "Redis"]
    (tmp_path / "x.rttm").write_text("SPEAKER f 1 0.5 2.0 <NA> <NA> Ann <NA> <NA>\nshort line\n\nOTHER f 1 0 1 a b c\n")
    assert [tuple(r)[2:] for r in files.read_rttm(spark, str(tmp_path / "x.rttm")).collect()] == [(0.5, 2.5, "Ann")]
    (tmp_path / "s.txt").write_text("# title\nAnn: We use {{Kubernetes|cooper netties}} and {{SQL|sequel}}.\nnot a line\n")
    row = files.read_marked_script(spark, str(tmp_path / "s.txt")).first()
    assert (row.speaker, row.text, row.spoken) == ("Ann", "We use Kubernetes and SQL.", "We use cooper netties and sequel.")
    assert [(v.meant, v.spoken) for v in row.variants] == [("Kubernetes", "cooper netties"), ("SQL", "sequel")]
    (tmp_path / "m.json").write_text(json.dumps({"language": "en", "segments": [{"id": 0, "start": 0, "end": 1, "text": "hi", "avg_logprob": -0.1, "words": [{"word": " hi", "start": 0, "end": 1, "probability": 0.9}]}]}))
    _, segments, words = files.read_transcripts(spark, str(tmp_path / "m.json"))
    assert segments.first().meeting_id == "m" and words.first().word == " hi"


def test_audio_cascade(spark, tmp_path):
    def tone(name, seconds, volume):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(16_000)
            w.writeframes((volume * np.sin(np.arange(int(seconds * 16_000)) / 5)).astype("<i2").tobytes())

    tone("tone.wav", 2, 9000)
    tone("short.wav", 0.5, 9000)
    tone("silent.wav", 2, 0)
    (tmp_path / "bad.wav").write_text("this is no sound")
    (tmp_path / "empty.wav").write_bytes(b"")
    got = {r.path.rpartition("/")[2]: r for r in files.read_audio(spark, str(tmp_path)).collect()}
    assert got["tone.wav"].duration == 2.0 and got["tone.wav"].warnings == [] and got["tone.wav"].method == "wave"
    assert "very short" in got["short.wav"].warnings[0] and "nearly silent" in got["silent.wav"].warnings[0]
    assert got["bad.wav"].error.startswith("wave: ") and got["empty.wav"].error == "the file is empty"


def test_replies(spark):
    good = '```json\n{"summary": " S ", "minutes": ["a", " "], "decisions": [{"statement": "D", "evidence": null}, {"statement": " "}], "action_items": [{"task": "T", "owner": "TBD", "deadline": "Friday"}]}\n```'
    rows = spark.createDataFrame([("a", good, None, "x"), ("b", "no json", None, "x"), ("c", None, "down", "w " * 1600)], "meeting_id string, reply string, error string, text string")
    records, decisions, actions = models.parse_records(rows)
    got = {r.meeting_id: r for r in records.collect()}
    assert got["a"].summary == "S" and got["a"].minutes == ["a"] and got["a"].warnings == []
    assert got["b"].warnings == ["The language model returned a malformed response."] and got["c"].warnings[0] == "Meeting-record model unavailable: down" and len(got["c"].warnings) == 2
    assert [(r.statement, r.evidence) for r in decisions.collect()] == [("D", "")]
    assert [(r.task, r.owner, r.deadline) for r in actions.collect()] == [("T", None, "Friday")]


def broken():
    def model(system, user):
        raise RuntimeError("out of reach")

    return model


def test_fallback_and_routing(spark):
    prompts = spark.createDataFrame([("a", "s", "u")], "meeting_id string, system string, user string")
    row = models.ask(prompts, broken, lambda: models.silent_model).first()
    assert row.reply == "{}" and row.fell_back and row.error == "out of reach"
    row = models.ask(prompts, broken).first()
    assert row.reply is None and row.error == "out of reach" and not row.fell_back
    texts = spark.createDataFrame([("a", "word " * 100), ("b", "word " * 3000), ("c", "word " * 20000)], "meeting_id string, text string")
    got = {r.meeting_id: r for r in models.route(texts).collect()}
    assert [got[k].backend for k in "abc"] == ["remote", "local", "local"] and got["b"].size_warning is None and "over the local context of 16,384" in got["c"].size_warning


REPLY = {"summary": "Work was shared out.", "minutes": ["The store was discussed."], "decisions": [{"statement": "Move the billing store to Postgres", "evidence": "we move the billing store to post gres"}], "action_items": [{"task": "Update the dashboard for Grafana", "owner": "Speaker 2", "deadline": "this week", "evidence": "Yes, I'll take the Grafana dashboard this week."}]}


def recorder():
    return models.ScriptedModel({"billing": REPLY})


@pytest.fixture(scope="module")
def inputs(spark):
    lines = ["Sam, can you update the Grafana dashboard?", "Yes, I'll take the Grafana dashboard this week.", "Good, and we move the billing store to post gres."]
    segments = spark.createDataFrame([("m", i, 10.0 * i, 10.0 * i + 6, t, -0.2) for i, t in enumerate(lines)], "meeting_id string, segment_id int, start double, end double, text string, avg_logprob double")
    words = [("m", i, k, w, 10.0 * i + 0.4 * k, 10.0 * i + 0.4 * k + 0.35, 0.3 if w in ("post", "gres.") else 0.95, None) for i, t in enumerate(lines) for k, w in enumerate(t.split())]
    words = spark.createDataFrame(words, "meeting_id string, segment_id int, word_idx int, word string, start double, end double, probability double, speaker string")
    voices = spark.createDataFrame([("m", 0, [1.0, 0.0]), ("m", 1, [0.0, 1.0]), ("m", 2, [1.0, 0.05])], "meeting_id string, chunk_idx int, embedding array<double>")
    return segments, words, voices


def test_whole_plan(spark, inputs, tmp_path):
    segments, words, voices = inputs
    result = meeting.MeetingPlan(segments, words, refine.glossary_of(spark), voices, recorder=recorder).run(export.keeper(str(tmp_path)))
    assert result.ok and [e for _, _, e in result.stage_log if e] == []
    t = result.tables
    assert [r.speaker for r in t["turns"].orderBy("turn_idx").collect()] == ["Speaker 1", "Speaker 2", "Speaker 1"]
    assert "to Postgres." in t["refined"].where("segment_id = 2").first().text
    action = t["action_items"].first()
    assert (action.owner, action.owner_source, action.owner_label, action.status) == ("Sam", "inferred", "Speaker 2", "kept")
    row = meeting.exports(result).first()
    record = json.loads(row.json)
    assert record["action_items"][0]["owner"] == "Sam" and record["decisions"][0]["segment_id"] == 2 and record["action_items"][0]["deadline"] == "this week"
    assert "| Update the dashboard for Grafana | Sam (inferred) | this week |" in row.markdown and "| post gres | Postgres |" in row.markdown
    assert "Speaker 2 identified as Sam" in row.markdown and "unspecified" not in row.markdown


def test_stages_degrade(spark, inputs, tmp_path):
    segments, words, _ = inputs
    keep = export.keeper(str(tmp_path))
    result = meeting.MeetingPlan(segments, words.drop("probability"), refine.glossary_of(spark), recorder=broken).run(keep)
    log = {name: error for name, _, error in result.stage_log}
    assert result.ok and log["refine"] and not log["record"]
    assert result.tables["refined"].count() == 3 and result.tables["records"].first().warnings == ["Meeting-record model unavailable: out of reach"]
    with pytest.raises(ValueError, match="speaker labels"):
        meeting.MeetingPlan(segments, words, refine.glossary_of(spark), diarize="on").run(keep)


def test_markdown_of_nothing(spark):
    records = spark.createDataFrame([("m", "", [], [], "x")], "meeting_id string, summary string, minutes array<string>, warnings array<string>, model string")
    none = spark.createDataFrame([], "meeting_id string, ordinal int, statement string, evidence string, status string, segment_id int, timestamp double")
    acts = spark.createDataFrame([], "meeting_id string, ordinal int, task string, owner string, deadline string, evidence string, segment_id int, timestamp double, owner_source string, owner_evidence string, owner_label string, status string")
    text = export.markdown(records, none, acts).first().markdown
    assert "_No minutes recorded._" in text and "_No decisions were reached._" in text and "_No action items were assigned._" in text
    assert json.loads(export.record_json(records, none, acts).first().json)["decisions"] == []


def test_embedding_of_chunks(spark, inputs):
    segments, words, _ = inputs
    chunks = segmentation.pause_chunks(words, segments)
    pcm = np.sin(np.arange(16_000 * 30) / 7).astype(np.float32).tobytes()
    audio = spark.createDataFrame([("m", bytearray(pcm))], "meeting_id string, pcm binary")
    got = models.embed_chunks(chunks, audio, lambda: models.tone_embedder).collect()
    assert len(got) == 3 and all(len(r.embedding) == 16 for r in got)


def loud_parts():
    def hear(samples):
        if not len(samples):
            raise ValueError("nothing to hear")
        return [{"start": 0.0, "end": len(samples) / 16_000, "text": "hello there", "avg_logprob": -0.2, "words": [{"word": "hello", "start": 0.0, "end": 0.4, "probability": 0.9}, {"word": "there", "start": 0.5, "end": 0.9, "probability": 0.4}]}]

    return hear


def test_transcriber(spark):
    audio = spark.createDataFrame([("a", bytearray(np.ones(16_000, np.float32).tobytes())), ("b", bytearray())], "meeting_id string, pcm binary")
    segments, words, errors = models.transcribe(audio, loud_parts)
    assert [tuple(r) for r in segments.collect()] == [("a", 0, 0.0, 1.0, "hello there", -0.2)]
    assert [(r.word_idx, r.word, r.probability) for r in words.orderBy("word_idx").collect()] == [(0, "hello", 0.9), (1, "there", 0.4)]
    assert [tuple(r) for r in errors.collect()] == [("b", "nothing to hear")]
    assert models.available(loud_parts) and not models.available(lambda: broken()("", ""))


def test_long_meetings_in_windows(spark):
    rows = spark.createDataFrame([("m", i, 400.0 * i, str(i)) for i in range(5)], "meeting_id string, utt_idx int, start double, text string")
    got = meeting.windowed(rows).orderBy("start").collect()
    assert [r.meeting_id for r in got] == ["m#0", "m#0", "m#0", "m#1", "m#1"] and [r.utt_idx for r in got] == [0, 1, 2, 0, 1]


def test_results_do_not_depend_on_partitions(spark, inputs):
    segments, words, _ = inputs
    one = refine.refine(segments, words, refine.glossary_of(spark))[0].orderBy("segment_id").collect()
    two = refine.refine(segments.repartition(3), words.repartition(7), refine.glossary_of(spark))[0].orderBy("segment_id").collect()
    assert one == two

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import language_id, quality_classifier, quality_rules, queries
from parlance.llm.samples import fold

ODD = ["", None, " \n ", "\n", "a", "a\n\na\n", "x y z\nx y z\n", "x\nx", "\nb\nb\n b", "a b c a b c d", "é é # é|", "漢字 漢字", "w " * 5000, "x" * 30_000]


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def synthetic(seed, n):
    rng = random.Random(seed)
    texts, quality = [], []
    for _ in range(n):
        words = ["".join(rng.choices("etaoinsr", k=rng.randint(2, 8))) for _ in range(rng.randint(60, 120))]
        good = rng.random() < 0.7
        if not good:
            words = [w + rng.choice(["###", "$$$", "&&&"]) for w in words] if rng.random() < 0.5 else [w.upper() + "!!" for w in words]
        texts.append(" ".join(words))
        quality.append(int(good))
    return texts, quality


def test_counts_equal_brute_force():
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choices("ab \n#", k=rng.randint(0, 60))) for _ in range(300)]
    got = quality_rules.counts(*quality_rules._prepare(pa.array(texts, pa.string())))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[n][i]) for n in names) for i in range(len(texts))] == [brute_counts(t) for t in texts]


@pytest.fixture(scope="module")
def labelled(spark):
    texts, quality = synthetic(1, 400)
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in enumerate([*texts, *ODD])], "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality)] + [(3, None, 0), (5, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, quality


def test_rules(labelled):
    docs, labels, quality = labelled
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs.repartition(3), labels).collect()}
    assert len(rows) == docs.count()
    held = [i for i in range(400) if rows[i].n_words >= 50]
    assert sum(rows[i].kept == bool(quality[i]) for i in held) >= 0.95 * len(held)
    assert all(rows[400 + k].base_failed and not rows[400 + k].kept for k in range(len(ODD)))


def test_classifier(labelled):
    docs, labels, quality = labelled
    rows = {r.doc_id: r for r in quality_classifier.quality_scores(docs.repartition(3), labels).collect()}
    held = [i for i in range(400) if rows[i].held_out]
    assert 50 < len(held) < 110 and sum(rows[i].predicted == quality[i] for i in held) >= 0.95 * len(held)
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    kept = quality_classifier.score(docs.limit(2), quality_classifier.learn(docs, labels)).columns
    assert kept == ["doc_id", "text", "score", "predicted"]


def test_without_labels_or_rows(spark, labelled):
    docs, labels, _ = labelled
    none = labels.where("false")
    assert all(r.score == pytest.approx(0.5) for r in quality_classifier.quality_scores(docs, none).collect())
    assert quality_classifier.quality_scores(docs.where("false"), labels).count() == 0
    assert quality_rules.quality_rules(docs.where("false"), none).count() == 0


LANGS = {"aa": "abcd", "bb": "cdef", "cc": "éüßô"}


def test_languages(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(LANGS))
        text = " ".join("".join(rng.choices(LANGS[lang], k=rng.randint(2, 7))) for _ in range(rng.randint(5, 60)))
        rows.append((i, text.upper() if i % 9 == 0 else text, None if i % 11 == 0 else lang, lang, "z"))
    frame = spark.createDataFrame(rows + [(1000 + k, t, "aa", "aa", None) for k, t in enumerate(ODD)], "doc_id long, text string, lang string, truth string, lang_pred string")
    got = {r.doc_id: r for r in language_id.language_id(frame.repartition(3)).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 50 and sum(got[r[0]].lang_pred == r[3] for r in held) >= 0.97 * len(held)
    assert [got[1000 + k].lang_pred for k in range(4)] == ["und"] * 4 and got[1000].score == 0.0 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.language_id(frame.where("lang is null")).collect()} == {"und"}
    assert language_id.language_id(frame.where("false")).count() == 0


def test_phrases_equal_a_plain_parse():
    rng = random.Random(3)
    samples = {"p": ["".join(rng.choices("abc ", k=300))], "q": ["".join(rng.choices("bcdé ", k=300))]}
    model = language_id.learn_model(samples)
    texts = ["".join(rng.choices("abcdé漢 1", k=rng.randint(0, 60))) for _ in range(200)] + ["ab c" * 900, "x" * 700, "", None]
    symbols, bounds, _ = language_id.symbols_of(pa.array(texts, pa.string()))
    spoken = [" " + " ".join(re.findall(r"[^\W\d_]+", t or "")) for t in texts]
    assert [symbols[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [s if s != " " else "" for s in spoken]

    def plain(text, learned):
        n, at = 0, 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[at : end + 1] in learned:
                end += 1
            n, at = n + 1, end
        return n

    learned = {k: language_id.symbols_of(pa.array(v))[0].tobytes() for k, v in samples.items()}
    want = [[plain(symbols[a:b].tobytes(), learned[k]) for k in "pq"] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for lane in (1, 5, 64, 256):
        assert language_id.phrases(model.symbols[symbols], bounds, model, lane).tolist() == want


def test_what_a_letter_is():
    model = language_id.learn_model({"aa": ["some words of it"]})
    names, scores = language_id.predict(pa.array(["½ ²", None, "", "12 _ ?", "\u0301", "é", "1a", "漢"]), model)
    assert names == ["und"] * 5 + ["aa"] * 3 and scores.tolist() == [0.0] * 5 + [1.0] * 3


def test_every_language_is_learned():
    model = language_id.learn_model({f"l{i:03d}": [chr(0x4E00 + i) * 40] for i in range(300)}, total=12_000)
    assert len(model.names) == 300 and language_id.predict(pa.array([chr(0x4E00 + 299) * 9]), model)[0] == ["l299"]


def test_character_windows_are_of_characters():
    texts = ["abcd", "é漢字x é漢字x", "", None, "abc", "abcdabcd"]
    data, offsets, _, _, first, words = quality_rules._prepare(pa.array(texts, pa.string()))
    (grams, bounds), _, (pairs, pair_bounds) = quality_rules.features(data, offsets, first, words)
    assert (bounds[1] - bounds[0]).tolist() == [max(0, len(t or "") - 3) for t in texts] and (pair_bounds[1] - pair_bounds[0]).tolist() == [0, 1, 0, 0, 0, 0]
    own = [grams[a:b].tolist() for a, b in bounds.T]
    assert own[5][0] == own[5][4] == own[0][0] and own[1][0] == own[1][5] and len(set(own[1])) == 5


def test_rules_score_is_the_sum_of_shares():
    texts, quality = synthetic(5, 60)
    texts += [t or "" for t in ODD]
    data, offsets, _, _, first, words = quality_rules._prepare(pa.array(texts))
    parts = quality_rules.features(data, offsets, first, words)
    rows = quality_rules.shares(parts)
    model = quality_rules.fit(rows[:60], np.array(quality), rounds=20)
    table = np.concatenate([model.chars_w, model.words_w])
    want = [quality_rules.SCALE * float((table[i].astype(float) * v).sum()) + model.bias for i, v in rows]
    assert np.allclose(quality_rules._means(parts, model), want, atol=1e-3)


def test_fits_of_few_or_one_sided_rows():
    rows = quality_rules.shares(quality_rules.features(*(lambda p: (p[0], p[1], p[4], p[5]))(quality_rules._prepare(pa.array(["a b c d", "e f g h", "a a a a"])))))
    for labels in ([1, 1, 1], [0, 0, 0], [1, 0, 1], [0, 1, 0]):
        assert np.isfinite(quality_rules.fit(rows, np.array(labels), rounds=5).bias)
        net = quality_classifier.fit(np.eye(3), np.array(labels), rounds=20)
        assert ((0 <= net.score(np.eye(3))) & (net.score(np.eye(3)) <= 1)).all()
    assert quality_rules.fit([], np.zeros(0, np.int64)).bias == 4.0 and quality_classifier.fit(np.zeros((0, 3)), np.zeros(0, np.int64)).score(np.zeros((1, 3)))[0] == 0.5


def test_vectors_do_not_depend_on_parts():
    texts = synthetic(7, 40)[0]
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array(t)], ["text"])
    one, two = quality_classifier.learn_vectors(iter([batch(texts)])), quality_classifier.learn_vectors(iter([batch(texts[30:]), batch(texts[:7]), batch(texts[7:30])]))
    assert all((getattr(one, n) == getattr(two, n)).all() for n in ("tags", "words", "forms"))


def held_out_rows(spark, query, of, is_held):
    """Rows of the test data that a model did not learn from, with labels: (text, quality or lang, row of the result)."""
    import zlib

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in query(spark, SF).collect()}
    assert set(rows) == set(docs)
    held = [i for i in docs if zlib.crc32(str(i).encode()) % of == is_held]
    return docs, quality, rows, held


SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_of_languages(spark):
    docs, _, rows, held = held_out_rows(spark, queries.op3_language_id, 3, 1)
    assert [i for i in rows if rows[i].held_out] == [i for i in rows if i in set(held)]
    right = [rows[i].lang_pred == docs[i].lang for i in held if docs[i].lang is not None and rows[i].lang_pred != "und"]
    assert sum(right) >= 0.98 * len(right) > 200


def test_held_out_accuracy_of_the_classifier(spark):
    _, quality, rows, held = held_out_rows(spark, queries.op8_quality_classifier, 5, 0)
    known = [i for i in held if quality.get(i) is not None]
    assert all(rows[i].held_out for i in known)
    assert sum(rows[i].predicted == quality[i] for i in known) >= 0.95 * len(known) > 50


def test_held_out_accuracy_of_the_rules(spark):
    _, quality, rows, held = held_out_rows(spark, queries.op9_quality_rules, 5, 0)
    known = [i for i in held if quality.get(i) is not None and not rows[i].base_failed]
    good = [i for i in known if quality[i] == 1]
    assert sum(rows[i].kept == bool(quality[i]) for i in known) >= 0.93 * len(known) > 40 and sum(rows[i].kept for i in good) >= 0.97 * len(good)


def test_accepted_keeps_columns_of_any_name(labelled):
    docs, labels, quality = labelled
    out = quality_classifier.accepted(docs, quality_classifier.learn(docs, labels))
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert {r.score for r in rows.values()} == {"x"} and {r.predicted for r in rows.values()} == {9}
    assert sum((i in rows) == bool(q) for i, q in enumerate(quality)) >= 0.95 * len(quality)


def test_folds(spark):
    import zlib

    rows = spark.range(50).withColumn("f", fold(F.col("id"), 5)).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_temperature_only_scales():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    net = quality_classifier.fit(x, (x[:, 0] + rng.normal(size=300) > 0).astype(int), rounds=60)
    assert 0.25 <= net.temperature <= 8 and ((net.score(x) >= 0.5) == (net.logits(x) >= 0)).all()

"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from parlance.llm.queries import ORACLES, QUERIES

from .test_dedup import WORD, brute_classes

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "substring_dedup", "source_mixing", "packing"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = source, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == source.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.orderBy("doc_id").collect())
    first, deduped, cut, mixed, packed = seen

    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in first}
    right = [(i in kept) == bool(q) for i, q in quality.items() if q is not None]
    assert sum(right) >= 0.95 * len(right), (sum(right), len(right))

    classes = brute_classes([r.text for r in first], 5, 80)
    assert [r.doc_id for r in deduped] == [r.doc_id for i, r in enumerate(first) if classes[i][1] == i]

    window, owner = corpus_pipeline.WINDOW, {}
    for before, after in zip(deduped, cut, strict=True):
        words = WORD.findall(before.text)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if owner.setdefault(tuple(words[i : i + window]), before.doc_id) < before.doc_id:
                gone[i : i + window] = [True] * window
        assert WORD.findall(after.text) == [w for w, g in zip(words, gone, strict=True) if not g] and after.n_chars == len(after.text)

    times, size = Counter(), {r.doc_id: len(WORD.findall(r.text)) for r in cut}
    for r in mixed:
        times[r.doc_id] += len(WORD.findall(r.text))
    assert all(n <= 3 * size[i] for i, n in times.items()) and abs(sum(times.values()) - sum(size.values())) <= 20

    places = Counter()
    for r in packed:
        places[r.sequence_id] += r.length
    assert max(places.values()) <= 1024 and {r.doc_id for r in packed} == set(times)


LONG = " ".join(f"word{k % 977}x{k % 31}" for k in range(30_000))
ROWS = [
    (1, "a plain text of some words " * 12, "s1", "one"), (1, "a plain text of some words " * 12, "s1", "one"), (2, "a plain text of some words " * 12, "s2", "two"),
    (None, "a text that has no number of its own", "s1", "none"), (None, None, None, "none"), (3, None, "s2", "null"), (4, "", "s2", "empty"), (5, " \n\t ", None, "blank"), (6, LONG, "s3", "long"), (7, LONG + " end", "s3", "near"),
]
SCHEMA = "doc_id long, text string, source string, predicted string, score double, component_id string, lang string, n_chars long, size int, _slice string, sd__id2 int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, repeated rows, a very long text, and columns named like those of results."""
    return spark.createDataFrame([(i, t, s, note, 0.5, "c", "en", len(t or ""), 1, "0", 2) for i, t, s, note in ROWS], SCHEMA).repartition(3)


def notes(rows):
    return Counter(r.predicted for r in rows.collect())


def test_classifier_stage_on_odd_rows(spark, odd):
    out = corpus_pipeline.classify(spark, odd, SF)
    assert out.schema.names == odd.schema.names and notes(out) <= notes(odd) and notes(out)["one"] in (0, 2)
    assert corpus_pipeline.classify(spark, odd.where("false"), SF).count() == 0


def test_near_dedup_stage_on_odd_rows(spark, odd):
    out = corpus_pipeline.near_dedup(spark, odd, SF)
    assert out.schema.names == odd.schema.names and notes(out) == notes(odd) - Counter(two=1, near=1)
    assert corpus_pipeline.near_dedup(spark, odd.where("false"), SF).count() == 0


def test_substring_stage_on_odd_rows(spark, odd):
    out = corpus_pipeline.substring_dedup(spark, odd, SF)
    texts = {(r.doc_id, r.predicted): r.text for r in out.collect()}
    assert out.schema.names == odd.schema.names and notes(out) == notes(odd)
    assert texts[2, "two"] == "" and texts[1, "one"] == ROWS[0][1] and texts[None, "none"] in (None, ROWS[3][1]) and texts[7, "near"] == "end" and texts[3, "null"] is None
    assert corpus_pipeline.substring_dedup(spark, odd.where("false"), SF).count() == 0


def test_mix_stage_on_odd_rows(spark, odd):
    out = corpus_pipeline.mix(spark, odd, SF)
    n = notes(out)
    assert out.schema.names == odd.schema.names and not n["null"] + n["empty"] + n["blank"] and all(v <= 3 * notes(odd)[k] for k, v in n.items()) and n["none"] >= 1
    assert corpus_pipeline.mix(spark, odd.where("false"), SF).count() == 0


def test_pack_stage_on_odd_rows(spark, odd):
    rows = corpus_pipeline.pack(spark, odd, SF).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(i for i, *_ in ROWS) and max(r.offset + r.length for r in rows) <= 1024
    assert corpus_pipeline.pack(spark, odd.where("false"), SF).count() == 0


def test_registry():
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} == {n if n == "pipeline" else n.split("_")[0] for n in QUERIES} and set(ORACLES) <= set(QUERIES)

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.operators import cluster, metrics, segmentation
from parlance.plans.models import tone_embedder


def brute_linkage(x, threshold):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        d, a, b = min((np.mean([1 - x[i] @ x[j] for i in g for j in h]), m, n) for m, g in enumerate(groups) for n, h in enumerate(groups) if m < n)
        if d > threshold:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(6))
def test_linkage_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.4, (7, 12)) for c in rng.normal(0, 1, (3, 12))])
    for t in (0.1, 0.4, 0.8):
        labels = cluster.average_linkage(x, t)
        assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist())} == brute_linkage(x, t)
    assert len(set(cluster.average_linkage(x, None, 2).tolist())) == 2 and cluster.average_linkage(x[:1]).tolist() == [0]


@pytest.mark.parametrize("seed", range(3))
def test_large_groups_by_parts(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.2, (15, 16)) for c in rng.normal(0, 1, (5, 16))])
    x = x[rng.permutation(len(x))]
    for t in (0.05, 0.2, 0.4):
        assert (cluster.linked(x, t, limit=40) == cluster.average_linkage(x, t)).all()
        parts = cluster.apart(x, t)
        assert sorted(np.concatenate(parts).tolist()) == list(range(len(x)))
    assert np.isnan(cluster.linked(x, 2.0, limit=40)).all() and np.isnan(cluster.linked(x, None, 3, limit=40)).all()


def test_nearest_other(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    label = [k % 3 if k < 57 else None if k == 57 else 7 if k == 58 else 0 for k in range(60)]
    frame = spark.createDataFrame([(k, label[k], None if k == 59 else x[k].tolist()) for k in range(60)], "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.label, r.nearest, r.n) for r in cluster.nearest_other(frame, ["label"], "vec_id", block=7).collect()}
    assert set(got) == set(range(57))  # no label, no other of the label, no vector
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k, (own, nearest, n) in got.items():
        others = [j for j in range(57) if label[j] == own and j != k]
        assert n == len(others) and abs(nearest - min(1 - u[k] @ u[j] for j in others)) < 1e-12


def test_labels_of_chunks(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    rows = [("m", 0, 0.0, 1.0, "tiny", None), ("m", 1, 1.0, 2.0, "long", b), ("m", 2, 2.0, 3.0, "long", a), ("m", 3, 3.0, 3.4, "short", [0.9, 0.1, 0.0]), ("m", 4, 4.0, 4.1, "tiny", None), ("m", 5, 5.0, 6.0, "long", b), ("s", 0, 0.0, 0.3, "short", a)]
    frame = spark.createDataFrame(rows, "meeting_id string, chunk_idx int, start double, end double, kind string, embedding array<double>")
    got = {(r.meeting_id, r.chunk_idx): (r.speaker, r.less_reliable) for r in cluster.label_chunks(frame).collect()}
    assert [got["m", i][0] for i in range(6)] == ["Speaker 1", "Speaker 1", "Speaker 2", "Speaker 2", "Speaker 2", "Speaker 1"]
    assert got["s", 0] == ("Speaker 1", True) and not got["m", 0][1]


def test_pauses_split_within_segments(spark):
    words = spark.createDataFrame([("m", s, i, f"w{s}{i}", a, e, 0.9, None) for s, i, a, e in [(0, 0, 0.0, 0.3), (0, 1, 0.35, 0.6), (0, 2, 0.89, 1.2), (0, 3, 1.51, 1.8), (1, 0, 1.81, 2.0)]], "meeting_id string, segment_id int, word_idx int, word string, start double, end double, probability double, speaker string")
    segments = spark.createDataFrame([("m", 0, 0.0, 1.8, "x"), ("m", 1, 1.8, 2.0, "y"), ("m", 2, 3.0, 3.7, " z ")], "meeting_id string, segment_id int, start double, end double, text string")
    got = segmentation.pause_chunks(words, segments).orderBy("chunk_idx").collect()
    assert [(r.text, r.whole_segment, r.kind) for r in got] == [("w00 w01 w02", None, "long"), ("w03", None, "short"), ("w10", None, "tiny"), ("z", 2, "long")]


def words_cost(ref, hyp):
    table = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i, r in enumerate(ref, 1):
        for j, h in enumerate(hyp, 1):
            table[i][j] = table[i - 1][j - 1] if r == h else 1 + min(table[i - 1][j - 1], table[i - 1][j], table[i][j - 1])
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_alignment_identities(ref, hyp):
    s, d, i = metrics.align(ref, hyp)
    assert s + d + i == words_cost(ref, hyp) <= max(len(ref), len(hyp))
    assert len(ref) - d + i == len(hyp) and min(s, d, i) >= 0
    s2, d2, i2 = metrics.align(hyp, ref)
    assert s2 + d2 + i2 == s + d + i and i2 - d2 == d - i


def test_wer_rows(spark):
    rows = spark.createDataFrame([("The cat, sat", "the cat sat down"), ("a b c", "a c"), ("", "x"), ("a b", "c d")], "reference string, hypothesis string")
    assert [(round(r.wer, 3), r.substitutions, r.deletions, r.insertions) for r in metrics.wer(rows).collect()] == [(0.333, 0, 0, 1), (0.333, 0, 1, 0), (0.0, 0, 0, 1), (1.0, 2, 0, 0)]


def turns(spark, rows):
    return spark.createDataFrame([("m", i, float(a), float(b), s) for i, (a, b, s) in enumerate(rows)], "meeting_id string, ordinal int, start double, end double, speaker string")


def test_der(spark):
    ref = turns(spark, [(0, 5, "A"), (5, 10, "B"), (10, 12, "C")])
    same = turns(spark, [(0, 5, "x"), (5, 10, "y"), (10, 12, "z")])
    assert metrics.der(ref, same).first().der == 0.0  # labels may be permuted
    one = metrics.der(ref, turns(spark, [(0, 5, "y"), (5, 12, "x")]), collar=0.0).first()
    assert (round(one.confusion, 2), round(one.missed, 2), round(one.total, 2)) == (2.0, 0.0, 12.0)  # C has no voice of its own
    gap = metrics.der(ref, turns(spark, [(0, 4, "x"), (5, 10, "y"), (10, 13, "z")]), collar=0.0).first()
    assert (round(gap.missed, 2), round(gap.false_alarm, 2)) == (1.0, 1.0)


def test_assignment_pads_to_a_square():
    assert metrics.assign(np.array([[1.0], [9.0], [2.0]])) == {0: 1}
    assert metrics.assign(np.eye(9)) == {i: i for i in range(9)}


def test_interval_overlap_counts_each_pair_once(spark):
    a = spark.createDataFrame([("k", 1, 0.0, 30.0), ("k", 2, 5.0, 6.0)], "k string, id int, start double, end double")
    b = spark.createDataFrame([("k", 7, 4.0, 25.0), ("k", 8, 30.0, 31.0)], "k string, id int, start double, end double")
    got = sorted(tuple(r) for r in metrics.interval_overlap(a, b, ["k"], 10.0).collect())
    assert got == [("k", 1, 7, 21.0), ("k", 2, 7, 1.0)]


def test_plateau_and_recovery(spark):
    scores = spark.createDataFrame([(0.3, 0.2), (0.5, 0.081), (0.6, 0.08), (0.7, 0.082), (0.9, 0.3)], "threshold double, der double")
    assert cluster.plateau_centre(scores).first().threshold == 0.6
    rows = spark.createDataFrame([("m", "SQL", True), ("m", "Kafka", False), ("m", "Redis", True)], "meeting_id string, term string, occurred boolean")
    refined = spark.createDataFrame([("m", "we use sql")], "meeting_id string, text string")
    assert tuple(metrics.recovery(rows, refined).first()) == ("m", 3, 2, 1)


def test_tones_lie_apart():
    t = np.arange(16_000) / 16_000
    low, high = tone_embedder(np.sin(2 * np.pi * 200 * t)), tone_embedder(np.sin(2 * np.pi * 1500 * t))
    assert low @ high < 0.2 and abs(low @ tone_embedder(np.sin(2 * np.pi * 210 * t))) > 0.9

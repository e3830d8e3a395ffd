import hashlib
import random
import re

import numpy as np
import pytest

from parlance.llm import embeddings, minhash, substrings
from parlance.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    passage = say(40)
    texts = [say(rng.randint(20, 90)) for _ in range(30)]
    texts += [f"{say(9)} {passage}\n{say(11)}" for _ in range(12)]  # one passage in many contexts
    base = say(120)
    for _ in range(15):  # near copies
        words = base.split()
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words))
    texts += [texts[3]] * 6 + [texts[50].upper(), "", None, "   \t", "one", "one two", "spam " * 700, "spam " * 650, "Ünï cödé " * 12, "Ünï cödé " * 12]
    return texts


def brute_substrings(texts, window):
    first, out = {}, {}
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first.setdefault(tuple(words[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [3, 512])
def test_substrings_equal_brute_force(make, hot):
    texts = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_digest(make(texts).repartition(5), 13, hot).collect()}
    assert got == brute_substrings(texts, 13)


def test_deduplicated_keeps_columns_and_untouched_texts(make, spark):
    texts = ["a  b\nc", " ".join(map(str, range(20))), "x " + " ".join(map(str, range(20))) + " y", None]
    out = {r.doc_id: r for r in substrings.deduplicated(make(texts), 13).collect()}
    assert [out[i].text for i in range(4)] == [texts[0], texts[1], "x y", None] and out[2].n_chars == 3 and out[0].ids == "x"
    assert substrings.substring_digest(make([]).limit(0), 13).count() == 0
    null = spark.createDataFrame([(None, texts[1]), (1, texts[1]), (1, texts[1])], "doc_id long, text string")
    assert [r.n_removed for r in substrings.substring_digest(null, 13).collect()] == [0, 0, 0]


def test_automaton_finds_first_documents():
    a = substrings.Automaton(3)
    seen = {}
    rng = random.Random(4)
    for doc in range(40):
        words = rng.choices("abc", k=rng.randint(1, 30))
        own = {}
        for k in range(len(words) - 2):
            own.setdefault(tuple(words[k : k + 3]), doc)
        want = [seen.get(tuple(words[k : k + 3]), doc) for k in range(len(words) - 2)]
        assert a.matches(words, doc) == want
        a.add(words, doc)
        for g, d in own.items():
            seen.setdefault(g, d)


def brute_classes(texts, n, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append(frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return {i: (len(s), label[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_equals_brute_force(make, n):
    texts = corpus(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(make(texts).repartition(4), n, 80).collect()}
    assert got == brute_classes(texts, n, 80)


def families(sizes, seed):
    """Of each size: an original, light copies (0.95 to it), and one heavier copy whose only link is to the original."""
    rng, texts = random.Random(seed), []

    def changed(words, places):
        return " ".join(f"x{rng.random()}" if k in places else w for k, w in enumerate(words))

    for f, n in enumerate(sizes):
        words = [f"f{f}w{k}" for k in range(404)]
        heavy = set(range(10, 400, 50))
        free = [k for k in range(5, 400) if all(abs(k - h) > 5 for h in heavy)]
        light = [sorted(rng.sample(free, 2)) for _ in range(n)]
        light = [(a, b) if b - a >= 5 else (20, 30) for a, b in light]
        copies = [changed(words, p) for p in light]
        texts += [*copies[: n // 2], " ".join(words), *copies[n // 2 :], changed(words, heavy)]
    return texts


@pytest.mark.parametrize("sizes", [[12, 25, 40, 50, 60], [150, 200]])
def test_minhash_finds_the_only_link_of_a_heavier_copy(make, sizes):
    texts = families(sizes, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(make(texts).repartition(4), 5, 80).collect()}
    assert got == brute_classes(texts, 5, 80)


def test_minhash_tiles_compare_all_pairs_of_components_once(make, spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 4)
    component = [1] * 9 + [2] * 6 + list(range(30, 41))
    rows = spark.createDataFrame([(7, i, c, 10) for i, c in enumerate(component)], "node long, id long, component long, size long")
    met = []
    groups = {}
    for r in minhash.tiles(rows, 0).collect():
        groups.setdefault(r.node, []).append(r)
    for g in groups.values():
        met += [(min(a.id, b.id), max(a.id, b.id)) for k, a in enumerate(g) for b in g[:k] if a.component != b.component and (a.side != b.side or a.side == 2)]
    assert sorted(met) == [(i, j) for i in range(len(component)) for j in range(i + 1, len(component)) if component[i] != component[j]]


def test_minhash_of_nothing(make, spark):
    assert minhash.near_duplicates(make([]).limit(0), 2, 80).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c")], "doc_id long, text string")
    assert sorted((r.component_id, r.kept) for r in minhash.near_duplicates(rows, 2, 80).where("doc_id is not null").collect()) == [(7, True), (7, True)]


def test_components(spark):
    links = [(i, i + 1) for i in range(20, 60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (3, 9), (9, 3)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(20, 61), 20), **dict.fromkeys(range(100, 160), 100), 3: 3, 9: 3}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 16))
    vectors = [(centres[i % 6] + rng.normal(size=16) * (0.05 if i % 4 else 0.5)).tolist() for i in range(90)]
    vectors += [vectors[0]] * 4 + [None, [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [2 * x for x in vectors[1]], []]
    labels = [i % 3 for i in range(len(vectors))]
    labels[5] = None
    frame = spark.createDataFrame([(i, v, k) for i, (v, k) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    ok = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v) and labels[i] is not None]
    near = lambda i, j: labels[i] == labels[j] and np.dot(vectors[i], vectors[j]) / (np.linalg.norm(vectors[i]) * np.linalg.norm(vectors[j])) >= 0.93
    links = {i: [j for j in ok if j != i and near(i, j)] if i in ok else [] for i in range(len(vectors))}
    label = {i: i for i in links}
    for _ in links:
        label = {i: min([label[i], *(label[j] for j in links[i])]) for i in links}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_embeddings(frame, 0.93, block=8).collect()}
    assert got == {i: (len(links[i]), label[i], label[i] == i) for i in links}


def test_error_bound_is_rigorous():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(80, 64)), rng.normal(size=(70, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    (qa, sa, ha, ea), (qb, sb, hb, eb) = embeddings.quantise(a), embeddings.quantise(b)
    estimate = (qa.astype(float) * sa[:, None]) @ (qb.astype(float) * sb[:, None]).T
    assert (abs(a @ b.T - estimate) <= ea[:, None] * (hb + eb) + ha[:, None] * eb + 1e-12).all()
    sure, may = embeddings.tile_pairs((qa, sa, ha, ea), (qa, sa, ha, ea), 0.93)
    near = a @ a.T >= 0.93
    assert (sure <= near).all() and (near <= (sure | may)).all() and may.sum() < 200
    i, j = np.nonzero(sure | may)
    keep = embeddings.exact_pairs(a, a, i, j, 0.93)
    assert sorted(zip(i[keep].tolist(), j[keep].tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_embeddings_of_any_size_and_none(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [3e200, 3e200], 0), (3, [1e-300, 1e-300], 0), (4, [1.0, -1.0], 0), (None, [1.0, 1.0], 0), (5, [1.0, 1.0, 0.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_embeddings(frame, 0.93).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), None: (0, None, True), 5: (0, 5, True)}
    assert embeddings.near_embeddings(frame.where("false")).count() == 0


def test_chosen_paths():
    rng = np.random.default_rng(0)
    trees, paths, tokens = 120, 0, rng.integers(0, 256, (400, minhash.COORDINATES), dtype=np.uint8)
    tokens[200:] = tokens[:200]
    apart = rng.random((200, minhash.COORDINATES)) < 0.2
    tokens[200:][apart] = rng.integers(0, 256, int(apart.sum()), dtype=np.uint8)
    met = np.zeros(200)
    for t in range(trees):
        roots = np.full(400, minhash.mix(np.array([t], np.uint64))[0])
        names, owners = minhash.branch(roots, np.arange(400), tokens, 4, 0.8)
        assert len(set(zip(names.tolist(), owners.tolist(), strict=True))) == len(names)
        paths += len(names)
        nodes = {}
        for n, o in zip(names.tolist(), owners.tolist(), strict=True):
            nodes.setdefault(o, set()).add(n)
        met += [bool(nodes[i] & nodes[200 + i]) for i in range(200)]
    assert paths / (400 * trees) == pytest.approx(1.25**4, rel=0.1)
    agreement = (tokens[:200] == tokens[200:]).mean(axis=1)
    assert met.sum() / (200 * trees) == pytest.approx(minhash.meets(agreement, 4, 0.8).mean(), abs=0.02)
    assert minhash.trees_for(0.9999, 8, 0.8) > minhash.trees_for(0.99, 8, 0.8) > 1 and minhash.trees_for(0.9, 4, 1.0) == 1


def only_pairs(n, own, seed):
    """Texts that all share most words, alike enough in pairs only."""
    rng, base, texts = random.Random(seed), [f"w{k}" for k in range(404)], []
    slots = range(4, 400, 6)
    for p in range(n):
        mine = set(rng.sample(slots, 9))
        first = [f"p{p}k{k}" if k in mine else w for k, w in enumerate(base)]
        more = set(rng.sample([k for k in slots if k not in mine], own))
        texts += [" ".join(first), " ".join(f"q{p}k{k}" if k in more else w for k, w in enumerate(first))]
    return texts


def test_minhash_loses_no_link_in_a_large_group_of_pairs(make):
    texts = only_pairs(400, 8, 1)  # 800 texts of similarity 0.63 to 0.74 share nodes of over LIMIT; links have 0.82
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make(texts).repartition(4), 5, 80).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_minhash_ids_that_repeat_or_lack(spark):
    same, other = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(7, same), (7, same), (7, other), (9, same), (11, other), (None, same), (None, "x"), (4, None), (5, "")]
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key1 string, component int")
    got = sorted(((r.doc_id or -1, r.component_id, r.n_shingles, r.kept) for r in minhash.near_duplicates(frame, 2, 80).collect()), key=str)
    want = [(7, 7, 59, True)] * 3 + [(9, 7, 59, False), (11, 7, 59, False), (-1, None, 59, True), (-1, None, 1, True), (4, 4, 0, True), (5, 5, 0, True)]
    assert got == sorted(want, key=str)

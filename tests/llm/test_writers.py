import random
import zlib
from itertools import product

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm import chat, mixing, packing, warc
from parlance.llm.queries import tokenizer_files

FILES = tokenizer_files()


def test_ids_are_those_of_tokenizers(spark):
    full = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    rng = random.Random(0)
    texts += ["", "  two  blanks ", "it's <|endoftext|> ok", "\n\n a\tb", "漢字 é", "a" * 3000, " " * 2000, "\n" * 900, "ab" * 2500, "漢" * 800, "é́" * 700, "1234567890" * 300, "!?" * 900, "\u200b\ufeff x"]
    texts += ["".join(rng.choices("abcé漢 \n\t'!1\u00a0\u2028😀", k=rng.randint(1, 400))) for _ in range(400)]
    for k in range(0, len(texts), 2_000):
        part = texts[k : k + 2_000]
        want = full.encode_batch([t or "" for t in part], add_special_tokens=False)
        assert [x.tolist() for x in packing.encode(part, *FILES)] == [w.ids for w in want]


def test_cut():
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(1, 1024) == [(0, 1)]
    assert packing.cut(2049, 1024) == [(0, 1), (1, 1024), (1025, 1024)] and packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def plain_sum_of_squares(lengths, capacity):
    """Each piece where the squared counts of open sequences by gap become smallest, counted anew for every choice."""
    sequences, places = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        gaps = [capacity - sum(s) for s in sequences]
        fits = sorted({g for g in gaps if g >= lengths[i]})

        def total(g, s=lengths[i], gaps=gaps):
            after = [x for x in gaps if 0 < x < capacity]
            after.remove(g)
            after += [g - s] * (g > s)
            return sum(after.count(x) ** 2 for x in set(after))

        if fits:
            best = min(fits, key=lambda g: (total(g), g))
            at = max((k for k, g in enumerate(gaps) if g == best), key=lambda k: sequences[k].when)
        else:
            sequences.append(Sequence())
            at = len(sequences) - 1
        places[i] = (at, sum(sequences[at]))
        sequences[at].append(lengths[i])
        sequences[at].when = max(s.when for s in sequences) + 1
    return places


class Sequence(list):
    when = 0


@pytest.mark.parametrize("seed", range(6))
def test_places_are_those_of_sums_of_squares(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 31, 120)
    where, offset, n = packing.place(lengths, 30)
    want = plain_sum_of_squares(lengths.tolist(), 30)
    assert list(zip(where.tolist(), offset.tolist(), strict=True)) == want and n == 1 + max(w for w, _ in want)


@pytest.mark.parametrize("seed", range(5))
def test_places_are_legal_and_tight(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 3000)
    where, offset, n = packing.place(lengths, 100)
    for s in range(n):
        own = np.flatnonzero(where == s)
        own = own[np.argsort(offset[own])]
        ends = np.cumsum(lengths[own])
        assert len(own) and ends[-1] <= 100 and offset[own].tolist() == [0, *ends[:-1]]
    assert n <= 1.02 * max(-(-lengths.sum() // 100), (lengths > 50).sum())


def test_packing_repeats_and_null_ids(spark):
    rows = [(None, "one two"), (None, "one two"), (3, "x " * 300), (3, "x " * 300), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "s", 5) for i, t in rows], "doc_id long, text string, sequence_id string, length int")
    placed = packing.pack_documents(docs.repartition(3), *FILES, capacity=64, shard=5).collect()
    by = {}
    for r in placed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64
    assert sum(r.doc_id is None for r in placed) == 2 and sum(r.doc_id == 3 and r.length == 1 and r.start == 0 for r in placed) == 1
    packed = packing.sequences(docs, *FILES, capacity=64).collect()
    assert sum(len(r.input_ids) for r in packed) == sum(r.length for r in placed) and sum(i is None for r in packed for i in r.doc_ids) == 2


def test_packing_round_trip(make, spark):
    texts = ["", None, "hello world", "hello world", "word " * 3000, "a b", "é" * 50]
    docs = make(texts)
    placed = packing.pack_documents(docs, *FILES, capacity=64, shard=10)
    rows = placed.collect()
    ids = {i: [*x.tolist(), 2] for i, x in enumerate(packing.encode(texts, *FILES))}
    back = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 64 and r.ids_crc32 == zlib.crc32(b"".join(t.to_bytes(4, "little") for t in part))
        back.setdefault(r.doc_id, []).extend(part)
    assert back == ids
    packed = packing.sequences(docs, *FILES, capacity=64).collect()
    assert sum(len(r.input_ids) for r in packed) == sum(map(len, ids.values())) and max(len(r.input_ids) for r in packed) <= 64
    assert packing.pack_documents(docs.where("false"), *FILES).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/\nx", "<p>é</p>" * 50, "k"), (3, None, "<p>é</p>" * 50, "k"), (9, "u", None, "k"), (1, "u", "", "k"), (-4, "u", "x", None), (2**62, "u", "\r\n\r\nWARC/1.1\r\n", "k"), (7, "u", "y" * 300_000, "k")]
    manifest = warc.write_archives(pages(spark, rows).repartition(2), f"file://{tmp_path}/w", sample=3)
    got = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {5: ("response", None), 3: ("revisit", 5), 9: ("response", None), 1: ("revisit", 9), -4: ("response", None), 2**62: ("response", None), 7: ("response", None)}
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.base32_sha1(data)) and (r.payload is None or bytes(r.payload) == data)
    assert sum(r.records for r in manifest.collect()) == 7
    with open(manifest.where("records > 0").first().path.removeprefix("file://"), "rb") as f:
        assert f.read(4) == b"\x5d\x2a\x4d\x18"
    assert {r.record_type for r in warc.round_trip(pages(spark, rows), min_bytes=1_000_000).collect()} == {"response"}
    assert warc.round_trip(pages(spark, rows).where("false")).count() == 0


def test_warc_pages_without_id(spark, tmp_path):
    rows = [(None, "u", "same", "k"), (None, None, "same", "k"), (2, "u", "same", "k"), (2, "u", "same", "k"), (None, "u", "lone", "k"), (1, "u", "same", "k")]
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, rows).repartition(3)).collect())
    assert got == sorted([(0, "revisit", 2), (0, "revisit", 2), (0, "response", None), (1, "revisit", 2), (2, "response", None), (2, "response", None)], key=lambda x: (x[0], x[1]))


def test_sources_in_order_over_ranges(spark):
    names = [None, *(f"s{i:04d}" for i in range(500)), "é", "Z"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    rows = mixing.source_weights(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(5), (5, 2, 1)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted((n for n in names if n is not None), key=lambda n: n.encode()) + [None]
    assert {r.source: r.weight for r in rows} == {n: (5, 2, 1)[i % 3] for i, n in enumerate(order)} and len(rows) == len(names)


def test_mixing_hits_its_targets(make):
    rng = random.Random(0)
    sources = [rng.choice(["a", "a", "a", "b", "é", None]) for _ in range(400)]
    docs = make([" ".join(["w"] * rng.randint(0, 60)) if i % 50 else None for i in range(400)], sources=sources)
    rows = mixing.mix_sources(docs.repartition(3)).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == 400
    words = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(sources[r.doc_id], []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    assert sum(v[0].target for v in by.values()) == pytest.approx(words)
    for own in by.values():
        assert sum(r.taken for r in own) == int(own[0].target) and own[0].target <= 3 * own[0].source_size
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.select(F.sum(mixing.words_count(F.col("text")))).first()[0] == sum(r.taken for r in rows)
    assert mixing.mix_sources(docs.where("false")).count() == 0
    assert {r.taken for r in mixing.mix_sources(docs.where("text is null")).collect()} == {0}


def test_mixed_keeps_null_and_repeated_ids(spark):
    rows = [(None, "a b", "s"), (None, "c d e", "s"), (7, "f g", "s"), (7, "f g", "s"), (7, "f g", "s"), (1, "h", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, docs.collect()))  # one source: each row once


def test_water_filling(spark):
    frame = spark.createDataFrame([("a", 10, 5), ("b", 100, 2), ("c", 100, 1)], "source string, source_size long, weight long")
    got = {r.source: r.target for r in mixing.water_fill(frame, 3).collect()}
    assert got == {"a": 30.0, "b": pytest.approx(120.0), "c": pytest.approx(60.0)}


LEGAL_NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def legal(roles):
    state = ""
    for r in roles:
        if r not in LEGAL_NEXT[state]:
            return False
        state = r
    return state in ("", "assistant")


def brute_cost(roles):
    """Cheapest cost over all relabellings, merges and numbers of insertions, by search over whole choices."""
    best = chat.FAR
    for labels in product((1, 2, 3), repeat=len(roles)):
        relabel = sum(0 if lab == r else chat.RELABEL_UNKNOWN if r == 0 else chat.RELABEL for lab, r in zip(labels, roles, strict=True))
        for merges in product((0, 1), repeat=len(roles)):
            state, cost, ok = 0, relabel, True
            for lab, m in zip(labels, merges, strict=True):
                if m:
                    ok, cost = ok and state == lab, cost + chat.MERGE
                elif (state, lab) in chat.BRIDGES:
                    cost += chat.INSERT * len(chat.BRIDGES[state, lab])
                else:
                    ok = False
                state = lab
            if ok:
                best = min(best, cost + chat.end_cost(state))
    return best


def test_repair_is_cheapest():
    rng = random.Random(0)
    for _ in range(60):
        roles = [rng.choice([0, 1, 2, 3]) for _ in range(rng.randint(1, 4))]
        assert chat.repair(roles)[2] == brute_cost(roles)


def test_chats_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(12):
        for turn in range(400 if conv == 4 else rng.randint(1, 8)):  # one conversation crosses parts
            rows.append((conv, turn, rng.choice(["user", "assistant", " Human ", "system", None, "narrator", "GPT"]), rng.choice(["hi", None, "a <|im_end|> b"]), "z"))
    rows += [(None, None, "user", "lost", "z"), (None, 1, "assistant", "found", "z"), rows[0]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string")
    outs = []
    for n in ("1", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        outs.append({r.conv_id: r.text for r in chat.render(chat.format_chats(frame)).collect()})
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert outs[0] == outs[1] and len(outs[0]) == 13
    for text in outs[0].values():
        roles = [line.removeprefix(chat.OPEN) for line in text.split("\n") if line.startswith(chat.OPEN)]
        assert legal(roles) and text.count(chat.OPEN) == text.count(chat.CLOSE) == len(roles)
    assert chat.format_chats(frame.where("false")).count() == 0

"""Every operator against its brute-force version, on nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.llm import blocks, decontamination, license_scan, near_duplicates, packing, sharding, toxicity, vector_search
from graphlens.llm.decontamination import contamination
from graphlens.llm.encoding import default_tokenizer, encoder
from graphlens.llm.language_model import backoff_scores
from graphlens.llm.near_duplicates import near_duplicates as simhash_groups
from graphlens.llm.substring_dedup import repeated
from graphlens.llm.token_counts import token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, packed string, fp string, slot string, shard string, count long, _text string"


def made_up(seed=5):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "ab", "été", "x1", "don't", "a-b", "Zoë,", "q", "漢字", "new.", "of", "|"]
    say = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randint(0, 60)) * rng.randint(0, 1) for _ in range(n))
    passage, long_text = say(40), say(4000)
    docs = [(i, say(rng.choice([0, 1, 3, 12, 13, 30, 120]))) for i in range(40)]
    docs += [(100 + i, say(20) + "\n" + passage + " \t" + say(5)) for i in range(5)]
    docs += [(200, long_text), (90, long_text), (201, long_text + " end"), (202, None), (203, ""), (204, " \n\t "), (205, passage), (205, passage), (None, passage), (None, None), (206, "<|endoftext|> a  b   c\n\n d ")]
    return docs


DOCS = made_up()


def frame(spark, docs):
    rows = [(d, t, "en", "s", 1, "block", "packed", "fp", "slot", "shard", 3, "other") for d, t in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def same(df, expected, *columns):
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(expected)


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(DOCS[20][1].split()[:12]) or "ab q"), (2, DOCS[-5][1]), (3, "zoë x1"), (4, None), (5, "..."), (None, "the"), (2, DOCS[-5][1]), (10, "The, THE ab!")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = brute.benchmark_hits(DOCS, items)
    assert sum(r[-1] for r in expected) > 5
    same(contamination(docs, benchmark), expected, *columns)
    same(contamination(docs, benchmark, portion=7), expected, *columns)
    assert not contamination(docs, benchmark.limit(0)).filter("contaminated").count()
    assert contamination(none, benchmark).count() == 0


def test_wu_manber_overlaps_and_single_words():
    search = decontamination.WuManber({(b"a",): {1}, (b"a", b"a", b"a"): {2}, (b"b", b"a"): {3}})
    spans, found = search.find([b"a", b"a", b"a", b"a", b"b", b"a"])
    assert decontamination.covered(spans) == 6 and found == {1, 2, 3}
    assert decontamination.covered([s for s in spans if s[1] - s[0] == 3]) == 4


def test_substring_dedup(docs, none, monkeypatch):
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    expected = brute.kept_words(DOCS)
    assert sum(r[2] > 0 for r in expected) > 5
    same(repeated(docs), expected, *columns)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(blocks, "BUCKET_WINDOWS", 500)
    monkeypatch.setattr(blocks, "segments", lambda t: iter([t[:0], *[x + b" " for x in t.split(b" ")]]))
    same(repeated(docs), expected, *columns)
    kept = {r["doc_id"]: r["kept"] for r in repeated(docs, keep=("lang",)).collect()}
    assert kept[90] == DOCS[45][1] and kept[201].endswith("end") and len(kept[201]) < 100
    carried = repeated(docs, keep=("lang", "fp", "_text"))
    assert carried.columns[-3:] == ["lang", "fp", "_text"] and carried.filter("lang = 'en' AND fp = 'fp' AND _text = 'other'").count() == len(DOCS)
    assert repeated(none).count() == 0


def test_rolling_hash_is_a_function_of_the_window():
    words = blocks.word_hashes(b"a b c d a b c e".split())
    hashes = blocks.rolling(words, 3)
    assert hashes[0] == hashes[4] and len(set(hashes.tolist())) == 5
    assert blocks.from_planes(blocks.planes(np.array([0, 5, 2**40], np.uint64), 6), 6).tolist() == [0, 5, 2**40]


def test_stupid_backoff(docs, none, monkeypatch):
    expected = brute.backoff(DOCS)
    scored = lambda: backoff_scores(docs).withColumn("log_score", F.round("log_score", 6) + 0.0)
    close = lambda rows: Counter((a, b, round(c, 4) + 0.0) for a, b, c in rows)
    assert close(map(tuple, scored().select("doc_id", "n_words", "log_score").collect())) == close(expected)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(blocks, "BUCKET_WINDOWS", 700)
    assert close(map(tuple, scored().select("doc_id", "n_words", "log_score").collect())) == close(expected)
    assert backoff_scores(none).count() == 0


def test_simhash_groups(docs, none):
    same(simhash_groups(docs), brute.groups(DOCS), "doc_id", "fingerprint", "component_id")
    assert simhash_groups(none).count() == 0


def test_near_pairs_connect_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 150, dtype=np.uint64)
    for bits in range(1, 7):
        extra = np.repeat(fps[:60], 2)
        for _ in range(bits):
            extra = extra ^ (np.uint64(1) << rng.integers(0, 64, len(extra)).astype(np.uint64))
        fps = np.concatenate([fps, extra])
    ball = np.full(3_000, fps[0])
    for _ in range(5):
        ball = ball ^ (np.uint64(1) << rng.integers(0, 64, len(ball)).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, ball]))

    def labels(pairs):
        label = np.arange(len(fps))
        for a, b in pairs:
            a, b = near_duplicates._root(label, a), near_duplicates._root(label, b)
            label[max(a, b)] = min(a, b)
        return [near_duplicates._root(label, i) for i in range(len(fps))]

    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    found = near_duplicates.near_pairs(fps)
    assert all(close[a, b] for a, b in found)
    assert labels(found) == labels(np.argwhere(np.triu(close, 1)))


def test_heavy_keys_are_split_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "DIRECT", 5)
    monkeypatch.setattr(near_duplicates, "scheme", lambda n, most=4: (6, 2))
    rng = random.Random(1)
    fps = sorted({sum(1 << rng.randrange(64) for _ in range(0)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)})
    nodes = spark.createDataFrame([(near_duplicates._signed(x),) for x in fps], "fp long")
    found = near_duplicates.components(near_duplicates.links(nodes)).collect()
    parent = {r["node"]: r["component"] for r in found}
    label = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4 and label[a] < label[b]:
                    label[b], changed = label[a], True
    by = defaultdict(set)
    for x in fps:
        by[label[x]].add(near_duplicates._signed(x))
    mine = defaultdict(set)
    for x in fps:
        s = near_duplicates._signed(x)
        mine[parent.get(s, s)].add(s)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, mine.values()))


def test_token_counts_and_cache(spark, docs, none, tmp_path):
    tokenizer = encoder(default_tokenizer()).library
    expected = [(d, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in DOCS]
    cache = str(tmp_path / "cache")
    for _ in range(2):
        same(token_counts(docs, default_tokenizer(), cache), expected, "doc_id", "n_bytes", "n_tokens")
        stored = spark.read.parquet(f"{cache}/*")
        assert stored.count() == stored.distinct().count() == len({t or "" for _, t in DOCS})
    same(token_counts(docs, default_tokenizer()), expected, "doc_id", "n_bytes", "n_tokens")
    assert token_counts(none, default_tokenizer()).count() == 0


def test_encoder_cuts_nowhere_it_matters(monkeypatch):
    import graphlens.llm.encoding as encoding

    monkeypatch.setattr(encoding, "MEMORY", 40)
    own, rng = encoding.Encoder(default_tokenizer()), random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "'s", ",", "é", "<|endoftext|>", "\x1c", "\xa0", "　", "漢字", "1", "<|", "́", "  \n ", " don't", "\r\n", "🙂", "w" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1_500)]
    for begin in range(0, len(texts), 100):
        batch = texts[begin : begin + 100]
        assert own.encode(batch) == [np.array(own.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in batch]


def test_packing_is_whole_and_gapless(docs, none):
    capacity, tokenizer = 64, encoder(default_tokenizer()).library
    rows = packing.packed(docs, default_tokenizer(), capacity).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter(brute.pieces(DOCS, tokenizer, capacity))
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    counts = Counter(r["length"] for r in rows)
    assert packing.lower_bound(counts, capacity) <= len(held) <= sum(r.times for r in packing.best_fit(counts, capacity))
    sequences = packing.sequences(docs, default_tokenizer(), capacity).collect()
    assert sum(len(r["ids"]) // 4 for r in sequences) == sum(n * x for x, n in counts.items())
    one = next(r for r in rows if r["doc_id"] == 206 and r["piece"] == 0)
    ids = next(r["ids"] for r in sequences if r["ids"] and 206 in r["doc_ids"])
    assert any(zlib.crc32(ids[k * 4 : (k + one["length"]) * 4]) == one["ids_crc32"] for k in range(capacity))
    assert packing.packed(none, default_tokenizer()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_finds_the_optimum_of_small_cases(seed):
    rng = random.Random(seed)
    sizes, capacity = [rng.randint(2, 12) for _ in range(9)], 15
    fewest = len(sizes)

    def search(rest, bins):
        nonlocal fewest
        if len(bins) >= fewest:
            return
        if not rest:
            fewest = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + rest[0] <= capacity and bins[k] not in bins[:k]:
                search(rest[1:], [*bins[:k], bins[k] + rest[0], *bins[k + 1 :]])
        search(rest[1:], [*bins, rest[0]])

    search(sorted(sizes, reverse=True), [])
    runs = packing.complete(Counter(sizes), capacity)
    used = Counter(x for r in runs for x in r.filling for _ in range(r.times))
    assert used == Counter(sizes) and all(sum(r.filling) <= capacity for r in runs)
    assert sum(r.times for r in runs) == fewest >= packing.lower_bound(Counter(sizes), capacity)


def test_long_texts_are_worked_on_in_parts(monkeypatch):
    import graphlens.llm.common as common
    import graphlens.llm.encoding as encoding

    texts = [t for _, t in DOCS if t]
    whole = [near_duplicates.fingerprint(t.encode()) for t in texts]
    assert whole == [brute.simhash(t) for t in texts]
    search = decontamination.WuManber({tuple(w for w in decontamination.words(texts[-2].encode())[k : k + 10]): {str(k)} for k in range(25)})
    before = [search.search(t.encode()) for t in texts]
    own = encoder(default_tokenizer())
    ids = own.encode(texts)
    monkeypatch.setattr(common, "SEGMENT", 20)
    monkeypatch.setattr(encoding, "SEGMENT", 25)
    assert [near_duplicates.fingerprint(t.encode()) for t in texts] == whole
    after = [search.search(t.encode()) for t in texts]
    assert [(n, decontamination.covered(s), i) for n, s, i in after] == [(n, decontamination.covered(s), i) for n, s, i in before]
    assert any(i for _, _, i in after) and own.encode(texts) == ids
    assert b"".join(common.segments(texts[-2].encode())) == texts[-2].encode()


def test_dominated_fillings():
    assert packing.dominated((3,), 5, {3: 1, 5: 1}) and not packing.dominated((5,), 5, {3: 1, 5: 1})
    assert packing.dominated((2, 3), 5, {2: 1, 3: 1, 5: 1}) and not packing.dominated((2, 3), 5, {2: 1, 3: 1})


def test_nearest_neighbours(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.5, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(330)]
    rows[7] = (7, rows[3][1])
    rows += [(5, rows[5][1]), (400, None), (500, [0.0] * 6), (600, [float("nan")] * 6), (700, [None, *[1.0] * 5]), (None, [1.0] * 6), (800, [1.0, 2.0]), (801, [1.0, 2.5]), (802, [float("inf")] * 6)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string").repartition(3)
    expected = [(q, r, i, round(d, 9)) for q, r, i, d in brute.nearest(rows)]
    got = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())
    assert got(vector_search.nearest_neighbours(table)) == sorted(expected)
    for name, value in (("TILE", 16), ("QUERY_CELL", 12), ("CANDIDATE_CELL", 600)):
        monkeypatch.setattr(vector_search, name, value)
    assert got(vector_search.nearest_neighbours(table)) == sorted(expected)
    assert vector_search.nearest_neighbours(table.limit(0)).count() == 0


def test_lookup_table_is_balanced_and_stable():
    shards = tuple(f"s{k}" for k in range(7))
    full = sharding.lookup_table(shards, 1_009)
    sizes = Counter(full)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 1_009)
    moved = sum(a != b for a, b in zip(full, fewer) if a != 6)
    assert moved < 0.15 * 1_009
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 1_000)


def test_placement(spark, docs, none):
    rows = sharding.place(docs, "doc_id").collect()
    assert len(rows) == len(DOCS) and {"slot", "shard", "block"} <= set(rows[0].asDict())
    table = sharding.lookup_table(sharding.SHARDS)
    assert all(r["shard"] == sharding.SHARDS[table[r["slot"]]] for r in rows)
    assert len({(r["slot"], r["shard"]) for r in rows if r["doc_id"] is None}) == 1
    assert sharding.place(none, "doc_id").count() == 0
    plan = sharding.place(docs, "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" not in plan
    assert sharding.place(docs, "slot").count() == len(DOCS)


def test_license_scan(spark, none):
    apache, cc = license_scan.TEMPLATES["Apache-2.0"], license_scan.TEMPLATES["CC-BY-NC-4.0"]
    filler = "the under in and of to version license work " * 300
    texts = [
        (1, f"{filler}\n{apache}\n{filler}"), (2, apache.upper()), (3, "Licensed under the Apache Licence, Version 2.0"), (4, filler), (5, None), (6, ""), (None, cc),
        (7, f"{apache} words between {cc} {apache}"), (8, "2.0 Version License Apache the under Licensed"), (2, apache.upper()),
    ]
    found = Counter((r["doc_id"], r["license"], round(r["coverage"], 2), r["notices"]) for r in license_scan.license_scan(frame(spark, texts)).collect())
    assert found == Counter([
        (1, "Apache-2.0", 1.0, 1), (2, "Apache-2.0", 1.0, 1), (2, "Apache-2.0", 1.0, 1), (3, "Apache-2.0", 0.86, 1), (4, None, 0.0, 0), (5, None, 0.0, 0), (6, None, 0.0, 0), (None, "CC-BY-NC-4.0", 1.0, 1),
        (7, "Apache-2.0", 1.0, 2), (7, "CC-BY-NC-4.0", 1.0, 1), (8, None, 0.0, 0),
    ])
    assert license_scan.license_scan(none).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_alignment_pairs_are_equal_and_ordered(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 30))] for _ in range(2))
    pairs = license_scan.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    run = license_scan.increasing([3, 1, 2, 5, 4, 9, 6])
    assert len(run) == 4


def test_toxicity_learns_words_and_leaves_clean_texts_alone(spark, none):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["ser", "and", "tolen", "is", "you", "mira", "Das", "queb", "ont"]) + rng.choice(["", "a", "er", "on"]) for _ in range(n))
    bad = ["grubnik", "VOLTAR", "grubnak"]
    docs, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        docs.append((i, say(20) + (f" you {rng.choice(bad)} {rng.choice(bad)} " if toxic else " ") + say(rng.randint(5, 40))))
        labels.append((i, 1, int(toxic), "x"))
    docs += [(900, None), (901, ""), (None, "you grubnik VOLTAR"), (3, docs[3][1])]
    labels += [(902, 1, 1, "x"), (None, 1, 1, "x"), (1, 1, None, "x"), (2, 1, 7, "x"), (3, 0, 0, "x")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    rows = toxicity.score_documents(frame(spark, docs), table).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["doc_id"] is not None:
            assert r["predicted"] == int(r["doc_id"] < 500 and r["doc_id"] % 5 == 0), r
    assert toxicity.score_documents(none, table).count() == 0
    flat = toxicity.score_documents(frame(spark, docs), table.limit(0)).collect()
    assert {r["score"] for r in flat} == {0.0} and len(flat) == len(docs)


def test_held_out_labels_are_never_read(spark):
    docs = [(i, "grubnik" if i % 2 else "mira") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    used = {r["doc_id"] for r in toxicity.training_rows(frame(spark, docs), labels).collect()}
    assert used == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_obfuscated_words_reach_the_lexicon():
    lexicon = toxicity.Lexicon({"idiot": 3.0})
    vector = dict(zip(toxicity.FEATURES, toxicity.features("you are an 1d!ot, an id1iot and an IDIOOOT", lexicon)))
    assert vector["hidden"] >= 1 and vector["near"] > 0 and vector["strongest"] == 3.0


def test_license_texts_and_headers_are_found():
    known = license_scan.shipped()
    scanner = license_scan.Scanner(known, license_scan.COVERAGE)
    filler = "mira sol tolen ont " * 50
    for name in ("MIT.text", "GPL-3.0.text", "GPL-3.0.header", "AGPL-3.0.header", "LGPL-2.1.header", "BSD-2-Clause.text", "BSD-3-Clause.text", "CC-BY-4.0.header", "CC-BY-SA-4.0.header"):
        found = {f[0]: f[1] for f in scanner.scan(license_scan.words(f"{filler} {known[name]} {filler}".encode()))}
        assert found[name] == 1 and name not in license_scan.TEMPLATES
    two = {f[0]: f[1] for f in scanner.scan(license_scan.words(known["BSD-2-Clause.text"].encode()))}
    assert two["BSD-2-Clause.text"] == 1 > two.get("BSD-3-Clause.text", 0)
    gaps = license_scan.words(known["GPL-3.0.text"].encode())
    changed = [w for i, w in enumerate(gaps) if i % 20]
    assert 0.93 < {f[0]: f[1] for f in scanner.scan(changed)}["GPL-3.0.text"] < 0.96

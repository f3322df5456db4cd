"""Exact, near and substring dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from blockweave.llm import common, exact_dedup, similar, simhash, substring_dedup
from blockweave.llm.components import components


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("hash_of", [exact_dedup.content_hash, lambda c: F.lit(bytearray(b"same"))])
def test_exact_dedup(docs, texts, hash_of):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[lower(t)] += [i, i] if i == 3 else [i]
    want = sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, hash_of=hash_of).collect())) == want


def test_exact_dedup_of_nothing_and_null_ids(spark, docs, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    d = spark.createDataFrame([(None, "a"), (None, None), (5, "A")], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(d).collect()}
    assert got == {(None, 5, 2, False), (5, 5, 2, True), (None, None, 1, True)}
    assert exact_dedup.drop_copies(docs).columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in exact_dedup.drop_copies(d.union(d)).collect()) == [(False, 5), (True, None)]


def test_stages_keep_one_row_of_each_group(spark, docs, texts):
    left = [r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()]
    assert len(left) == len(set(left)) == len({lower(t) for t in texts.values()})


def near_groups(rows, shingle=5, similarity=0.8):
    """Row index to the index of its group's row that stays, by brute force: rows are (id, text)."""
    sets = [similar.shingles(t, shingle) for _, t in rows]
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if not (sets[a] or sets[b]) or (both := len(sets[a] & sets[b])) >= similarity * (len(sets[a]) + len(sets[b]) - both) and both]
    group = union(edges, range(len(rows)))
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    return {k: min((j for j in group if group[j] == group[k]), key=order) for k in group}


def test_near_dedup_keeps_other_texts_of_an_id(spark):
    r = random.Random(3)
    text = lambda: " ".join(f"w{r.randrange(900)}" for _ in range(60))
    p, u, v = text(), text(), text()
    for rows in ([(3, p), (5, p), (5, u)], [(None, p), (1, p), (None, u), (2, v), (None, v)], [(1, p), (1, p), (1, u)]):
        d = spark.createDataFrame([(*x, "x") for x in rows], "doc_id long, text string, row string")
        got = similar.drop_similar(d)
        assert got.columns == d.columns
        stay = set(near_groups(rows).values())
        assert sorted(map(str, [(x["doc_id"], x["text"]) for x in got.collect()])) == sorted(str(rows[k]) for k in stay)


def test_near_dedup_of_torn_buckets(spark, monkeypatch):
    """A family whose members are near each other but mostly not near enough goes through blocks of its buckets."""
    r = random.Random(5)
    base = [f"w{r.randrange(4000)}" for _ in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        for at in r.sample(range(120), r.choice([1, 2, 3, 4])):
            own[at] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(similar, "BLOCK", 16)
    monkeypatch.setattr(similar, "SMALL", 3)
    got = sorted(x["doc_id"] for x in similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(set(near_groups(rows).values())) and len(got) > 1


def test_intersections_in_blocks(monkeypatch):
    monkeypatch.setattr(similar, "COLUMNS", 7)
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 40, r.integers(0, 30))).astype("<u8") for _ in range(30)]
    want = [[len(np.intersect1d(x, y)) >= 0.5 * len(np.union1d(x, y)) for y in sets] for x in sets]
    assert (similar.linked(sets, 0.5) == np.array(want)).all()


def fingerprint(t):
    w = t.encode().lower().split()
    h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def union(pairs, nodes):
    up = {i: i for i in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


@pytest.mark.parametrize("dense", [64, 0])
def test_near_dedup(docs, texts, dense):
    fp = {i: fingerprint(t) for i, t in texts.items()}
    ids = sorted(fp)
    comp = union([(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], ids)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_dedup(docs, dense=dense).collect()}
    assert got == {(i, f"{fp[i]:016x}", comp[i]) for i in ids}


@pytest.mark.parametrize("dense", [64, 3, 0])
def test_links_of_crowded_fingerprints(spark, dense):
    r = np.random.default_rng(3)
    fps = set()
    for centre in r.integers(-(1 << 63), 1 << 63, 6).tolist():
        for _ in range(40):
            x = centre & (1 << 64) - 1
            for b in r.integers(0, 64, r.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    want = union([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2], fps)
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    labels = {x["node"]: x["label"] for x in components(simhash.links(df, dense)).collect()}
    mine = defaultdict(set)
    theirs = defaultdict(set)
    for x in fps:
        mine[labels.get(signed[x], signed[x])].add(x)
        theirs[want[x]].add(x)
    assert {frozenset(v) for v in mine.values()} == {frozenset(v) for v in theirs.values()}


def test_near_dedup_of_nothing(empty):
    assert simhash.near_dedup(empty).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "none"])
def test_components(spark, shape):
    edges = {"chain": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 300)], "none": [(4, 4)]}[shape]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len({r["label"] for r in got}) == (shape != "none") and len(got) == {"chain": 201, "star": 300, "none": 0}[shape]


def removed(texts, window=20):
    seen, out = {}, {}
    words = {i: t.split() if t.isascii() else t.encode().split() for i, t in texts.items()}
    words = {i: [w if isinstance(w, bytes) else w.encode() for w in ws] for i, ws in words.items()}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            seen.setdefault(tuple(words[i][p : p + window]), (i, p))
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] != (i, p):
                gone |= set(range(p, p + window))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize(("split", "shard", "hot"), [(1000, 4000, 1000), (1, 3, 1), (2, 50, 2)])
def test_substring_dedup(docs, texts, split, shard, hot):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs, split=split, shard=shard, hot=hot).collect()}
    want = removed(texts)
    assert got == want and any(n for _, n, _ in want.values())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_substring_dedup_of_repeated_and_null_ids(spark, kind):
    r = random.Random(2)
    text = lambda: " ".join(f"w{r.randrange(900)}" for _ in range(30))
    p, u, v = text(), text(), text()
    cases = [([(1, p), (None, p), (None, u)], [0, 30, 0]), ([(1, p), (5, p), (5, u)], [0, 30, 0]), ([(7, p), (7, p), (9, f"{u} {p}"), (None, v), (None, v)], [0, 0, 30, 0, 0])]
    for rows, gone in cases:
        d = spark.createDataFrame([(None if i is None else i if kind == "long" else f"k{i}", t, k) for k, (i, t) in enumerate(rows)], f"doc_id {kind}, text string, row long")
        got = sorted((str(x["doc_id"]), hashlib.sha256(x["kept_text"].encode()).hexdigest() == x["kept_sha256"], x["n_words"], x["n_removed"]) for x in substring_dedup.substring_dedup(d).collect())
        assert got == sorted((str(x["doc_id"]), True, len(x["text"].split()), n) for x, n in zip(d.orderBy("row").collect(), gone, strict=True))


def test_substring_dedup_of_a_crowded_minimizer(spark):
    """One passage in many surroundings: its minimizers have far more different pieces than a shard takes."""
    r = random.Random(9)
    shared = [f"s{k}" for k in range(26)]
    texts = {i: " ".join([*(f"w{r.randrange(60)}" for _ in range(r.randrange(25))), *shared, *(f"w{r.randrange(60)}" for _ in range(r.randrange(25)))]) for i in range(120)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for split in (5, 1000):
        got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring_dedup.substring_dedup(d, split=split, shard=7, hot=20).collect()}
        assert got == removed(texts)


def test_substring_dedup_of_nothing(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_automaton():
    a = substring_dedup.Automaton()
    held = ["a b a b c", "b b a", "c a b"]
    for s in held:
        a.add(s.split())
    probe = "x a b a b b a c a b c".split()
    inside = lambda p: any(f" {' '.join(p)} " in f" {s} " for s in held)
    assert a.matches(probe) == [max(k for k in range(i + 2) if k == 0 or inside(probe[i + 1 - k : i + 1])) for i in range(len(probe))]


def test_words_of_a_batch_without_an_object_for_each():
    """Word borders, hashes and least grams of whole batches against one word at a time, slices and nulls included."""
    cases = [None, "", " ", "a b", "b  c\t\n", "é\x0b日本 \x1cq\x85r", "a", "", f"{'x' * 300} a {'x' * 300}"]
    texts = substring_dedup.Texts(pa.array(["z", *cases, "z z"], pa.string()).slice(1, len(cases)))
    words = [substring_dedup.words_of(t) for t in cases]
    assert texts.lengths.tolist() == list(map(len, words))
    flat = [w for ws in words for w in ws]
    assert [texts.data[a:b] for a, b in zip(texts.starts, texts.ends, strict=True)] == flat
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(flat, texts.hashes().tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    assert texts.runs(np.array([4, 8]), np.array([0, 1]), np.array([2, 2])) == [b"b c", b"a " + b"x" * 300]
    assert substring_dedup.Texts(pa.array([], pa.string())).lengths.tolist() == []
    # Of 0s and 1s in the order of Thue and Morse and their opposites, sums of powers of any odd number are equal.
    morse = "".join("ab"[k.bit_count() & 1] for k in range(1 << 12))
    long = substring_dedup.Texts(pa.array([morse, morse.translate(str.maketrans("ab", "ba")), "y" * (substring_dedup.AT_ONCE + 9)])).hashes()
    assert len(set(long.tolist())) == 3
    keys = np.random.default_rng(1).integers(0, 9, substring_dedup.CHUNK * 2 + 40).astype(np.uint64) << np.uint64(40)
    want = np.lib.stride_tricks.sliding_window_view(keys, 15).argmin(1) + np.arange(len(keys) - 14)
    assert (substring_dedup.leftmost_least(keys, 15) == want).all()


def test_an_automaton_for_each_minimizer(monkeypatch):
    """A piece goes into its minimizer's automaton only if another one follows; each is matched against those before."""
    added, add = [], substring_dedup.Automaton.add
    monkeypatch.setattr(substring_dedup.Automaton, "add", lambda self, words: (added.append(len(words)), add(self, words)))
    a, b = [f"a{k}".encode() for k in range(24)], [f"b{k}".encode() for k in range(22)]
    pieces = [(5, 9, a[2:23]), (5, 3, a[:21]), (6, 1, b[:22]), (5, 7, a[3:24])]
    df = pd.DataFrame([(k, i, False, d, 0, 0, b" ".join(w)) for i, (k, d, w) in enumerate(pieces)], columns=["anchor", "piece", "no_id", "doc", "row", "start", "words"])
    got = {x.piece: (x.mask, x.again) for x in substring_dedup._decided(df).itertuples()}
    assert got == {0: (0b10, 0b11), 1: (0, 0b11), 2: (0, 0b111), 3: (0, 0b11)} and added == [21, 21]


def test_pipeline_drops_similar_texts(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    rows = []
    for k in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(300)]
        rows.append((10 * k, " ".join(words)))
        for j in range(1, 4):
            own = list(words)
            for at in r.sample(range(300), (0, 3, 5, 12)[j]):
                own[at] = "other"
            rows.append((10 * k + j, " ".join(own)))
    rows += [(1000, "a b"), (1001, "A  b"), (1002, "a c"), (1003, ""), (1004, None), (None, "a b")]
    sets = {i: similar.shingles(t) for i, t in rows if i is not None}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {x: new if g == old else g for x, g in group.items()}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [x["doc_id"] for x in corpus_pipeline.near(spark, d, "").collect()]
    assert sorted(got) == sorted(set(group.values()))  # the row without an id is a copy of one that has an id


def test_pipeline_near_dedup_goes_through_simhash(spark, monkeypatch):
    """Its candidates are each SimHash component's nodes, held against the least one; the rule of shingles decides."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(4)
    words = [f"w{r.randrange(5000)}" for _ in range(3000)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:-1], "other"])), (2, " ".join(f"v{k}" for k in range(200)))]
    fps = [(i, fingerprint(t) - (1 << 64) if fingerprint(t) >> 63 else fingerprint(t)) for i, t in rows]
    nodes = spark.createDataFrame([*fps, (7, fps[2][1] ^ 3), (8, fps[2][1] ^ 12), (9, fps[2][1] ^ 0xFFFF)], "node long, fp long")
    assert sorted(map(tuple, similar.by_fingerprint(nodes).collect())) == [(0, 1), (2, 7), (2, 8)]
    seen, members = [], simhash.members
    monkeypatch.setattr(simhash, "members", lambda nodes, *a: seen.append(nodes.count()) or members(nodes, *a))
    assert sorted(x["doc_id"] for x in corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()) == [0, 2]
    assert seen == [3]


def test_workers_forget_what_earlier_stages_kept(monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    first = common.kept("language", "a", object)
    assert common.kept("language", "a", object) is first
    common.forget()
    assert not common._kept and common.kept("language", "a", object) is not first

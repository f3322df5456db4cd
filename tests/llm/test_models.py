"""Language ID, toxicity, personal data, search and mixing: brute force and held-out accuracy."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from blockweave.llm import lang_id, mixing, pii, toxicity, vp_search

SF = "/root/testdata/sf0.01"


def test_language_id(docs, texts):
    got = {r["doc_id"]: r for r in lang_id.language_id(docs).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {i for i, t in texts.items() if not any(map(str.isalpha, t))}
    assert docs.count() == len(texts) + 1


def test_language_id_on_held_out_rows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = lang_id.language_id(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()


def brute_language(rows):
    """Word-first backoff from its definition, in plain dicts: id to (language, score)."""
    find = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    train = [(t, x) for i, t, x in rows if x is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    langs, counts = sorted({x for _, x in train}), {}
    pieces = lambda w, n: [f"<{w}>"[k : k + n] for k in range(len(w) + 3 - n)] if n else [w]
    for t, x in train:
        for w in find(t):
            for n in range(6):
                for g in pieces(w, n):
                    counts.setdefault((n, g), dict.fromkeys(langs, 0))[x] += 1
    kinds = {n: [c for (k, _), c in counts.items() if k == n] for n in range(6)}
    totals = {(n, x): sum(c[x] for c in own) + 0.5 * len(own) for n, own in kinds.items() for x in langs}
    score = lambda n, g, x: math.log((counts[n, g][x] + 0.5) / totals[n, x])
    out = {}
    for i, t, _ in rows:
        words, total = find(t), dict.fromkeys(langs, 0.0)
        for w in words:
            for n in (0, 5, 4, 3, 2, 1):
                if known := [g for g in pieces(w, n) if (n, g) in counts]:
                    for x in langs:
                        total[x] += sum(score(n, g, x) for g in known) / len(known)
                    break
        if not words:
            out[i] = ("und", 0.0)
            continue
        top, part = max(total.values()), min(1.0, 20 / len(words))
        out[i] = (min(x for x in langs if total[x] == top), 1 / sum(math.exp((v - top) * part) for v in total.values()))
    return out


def test_language_id_against_brute_force(spark, rows):
    want = brute_language([(i, t, x) for i, t, x, _ in rows])
    d = spark.createDataFrame([(i, t, x) for i, t, x, _ in rows], "doc_id long, text string, lang string")
    for r in lang_id.language_id(d).collect():
        lang, score = want[r["doc_id"]]
        assert r["lang_pred"] == lang and math.isclose(r["score"], score, rel_tol=1e-3, abs_tol=1e-6)


def test_language_id_learns_nothing(docs, empty):
    assert lang_id.language_id(empty).count() == 0
    blank = docs.withColumn("lang", docs["lang"].substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang")
    assert {r["lang_pred"] for r in lang_id.language_id(blank).collect()} == {"und"}


def test_language_id_learns_rare_and_many_languages(spark):
    r, abc = random.Random(4), "abcdefghijklmnopqrstuvwxyz"
    vocab = {f"l{k:02d}": ["".join(r.choices(abc, k=7)) for _ in range(12)] for k in range(90)}
    rows = [(x, " ".join(r.choices(vocab[x], k=8))) for x in vocab for _ in range(3000 if x == "l00" else 24)]
    d = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = lang_id.language_id(d, sample=1000).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert all(g["lang_pred"] == g["lang"] for g in got) and len(got) == len(rows)
    assert lang_id.quota([5, 50, 900, 10_000], 1000) == 472 and lang_id.quota([5, 50], 1000) == 50 and lang_id.quota([900] * 90, 1000) == lang_id.LEAST


def test_backoff_goes_to_shorter_grams():
    counts = {"lang": ["a", "b"], "kind": [1, 1], "token": ["x", "y"], "n": [9, 9]}
    p = lang_id.Predictor(lang_id.Model(["a", "b"], counts))
    assert p.predict("xxyx")[0] == "a" and p.predict("yyy")[0] == "b" and p.predict("1 2")[0] == "und"


def brute_decode(token, model, spaced):
    """The cost of the likeliest reading, over all paths of the lattice."""
    best = math.inf
    places = toxicity.lattice(token, spaced)
    for path in itertools.product(*places):
        text = "".join(x for x, _ in path)
        classes = [0, 0, 0, *map(toxicity.class_of, text), 0]
        if text:
            best = min(best, sum(c for _, c in path) + cost_of(classes, model))
    return best


def cost_of(classes, model):
    at = lambda k: ((classes[k - 3] * 28 + classes[k - 2]) * 28 + classes[k - 1]) * 28 + classes[k]
    return sum(model.cost[at(k)] for k in range(3, len(classes)))


def character_model(spark, text):
    c = toxicity.char_counts(spark.createDataFrame([(text,)], "text string")).toPandas()
    return toxicity.CharModel(c["code"].to_numpy(np.int64), c["n"].to_numpy(float))


def test_decoding_is_exact(spark):
    model, r = character_model(spark, "take out the trash and the other trash of this house again " * 5), random.Random(6)
    for k in range(300):
        spaced = k % 2 == 0
        token = (" " if spaced else "").join(r.choices("tr4sh1@$h0u5e+", k=r.randrange(1, 8)))
        got = toxicity.decode(token, model, spaced)
        want = brute_decode(token, model, spaced)
        if math.isinf(want):
            assert got == ""
            continue
        costs = [sum(c for _, c in p) + cost_of([0, 0, 0, *map(toxicity.class_of, got), 0], model) for p in itertools.product(*toxicity.lattice(token, spaced)) if "".join(x for x, _ in p) == got]
        assert math.isclose(min(costs), want, rel_tol=1e-9)


@pytest.mark.parametrize("disguise", ["tr4sh", "t r a s h", "traaaash", "t.r.a.s.h", "+r@sh", "TRA$H"])
def test_restores_disguised_words(spark, disguise):
    model = character_model(spark, "take out the trash and the other trash of this house " * 5)
    assert "trash" in toxicity.Restorer(model).words(f"so {disguise} it is")
    assert "trash" in toxicity.restore(f"so {disguise} it is", toxicity.Restorer(model))


@pytest.mark.parametrize("disguise", ["tra" + "a" * 60 + "sh", "house.and/the-other_take,out.the/house-and_trash", "+@$#", "tr4sh/" * 9, "的" * 30 + "，trash。" + "的" * 30, "the/trash"])
def test_restores_long_chained_and_letterless_tokens(spark, disguise):
    model = character_model(spark, "take out the trash and the other trash of this house tas " * 5)
    want = "tas" if disguise == "+@$#" else "trash"
    assert want in toxicity.Restorer(model).words(f"so {disguise} it is")


def test_toxicity_on_held_out_rows(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity(d, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got["predicted"] == 1) & (got["toxic"] == 0)).sum() <= 2
    assert ((got["predicted"] == 1) & (got["toxic"] == 1)).sum() >= 0.5 * got["toxic"].sum()


def test_toxicity_of_odd_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(empty, none).count() == 0
    some = spark.createDataFrame([(i, 0, i % 2) for i in range(40)] + [(1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        got = toxicity.toxicity(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]


def test_base_spans_against_the_patterns():
    r = random.Random(2)
    for _ in range(4000):
        t = "".join(r.choices("a1.@-+ 2(%", k=r.randrange(40)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("4111 1111 1111 1111") == [("card", 0, 19)]


def test_gradients_of_the_tagger():
    t = pii.Tagger(dtype=np.float64)
    r = np.random.default_rng(0)
    x, y = r.integers(1, 90, (3, 10)), r.integers(0, pii.TAGS, (3, 10))
    _, g = t.gradients(x, y)
    for k in g:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        t.p[k][at] += 1e-5
        up = t.gradients(x, y)[0]
        t.p[k][at] -= 2e-5
        down = t.gradients(x, y)[0]
        t.p[k][at] += 1e-5
        assert math.isclose((up - down) / 2e-5, g[k][at], rel_tol=1e-4)


def test_personal_data(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "n_chars")
    odd = spark.createDataFrame([(-1, None, 0), (-2, "x" * 5000 + " call +1 (555) 123-4567 " + "y" * 5000, 0), (-2, "a@b.co", 0)], d.schema)
    got = pii.personal_data(d.union(odd)).collect()
    texts = {(r["doc_id"], r["text"] or "") for r in d.union(odd).collect()}
    by_id = {i: t for i, t in texts if i != -2}
    for r in got:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        if r["doc_id"] != -2:
            base = brute_spans(by_id[r["doc_id"]])
            assert set(base) <= set(spans) and r["n_email"] == sum(k == "email" for k, _, _ in base)
    assert len(got) == d.count() + 3


def test_tagger_finds_other_spellings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    tagger = pii.fit(docs)
    text = "please write to john.doe (at) example (dot) com and wait"
    assert [text[a:b] for _, a, b in pii.found([text], tagger)[0][1]] == ["john.doe (at) example (dot) com"]
    # Spans that it hasn't seen, respelled and planted in texts; and texts as they are, where it may add next to nothing.
    texts, r = [x["text"] for x in docs.orderBy("doc_id").limit(800).collect()], np.random.default_rng(99)
    hits = added = planted = 0
    for k, own in enumerate(texts[:400]):
        kind = pii.KINDS[k % 4]
        span, words = pii.respelled(kind, pii.made(kind, r), r), own.split(" ")[:60]
        at = int(r.integers(0, len(words) + 1))
        before = "".join(f"{w} " for w in words[:at])
        ((base, spans),) = pii.found([f"{before}{span} {' '.join(words[at:])}"], tagger)
        if (want := (kind, len(before), len(before) + len(span))) not in base:
            planted, hits, added = planted + 1, hits + (want in spans), added + len(set(spans) - set(base))
    assert hits >= 0.9 * planted and hits >= 0.9 * added and planted > 300
    assert sum(len(spans) - len(base) for base, spans in pii.found(texts, tagger)) <= 8


def test_personal_data_columns_against_the_patterns(spark):
    r = random.Random(7)
    texts = [None, "", *("".join(r.choices(["a", "1", ".", "@", "-", "+", " ", "2", "(", "555-1234 ", "9.8.7.6 ", "a@b.cd ", "+1 (555) 123-4567 ", "4111 1111 1111 1111 "], k=r.randrange(30))) for _ in range(200))]
    got = {x["doc_id"]: x for x in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_personal_data_of_nothing(empty):
    assert pii.personal_data(empty).count() == 0


def vectors(spark, n=400, dim=5, seed=0):
    r = np.random.default_rng(seed)
    v = r.integers(-3, 4, (n, dim)).astype(float).tolist()
    rows = [(i, x) for i, x in enumerate(v)]
    rows += [(n, None), (n + 1, [0.0] * dim), (n + 2, [float("nan"), *[1.0] * (dim - 1)]), (n + 3, [None, *[1.0] * (dim - 1)]), (500, [1.0, 2.0]), (600, [1.0, 3.0]), (None, [1.0] * dim), (7, v[7])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def brute_search(rows, k):
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q in sorted(i for i in good if i % 100 == 0):
        near = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:k]
        out += [(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(near)]
    return out


@pytest.mark.parametrize(("shard", "part", "queries"), [(16_384, 16_384, 1024), (50, 20, 2), (3, 400, 400)])
def test_search(spark, shard, part, queries):
    df = vectors(spark)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in vp_search.search(df, shard=shard, part=part, queries=queries).collect())
    assert got == brute_search([tuple(r) for r in df.collect()], 10)


def test_search_among_equidistant_and_equal_vectors(spark):
    eye = np.eye(300)
    for v in (eye, np.ones((300, 4)), np.vstack([np.tile([1.0, 2.0], (250, 1)), np.random.default_rng(2).normal(size=(50, 2))])):
        rows = [(i, x) for i, x in enumerate(v.tolist())]
        got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in vp_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=40, part=30).collect())
        assert got == brute_search(rows, 10)
    big = np.eye(1600)
    assert vp_search.Tree(np.arange(1600), big, 8).search(np.array([5]), big[5:6], 3)[0].tolist() == [[0, 1, 2]]


def test_recall_of_relaxed_search(spark):
    r = np.random.default_rng(4)
    v = (r.normal(size=(20, 6))[r.integers(0, 20, 3000)] * 4 + r.normal(size=(3000, 6))).tolist()
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    exact, near = ({(x["query_id"], x["vec_id"]) for x in vp_search.search(df, factor=f, shard=100).collect()} for f in (1.0, 1.2))
    assert len(exact) == 300 and len(exact & near) >= 0.9 * len(exact)


def test_relaxed_pruning_keeps_recall():
    r = np.random.default_rng(1)
    v = r.normal(size=(3000, 8))
    t = vp_search.Tree(np.arange(3000), v, leaf=32)
    q = np.arange(0, 3000, 100)
    exact, _ = t.search(q, v[q], 10, 1.0)
    near, _ = t.search(q, v[q], 10, 1.3)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact.tolist(), near.tolist(), strict=True)]) >= 0.9
    same = vp_search.Tree(np.arange(500), np.ones((500, 3)), leaf=8)
    assert same.search(np.array([100]), np.ones((1, 3)), 3)[0].tolist() == [[0, 1, 2]]


def test_search_in_nothing(spark):
    assert vp_search.search(vectors(spark).filter("false")).count() == 0


def targets(sizes):
    """Water-filling by steps."""
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, out = 1.5 * sum(sizes.values()), {}
    while len(out) < len(sizes):
        open_ = [s for s in sizes if s not in out]
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if level * weights[s] > 2 * sizes[s]]
        for s in full or open_:
            out[s] = float(2 * sizes[s]) if full else level * weights[s]
        if full:
            left -= sum(2 * sizes[s] for s in full)
    return out


def test_mixing(docs, rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, _, s in rows}
    sizes = {}
    for i in [*size, 3]:
        sizes[source[i]] = sizes.get(source[i], 0) + size[i]
    want, got = targets(sizes), mixing.mix(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s] and math.isclose(r["target"], want[s]) and 0 <= r["taken"] <= 2 * r["size"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    copies = {}
    for r in mixing.emit(docs).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert all(copies.get(r["doc_id"], 0) == r["copies"] * (2 if r["doc_id"] == 3 else 1) for r in got)
    assert mixing.emit(docs).columns == docs.columns


def test_mixing_comes_near_its_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = mixing.mix(d).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "first"}).collect()
    assert all(abs(r[1] / r[2] - 1) < 0.08 for r in got)


def test_mixing_of_nothing(spark, empty):
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0.0)] * 2


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op5_vp_search", "op8_mixing", "op10_exact_dedup"])
def test_queries_equal_their_sql(spark, name):
    from blockweave.llm import registry

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df, rel = registry.queries()[name](spark, "/root/testdata/sf0.001"), con.sql(registry.oracle_sql()[name])
    order = sorted(df.columns)
    pick = lambda cols, data: sorted(tuple(r[cols.index(c)] for c in order) for r in data)
    assert pick(rel.columns, rel.fetchall()) == pick(df.columns, [tuple(r) for r in df.collect()])


def test_vp_tree_measures_few_pairs(monkeypatch):
    """Products of vectors rule most pairs out; ties, the query's own row and large components included, results are exact."""
    r = np.random.default_rng(6)
    v = r.normal(size=(2000, 16))
    v[1000:1100] = v[:100]
    v[1500:1520] *= 1e8
    measured, pairs = [], vp_search.pair_distances
    monkeypatch.setattr(vp_search, "pair_distances", lambda a, b: measured.append(len(a)) or pairs(a, b))
    ids, rows = np.arange(2000), np.arange(0, 2000, 10)
    got, far = vp_search.Tree(ids, v).search(rows, v[rows])
    d = vp_search.distances(v[rows], v)
    d[np.arange(len(rows)), rows] = np.inf
    want = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :10]
    assert (got == want).all() and (far == np.take_along_axis(d, want, 1)).all()
    assert sum(measured) * 5 < len(rows) * 2000

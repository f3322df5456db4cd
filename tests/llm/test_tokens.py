"""Token counts, packing and the pipeline against the tokenizer library and brute force."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockweave.llm import packing, token_counts
from test_dedup import near_groups

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a<|endoftext|>b  <|endoftext|>", "  \n\n x　y's 'S don't WE'RE", "\U0001f600 é́ a\x1cb\x85c", "日本語 テスト ΑΣ ΣΑΣ ß ẞ İx ﬁ", "12a3 naïve’s <|startoftext|>x", "x" * 3000]


def test_token_counts(spark, docs, texts):
    t = Tokenizer.from_file(BYTES)
    all_texts = {**texts, **{1000 + i: x for i, x in enumerate(ODD)}}
    extra = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(ODD)], "doc_id long, text string")
    got = token_counts.token_counts(docs.select("doc_id", "text").union(extra), BYTES).collect()
    for r in got:
        x = all_texts[r["doc_id"]]
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(x.encode()), n, n > 512)
    assert len(got) == len(all_texts) + 1


def test_whole_tokens_are_whole():
    t, whole = Tokenizer.from_file(BYTES), token_counts.whole_tokens(BYTES)
    assert len(whole) > 40_000 and all(len(t.encode(s, add_special_tokens=False).ids) == 1 for s in list(whole)[::500])


def test_word_ids_equal_the_library():
    t, w = Tokenizer.from_file(WORDS), packing.Words(WORDS)
    for x in [*ODD, *(k.replace("</w>", " ") for k in list(t.get_vocab())[::300])]:
        assert w.ids(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def check_pack(got, texts):
    t, by_doc, by_seq = Tokenizer.from_file(WORDS), {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids, at = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048
    return sum(r["length"] for r in got) / (2048 * len(by_seq))


def test_packing(docs, texts):
    check_pack(packing.pack(docs.dropDuplicates(["doc_id"]), WORDS).collect(), texts)
    assert packing.pack(docs, WORDS, bucket=10).count() > packing.pack(docs.dropDuplicates(["doc_id"]), WORDS, bucket=10).count()


def test_packing_pads_little(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert check_pack(packing.pack(d, WORDS).collect(), {r["doc_id"]: r["text"] for r in d.collect()}) > 0.99


def test_packing_of_nothing(empty):
    assert packing.pack(empty, WORDS).count() == 0


def test_least_squares():
    r = np.random.default_rng(0)
    a, x = r.random((12, 5)), np.array([0, 1.5, 0, 2, 0.25])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    b = r.random(12) - 0.5
    got = packing.nnls(a, b)
    gain = a.T @ (b - a @ got)
    assert (got >= 0).all() and (gain <= 1e-6).all() and abs(gain @ got) < 1e-6
    assert all(sum(c) == 32 for c in packing.combos())


def test_pipeline_against_its_stages(spark, tmp_path, rows):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = f"file://{tmp_path}"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, 0) for r in rows], schema).write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts, kept = {r[0]: r[1] or "" for r in rows}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.written(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = sorted(r["doc_id"] for r in docs.collect())
    said = corpus_pipeline.lang_id.language_id(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert kept["language_id"] == sorted(r["doc_id"] for r in said if r["lang_pred"] != "und")
    assert len(kept["language_id"]) > 0.9 * sum(any(map(str.isalpha, t)) for t in texts.values())
    last = {}
    for i in kept["language_id"]:
        last["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[i])] = i
    assert kept["exact_dedup"] == sorted(last.values())
    own = [(i, texts[i]) for i in kept["exact_dedup"]]
    assert kept["simhash_near_dedup"] == sorted({own[k][0] for k in near_groups(own).values()})
    near = set(kept["simhash_near_dedup"])
    first = spark.read.parquet(f"{sf}/documents.parquet").filter(F.col("doc_id").isin(*near))
    copies = {r["doc_id"]: r["copies"] for r in corpus_pipeline.mixing.mix(first).collect()}
    assert kept["mixing"] == sorted(i for i, n in copies.items() for _ in range(n)) and set(copies) == near
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got if r["start"] == 0) == kept["mixing"]
    assert sum(r["length"] for r in got) == sum(len(Tokenizer.from_file(WORDS).encode(texts[i], add_special_tokens=False).ids) + 1 for i in kept["mixing"])

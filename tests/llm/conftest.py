import random

import pytest

#: Names that the operators use inside.
CLASH = ["fp", "h", "norm", "label", "size", "bucket", "anchor", "doc", "mark", "held_out", "score", "kept", "_row", "_mix", "words"]


def corpus(n=60, seed=1):
    """(doc_id, text, lang, source): prose of small vocabularies with copies, shared passages, empty, null and long texts."""
    r = random.Random(seed)
    vocab = {"en": ["the", "and", "thing", "over", "house", "walk", "river"], "de": ["der", "und", "schön", "haus", "über", "gehen"], "fr": ["le", "été", "maison", "où", "avec", "être"]}
    passage = " ".join(r.choices([f"p{i}" for i in range(50)], k=60))
    rows = []
    for i in range(n):
        lang = r.choice(list(vocab))
        words = [w if r.random() < 0.8 else w + r.choice(vocab[lang]) for w in r.choices(vocab[lang], k=r.choice([1, 2, 5, 40, 120]))]
        text = " ".join(words)
        if i % 5 == 0:
            text = text[: len(text) // 2] + " " + passage + "\n" + text[len(text) // 2 :]
        rows.append((i, text.capitalize(), lang, f"s{i % 4}" if i % 9 else None))
    rows += [(n + i, rows[i % 7][1].upper() if i % 2 and rows[i % 7][1].isascii() else rows[i % 7][1], rows[i % 7][2], "s1") for i in range(14)]
    rows += [(n + 20, "", "en", "s0"), (n + 21, None, None, None), (n + 22, " \n\t", None, "s2"), (n + 23, "12 34 !?", "en", "s0"), (n + 24, "a " * 5000, "en", "s3"), (n + 25, passage, "en", "s0")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with further columns whose names clash, one row repeated."""
    data = [(*x, 0, *["x"] * len(CLASH)) for x in [*rows, rows[3]]]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")


@pytest.fixture(scope="session")
def texts(rows):
    return {i: t or "" for i, t, *_ in rows}

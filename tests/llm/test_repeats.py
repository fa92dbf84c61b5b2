"""Substring dedup against a plain search, and on odd texts."""

import hashlib
import random

import pytest

from eventloom.llm import repeats
from eventloom.llm.queries import QUERIES

from .conftest import prose

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    return "".join(" " if c in SPACE else c for c in text or "").split(" ")


def plain(docs, size=13):
    least = {}
    texts = [(i, [w for w in split(t) if w]) for i, t in docs]
    for i, words in texts:
        for at in range(len(words) - size + 1) if i is not None else ():
            w = tuple(words[at : at + size])
            least[w] = min(least.get(w, i), i)
    out = []
    for i, words in texts:
        gone = set()
        for at in range(len(words) - size + 1) if i is not None else ():
            if least[tuple(words[at : at + size])] < i:
                gone |= set(range(at, at + size))
        kept = " ".join(w for at, w in enumerate(words) if at not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def documents(seed):
    draw = random.Random(seed)
    passages = [prose(seed + i, draw.randint(5, 40)) for i in range(8)] + [prose(seed, 13), "a " * 14, "b", "x y " * 20]
    docs = []
    for i in range(120):
        parts = [draw.choice(passages) if draw.random() < 0.5 else prose(1000 * seed + 7 * i + j, draw.randint(1, 30)) for j in range(draw.randrange(6))]
        docs.append((draw.randrange(100), draw.choice(["  ", "\n", " "]).join(parts)))
    docs += [(200 + i, docs[3][1]) for i in range(30)] + [(None, docs[3][1]), (None, docs[5][1]), (5, None), (6, ""), (7, " \n")]
    # words with bytes below the blank, and one word that begins another
    docs += [(300, "q " * 12 + "q\x01z r"), (301, "q " * 13 + "r"), (302, "q " * 12 + "q\x01z s"), (303, "q " * 12 + "qq")]
    return docs + docs[:2]


@pytest.mark.parametrize("group", [50_000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_kept_words_equal_a_plain_search(spark, monkeypatch, group, seed):
    monkeypatch.setattr(repeats, "GROUP", group)
    docs = documents(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in repeats.without_repeats(df).collect()]
    assert sorted(got, key=repr) == plain(docs)
    assert sum(r[2] for r in got) > 1000


def test_the_query_on_odd_documents(spark, odd_dir, odd_documents):
    ids, texts, _, _ = odd_documents
    rows = QUERIES["op12_substring_dedup"](spark, odd_dir).collect()
    assert sorted(map(tuple, rows), key=repr) == plain(zip(ids, texts))


def test_the_query_on_an_empty_table(spark, empty_dir):
    assert QUERIES["op12_substring_dedup"](spark, empty_dir).collect() == []

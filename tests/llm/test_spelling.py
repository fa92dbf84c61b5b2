"""Spelling variants against all pairs, and on odd texts."""

import random
import re
import zlib
from collections import Counter

import pytest

from eventloom.llm import spelling
from eventloom.llm.queries import QUERIES


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v.encode()), default=None)
        form[word] = best if best and counts[best] >= 2 * counts[word] else None
    rows = []
    for word, n in counts.items():
        root = word
        while form[root]:
            root = form[root]
        rows.append((word, form[word], root, n, len(near[word]), form[word] and counts[form[word]]))
    return sorted(rows)


def vocabulary(seed, size, letters):
    draw = random.Random(seed)
    words = set()
    while len(words) < size:
        word = "".join(draw.choice(letters) for _ in range(draw.randint(5, 9)))
        words.add(word)
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(word))
            word = word[:at] + draw.choice(["", draw.choice(letters), word[at] + draw.choice(letters)]) + word[at + 1 :]
            if len(word) >= 5:
                words.add(word)
    return {w: draw.randint(3, 100) for w in sorted(words)}


@pytest.mark.parametrize("letters", ["abcdefghijklmnopéàüÿ", "ab"])
@pytest.mark.parametrize("leaf", [1 << 15, 200])
def test_variants_equal_all_pairs(spark, monkeypatch, letters, leaf):
    monkeypatch.setattr(spelling, "LEAF_LETTERS", leaf)
    counts = vocabulary(len(letters) + leaf, 500, letters)
    counts |= {"aaaaa" * 60: 7, "aaaaa" * 60 + "a": 20, "b" + "aaaaa" * 60: 3}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(df).collect())) == plain_variants(counts)


def test_anagrams_cannot_be_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LEAF_LETTERS", 50)
    draw = random.Random(5)
    counts = {"".join(draw.sample("abcdefg", 7)): draw.randint(3, 50) for _ in range(300)}
    counts |= {w[:3] + "z" + w[4:]: 400 + i for i, w in enumerate(list(counts)[:20])}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(df).collect())) == plain_variants(counts)


def plain_counts(ids, texts):
    counts = Counter()
    for doc_id, text in zip(ids, texts):
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def test_the_query_on_odd_documents(spark, odd_dir, odd_documents):
    ids, texts, _, _ = odd_documents
    rows = QUERIES["op13_spelling_variants"](spark, odd_dir).collect()
    assert sorted(map(tuple, rows)) == plain_variants(plain_counts(ids, texts))


def test_letters_and_cases(spark):
    texts = ["Élan élane ÉLANE", "abcdef×÷ø abcdeĀfghij", "x" * 3000, None, "", "WORDS words Words"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "words")], "doc_id long, text string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert got == {"élane": 1, "ÉlanE".replace("E", "e"): 1, "abcdef×÷ø": 1, "abcde": 1, "fghij": 1, "x" * 3000: 1, "words": 4}


def test_the_query_on_an_empty_table(spark, empty_dir):
    assert QUERIES["op13_spelling_variants"](spark, empty_dir).collect() == []

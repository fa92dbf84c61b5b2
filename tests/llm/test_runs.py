"""Periodic runs against a plain search, and on odd texts."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from eventloom.llm import runs
from eventloom.llm.queries import QUERIES


def plain_runs(words):
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    found = {}
    for period in range(1, len(ids) // 3 + 1):
        same = np.concatenate(([0], ids[period:] == ids[:-period], [0]))
        edges = np.flatnonzero(np.diff(same))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            size = end - start + period
            if size >= max(24, 3 * period):
                found.setdefault((start, size), period)
    return sorted(((s, size, p) for (s, size), p in found.items()), key=lambda r: (r[0], r[2]))


def periodic_text(seed):
    draw = random.Random(seed)
    words = []
    for _ in range(draw.randint(1, 6)):
        some = draw.choice([1, 2, 3, 40])
        unit = [str(draw.randrange(some)) for _ in range(draw.choice([1, 2, 3, 5, 8, 12, 20]))]
        words += (unit * draw.randint(1, 40))[: draw.randint(1, 120)]
        if draw.random() < 0.3:
            words += words[-draw.randint(1, 60) :]
    return words


@pytest.mark.parametrize("block", range(4))
def test_runs_equal_a_plain_search(block):
    texts = [" ".join(periodic_text(100 * block + i)) for i in range(100)]
    found = [r for _, r in runs.runs_of([t.encode() for t in texts])]
    assert found == [plain_runs(t.split()) for t in texts]
    assert any(found)


def test_chunks_do_not_change_runs(monkeypatch):
    texts = [" ".join(periodic_text(i)).encode() for i in range(60)] + [None, b"", b" \n"]
    whole = list(runs.runs_of(texts))
    monkeypatch.setattr(runs, "CHUNK", 100)
    assert list(runs.runs_of(texts)) == whole


def test_bounds_of_a_run():
    words = [f"w{i}" for i in range(30)]
    for words_more, want in (
        (["a"] * 23, []),
        (["a"] * 24, [(30, 24, 1)]),
        ([*"abcdefgh"] * 3, [(30, 24, 8)]),
        ([*"abcdefghi"] * 3, [(30, 27, 9)]),
        (([*"abcdefghi"] * 3)[:-1], []),
    ):
        ((_, found),) = runs.runs_of([" ".join(words + words_more + ["end"]).encode()])
        assert found == want


def test_a_long_periodic_text_is_linear():
    ((_, found),) = runs.runs_of([b" ".join(b"%d" % (i % 7000) for i in range(100_000))])
    assert found == [(0, 100_000, 7000)]


def planted(doc_id, text):
    words = (text or "").split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    a = h // 10 % len(words)
    p = 1 + (len(words) - a) // (3 + h // 10 % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_the_query_on_odd_documents(spark, odd_dir, odd_documents):
    ids, texts, _, _ = odd_documents
    want = []
    for doc_id, text in zip(ids, texts):
        words = planted(doc_id, "" if text and "　" in text else text)
        if text and "　" in text:
            words = text.split(" ")
        found = plain_runs(words)
        kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + size for s, size, p in found)]
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        turns = best[1] and 1000 * best[1] // best[2]
        lines = "".join(f"{s},{size},{p}\n" for s, size, p in found)
        want.append((doc_id, len(found), *best, turns, sha(lines), sha(" ".join(kept))))
    rows = QUERIES["op11_periodic_runs"](spark, odd_dir).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert any(w[1] for w in want)


def test_the_query_on_an_empty_table(spark, empty_dir):
    assert QUERIES["op11_periodic_runs"](spark, empty_dir).collect() == []

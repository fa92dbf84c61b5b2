"""Numbers of single pieces of text against a plain count."""

import re
import time

import numpy as np
import pytest

from eventloom.llm import toxicity

LEXICON = toxicity.Lexicon(frozenset({"idiot", "and"}), frozenset({"idio", "mor"}))
PIECES = [
    "and", "And", "AND", "IDIOT!", "idiots?", "You,", "YOU?", "İST!", "STR.", "ß", "²", "a²", "!", "..", "ab.!", "A中中",
    "𝐀𝐁𝐂", "Ǆ.", "1d10t", "id!ot", "i.d.i.o.t", "a_b", "don't", "word&&&", "A" * 70_000 + "!", "a" * 70_000 + "1",
]


@pytest.mark.parametrize("piece", PIECES, ids=range(len(PIECES)))
def test_piece_numbers(piece):
    lower = piece.lower()
    words, own = re.findall(r"[^\W\d_]+", lower), re.findall(r"[^\W\d_]+", piece)
    letters, digits = sum(map(len, words)), sum(c.isdigit() for c in piece)
    got = np.frombuffer(toxicity._numbers(LEXICON)(piece), dtype="<u4").tolist()
    want = [
        len(words), sum(w in LEXICON.words for w in words), sum(w[:4] in LEXICON.beginnings for w in words),
        sum(w in toxicity.SECOND_PERSON for w in words), sum(c.isupper() for c in piece),
        sum(len(w) > 2 and w.isupper() for w in own), piece.count("!"), piece.count("?"),
        max(len(piece) - letters - digits, 0), digits,
    ]
    assert got[:10] == want
    assert got[12] == letters


def test_masked_spellings():
    numbers = {p: np.frombuffer(toxicity._numbers(LEXICON)(p), dtype="<u4").tolist()[10:12] for p in ("1d10t", "id!ot", "i.d.i.o.t", "idi0t")}
    assert numbers == {"1d10t": [1, 0], "id!ot": [1, 1], "i.d.i.o.t": [1, 1], "idi0t": [1, 1]}


def test_long_runs_take_linear_time():
    start = time.perf_counter()
    toxicity._numbers(LEXICON)("a" * 400_000 + "1")
    assert time.perf_counter() - start < 20


def test_counts_of_very_long_pieces():
    lexicon = toxicity.Lexicon(frozenset({"bad"}), frozenset())
    names = list(toxicity.FEATURES)
    for n in (10, 70_000, 200_000):
        found = toxicity.features_of("!" * n, lexicon)
        assert 1.0 in found and found == toxicity.features_of("!" * 10, lexicon), names
    letters = toxicity.features_of("A" * 100_000, lexicon)
    assert letters == [*toxicity.features_of("A" * 100, lexicon)[:-1], 100_000.0]


def test_many_secrets_take_linear_time():
    import time

    from eventloom.llm import secrets

    def took(n):
        text = "\n".join(f"token = 'k{i:07d}x9Qz' and a cookie q9Zx81Lm{i:06d}PvT4sKd" for i in range(n))
        start = time.process_time()
        found = secrets.spans_of(text)
        assert sum(s.kind == "assign" for s in found) == n
        return time.process_time() - start

    small = max(took(1000), 0.05)
    assert took(8000) < 16 * small

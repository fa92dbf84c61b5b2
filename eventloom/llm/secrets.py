"""Secrets: fixed patterns, and strings that a primed compressor cannot shorten.

Beside the three patterns, long strings beside a sensitive word, and the lines
that go on with such a string, are weighed: zstandard, primed with identifier words and with the
text around the string, compresses the string, and what it adds in bytes is its
novelty. Other copies of the string are taken out of that text, so a key counts
wherever it stands; and the bytes are compared with what the same characters add
in random order, so that small alphabets count too. Names and paths are cheap,
random keys are not; words that the compressor does not know are told by their
letters.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns, the least length of what they must match, their order.
ASSIGN = re.compile(
    r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "novel")

#: Candidates for the novelty measure, and the words that make a context sensitive.
LEAST_CHARS = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
PARTS = re.compile(r"[=/]")
CONTEXT = re.compile(
    r"password|passwd|pwd|secret|token|key|auth|bearer|credential|private|signature|session|cookie|login", re.I | re.A
)
CONTEXT_CHARS = 48
SURROUNDING_CHARS = 1024
#: What ends a line of candidates, written out or escaped, with quotes and indents.
LINE_GAP = 32
LINE_END = re.compile(r"(?:[\x20\t\"'`,;>#*+|\\]|\\r)*(?:\r?\n|\\n)[\s\"'`,;>#*+|\\]*")
#: Added bytes, of those that the same characters add in random order, from which
#: a string counts as incompressible; and the least bits of its characters.
NOVELTY, LEAST_BITS = 0.75, 40.0
#: Bits a letter below which a string without digits reads as words. Words of code and
#: prose take up to 6.0, random letters of one case 5.8 or more, of both cases 6.8 or more.
WORD_BITS = 6.1

#: Identifier words that prime the compressor, beside the surrounding text.
IDENTIFIERS = (
    "access account action address admin algorithm api application archive argument array async attribute "
    "authorization await base bearer binary body boolean bucket buffer build cache callback certificate channel "
    "char class client cloud cluster code column command comment commit component config configuration connection "
    "const constructor container content context cookie count create credential database date debug default delete "
    "deploy description development device directory document domain double download element email enable encoding "
    "endpoint environment error event example exception execute export expression extends false file filter float "
    "folder format function gateway generate github group handler hash header host http https identifier image "
    "implements import index input instance integer interface item json key language length library license list "
    "local localhost location log login main management manager message method model module name namespace network "
    "node null number object option order output package page parameter parent password path pattern payload "
    "permission platform plugin port prefix private process production profile project property protected provider "
    "proxy public query queue random range read record reference region register release remote replace report "
    "repository request require reserved resource response result return role root route runtime schema script "
    "search secret section secure security select sequence server service session setting signature size socket "
    "source stack start state static status storage stream string struct subject submit switch system table target "
    "task template test text thread time timeout timestamp title token total transaction true type undefined unique "
    "update upload user username utility value variable version view void width window workspace write "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 ---------------- ================"
).encode()


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    novelty: float | None


def _around(text: str, start: int, end: int) -> str:
    """The text around a piece, with copies of the piece and of its long parts blanked."""
    piece = text[start:end]
    # Copies that reach over the outer bounds are seen whole.
    low, first = max(0, start - SURROUNDING_CHARS - len(piece)), max(0, start - SURROUNDING_CHARS)
    before, after = text[low:start], text[end : end + SURROUNDING_CHARS + len(piece)]
    for part in sorted({piece, *(p for p in PARTS.split(piece) if len(p) >= LEAST_CHARS)}, key=lambda p: (-len(p), p)):
        before, after = (side.replace(part, "\n" * len(part)) for side in (before, after))
    return before[first - low :] + "\n" + after[:SURROUNDING_CHARS]


def novelty(text: str, start: int, end: int) -> float:
    """Bytes that a piece of text adds after its surroundings without copies of it,
    as a share of what its characters in random order would add."""
    around = _around(text, start, end)
    prime = zstandard.ZstdCompressionDict(
        IDENTIFIERS + b"\n" + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    press = zstandard.ZstdCompressor(
        level=6, dict_data=prime, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    piece = text[start:end].encode()
    none = len(press.compress(b""))
    added = len(press.compress(piece)) - none
    if added >= NOVELTY * len(piece):  # no order adds more than all bytes
        return added / len(piece)
    order = np.random.default_rng(len(piece)).permutation(len(piece))
    mixed = np.frombuffer(piece, dtype="u1")[order].tobytes()
    return added / min(len(piece), len(press.compress(mixed)) - none)


def _own_bits(piece: str) -> float:
    """Bits of a string by the frequencies of its own characters."""
    return sum(n * math.log2(len(piece) / n) for n in Counter(piece).values())


def _like_words(piece: str, around: str) -> bool:
    """Whether letters follow each other as in the identifier words and the text
    around: three-letter frequencies without case, and changes of case."""
    known = IDENTIFIERS.decode().lower() + "\n" + around.lower()
    one, two, three = Counter(known), Counter(zip(known, known[1:])), Counter(zip(known, known[1:], known[2:]))
    low, bits = "  " + piece.lower(), 0.0
    for a, b, c in zip(low, low[1:], low[2:]):
        chance = (one[c] + 0.5) / (len(known) + 32)
        chance = (two[b, c] + 4 * chance) / (one[b] + 4)
        bits -= math.log2((three[a, b, c] + 4 * chance) / (two[a, b] + 4))
    turns = sum(a.isupper() != b.isupper() for a, b in zip(piece, piece[1:]))
    bits += turns * math.log2(10) + (len(piece) - 1 - turns) * math.log2(10 / 9)
    return bits < WORD_BITS * len(piece)


def base_spans(text: str) -> list[Span]:
    found = [Span("access", *m.span(), None) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [Span("hex", *m.span(), None) for m in HEX.finditer(text)]
    if ":" in text or "=" in text:
        found += [Span("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    return found


def _sensitive(text: str, places: list[tuple[int, int]], assigned: list[tuple[int, int]]) -> list[bool]:
    """Whether a sensitive word stands near, or names the string in front of a "=";
    what holds for a line of candidates holds for the lines next to it. A word that
    follows and has a value of its own (``assigned``) does not count."""
    near = []

    def free(word: int) -> bool:
        at = bisect.bisect_right(assigned, (word, len(text))) - 1
        return at < 0 or assigned[at][1] <= word

    for start, end in places:
        name = text.find("=", start, end)
        named = start if name < 0 or name > start + CONTEXT_CHARS or not text[name + 1 : end].strip("=") else name
        near.append(
            CONTEXT.search(text, max(0, start - CONTEXT_CHARS), named) is not None
            or any(free(m.start()) for m in CONTEXT.finditer(text, end, end + CONTEXT_CHARS))
        )
    joined = [
        a[1] + LINE_GAP >= b[0] and LINE_END.fullmatch(text, a[1], b[0] + (text[b[0] - 1 : b[0] + 1] == "\\n")) is not None
        for a, b in zip(places, places[1:])
    ]
    for i, next_line in enumerate(joined):
        near[i + 1] |= next_line and near[i]
    for i in range(len(joined) - 1, -1, -1):
        near[i] |= joined[i] and near[i + 1]
    return near


def spans_of(text: str | None) -> list[Span]:
    """All spans by start, then kind; none in a missing or empty text.

    A novel span never overlaps one of the fixed patterns.
    """
    if not text:
        return []
    found = base_spans(text)
    # Stretches of the fixed patterns, apart from each other and in order.
    taken: list[tuple[int, int]] = []
    for start, end in sorted((s.start, s.end) for s in found):
        if taken and start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(taken[-1][1], end))
        else:
            taken.append((start, end))

    def overlaps(start: int, end: int) -> bool:
        at = bisect.bisect_left(taken, (end,)) - 1
        return at >= 0 and taken[at][1] > start

    places = [m.span() for m in CANDIDATE.finditer(text)]
    assigned = [(s.start, s.end) for s in found if s.kind == "assign"]
    for (start, end), sensitive in zip(places, _sensitive(text, places, assigned)):
        if not sensitive or overlaps(start, end):
            continue
        piece = text[start:end]
        if _own_bits(piece) < LEAST_BITS:
            continue
        measure = novelty(text, start, end)
        if measure < NOVELTY:
            continue
        if any(map(str.isdigit, piece)) or not _like_words(piece, _around(text, start, end)):
            found.append(Span("novel", start, end, measure))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,novelty:double>>"


def spans(text: Column) -> Column:
    """Secret spans of a text column, positions in code points, ends exclusive."""
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())])
    )

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[s._asdict() for s in spans_of(t)] for t in texts.to_pylist()], kind)

    return run(text)


def digest(spans_column: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    one = F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")

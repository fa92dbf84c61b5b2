"""License notices: MinHash bands over overlapping windows, then containment.

A text's windows have as many shingles as a template and overlap by three
quarters. The smallest value of each of ``BANDS`` hash functions over a window is
a band of one row; a template that shares a band is a candidate for the texts
that the window touches. Its copies in each text are then found by the exact
share of its shingles, in that text alone.

A notice that keeps 0.8 of a template's shingles overlaps its best window with
Jaccard similarity of about 0.5 or more: all bands miss it with a chance of
0.5 ** BANDS, below one in a thousand; an exact copy, with 0.78, with one in 10
million. A template of one shingle needs a single band and is never missed.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .decontam import seed_hashes, word_hashes

SHINGLE = 5
LEAST = 0.8
BANDS = 10
#: Templates are sent to every task, so their number is bounded.
MOST_TEMPLATES = 5_000
#: Shingles handled at a time, for texts of any length, and texts scanned together.
PIECE, TEXTS = 65_536, 256

#: Widely used license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software"
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted"
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}


class Template(NamedTuple):
    name: str
    words: int
    shingle: int
    hashes: np.ndarray  # sorted, distinct
    orders: list[list[int]]  # where each stands in the template


class Index(NamedTuple):
    templates: list[Template]
    #: By (shingle size, window length): sorted band keys and the template of each.
    classes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


_SALTS = np.random.default_rng(5).integers(1, 2**63, size=(BANDS, 1), dtype="u8") | np.uint64(1)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Values of the hash functions (rows) for each shingle."""
    mixed = hashes.view("u8")[None, :] * _SALTS
    mixed ^= mixed >> np.uint64(29)
    return mixed


def index_templates(templates: dict[str, str]) -> Index:
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    known, classes = [], {}
    for name, text in templates.items():
        words = word_hashes(text)
        if not len(words):
            raise ValueError(f"template {name} has no words")
        size = min(SHINGLE, len(words))
        whole = seed_hashes(words, size)
        hashes, which = np.unique(whole, return_inverse=True)
        orders: list[list[int]] = [[] for _ in hashes]
        for order, shingle in enumerate(which.tolist()):
            orders[shingle].append(order)
        length = len(words) - size + 1
        keys = _mixed(hashes).min(axis=1)[: BANDS if length > 1 else 1]
        classes.setdefault((size, length), []).extend((k, len(known)) for k in keys.tolist())
        known.append(Template(name, len(words), size, hashes, orders))
    packed = {}
    for at, pairs in classes.items():
        pairs.sort()
        packed[at] = (np.array([k for k, _ in pairs], dtype="u8"), np.array([t for _, t in pairs], dtype="i8"))
    return Index(known, packed)


def _windows(mixed: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows and their smallest values."""
    if length == 1:
        return np.arange(mixed.shape[1]), mixed[:1]
    stride = max(1, length // 4)
    blocks = np.arange(0, mixed.shape[1], stride)
    parts = np.minimum.reduceat(mixed, blocks, axis=1) if stride > 1 else mixed
    per = -(-length // stride)
    count = max(1, len(blocks) - per + 1)
    out = parts[:, :count].copy()
    for step in range(1, min(per, len(blocks))):
        np.minimum(out, parts[:, step : step + count], out=out)
    return blocks[:count], out


def _hits(mixed: np.ndarray, size: int, length: int, index: Index) -> list[tuple[int, int]]:
    """(window start, template) that share a band."""
    keys, owners = index.classes[size, length]
    starts, found = _windows(mixed, length)
    out = set()
    # Bands of one row need no number: a value names its hash function but for chance.
    for band, window in zip(*np.nonzero(np.isin(found, keys))):
        at = np.searchsorted(keys, found[band, window])
        while at < len(keys) and keys[at] == found[band, window]:
            out.add((int(starts[window]), int(owners[at])))
            at += 1
    return sorted(out)


def _sharing(hashes: np.ndarray, size: int, begins: np.ndarray, index: Index) -> set[tuple[int, int]]:
    """(template, text) where a window that touches the text shares a band."""
    out = set()
    lengths = [n for s, n in index.classes if s == size]
    for at in range(0, len(hashes), PIECE):
        mixed = _mixed(hashes[at : at + PIECE + 2 * max(lengths)])
        for length in lengths:
            # A window is made of whole steps, so it may be longer than the template by one.
            reach = length + max(1, length // 4)
            for start, owner in _hits(mixed, size, length, index):
                first, last = np.searchsorted(begins, (at + start, at + start + reach - 1), side="right")
                out.update((owner, text) for text in range(first - 1, min(last, len(begins) - 1)))
    return out


def _copies(at: np.ndarray, which: np.ndarray, template: Template) -> list[tuple[int, int, int]]:
    """(first place, last place, distinct shingles) of the copies of a template in a
    text that has its shingles ``which`` at the places ``at``.

    The places are cut into runs of rising template order: two copies never share
    a run, since each has most of the order. A copy is one run, or several next to
    each other where parts were moved. Most copies come first, then most shingles,
    then the least length.
    """
    length = template.words - template.shingle + 1
    least, whole = LEAST * len(template.hashes), len(template.hashes)
    if len(np.unique(which)) < least:
        return []
    places, shingles = at.tolist(), which.tolist()
    orders: list[int] = []
    runs: list[int] = []
    torn: set[int] = set()
    for i, shingle in enumerate(shingles):
        before = orders[-1] if orders else -1
        far = i > 0 and places[i] - places[i - 1] > length
        orders.append(next((o for o in template.orders[shingle] if o > before and not far), template.orders[shingle][0]))
        if far:
            torn.add(len(runs))
        if i == 0 or far or orders[-1] <= before:
            runs.append(i)
    runs.append(len(shingles))
    best: list[tuple[int, int, int]] = [(0, 0, 0)]
    taken: list[tuple[int, int, int, int] | None] = [None]
    for end in range(1, len(runs)):
        best.append(best[-1])
        taken.append(None)
        seen: set[int] = set()
        last = runs[end] - 1
        for begin in range(end - 1, -1, -1):
            first = runs[begin]
            if begin < end - 1 and (begin + 1 in torn or places[last] - places[first] >= 3 * length):
                break
            seen.update(shingles[first : runs[begin + 1]])
            if len(seen) < least:
                continue
            a, b = _tight(orders, first, last) if begin < end - 1 else (first, last)
            count, shared, long = best[begin]
            value = (count + 1, shared + len(seen), long - (places[b] - places[a]))
            if value > best[end]:
                best[end], taken[end] = value, (begin, a, b, len(seen))
            if len(seen) == whole:
                break
    out = []
    end = len(runs) - 1
    while end > 0:
        if (take := taken[end]) is None:
            end -= 1
        else:
            end = take[0]
            out.append((places[take[1]], places[take[2]], take[3]))
    return out[::-1]


def _tight(orders: list[int], a: int, b: int) -> tuple[int, int]:
    """First and last without what stands again between them."""
    count = Counter(orders[a : b + 1])
    while count[orders[a]] > 1:
        count[orders[a]] -= 1
        a += 1
    while count[orders[b]] > 1:
        count[orders[b]] -= 1
        b -= 1
    return a, b


def notices_of(texts: list[str | None], index: Index) -> list[list[tuple[str, int, int, float]]]:
    """For each text (template, first word, word after the last, containment); none
    in an empty text. Each copy of a template in a text is one.

    The texts are scanned as one run of words, parted by words that no text has,
    for templates that share a band; the copies are then found in each text alone.
    """
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    apart = np.arange(1, SHINGLE + 1, dtype="u8") * np.uint64(0xD1B54A32D192ED03)
    words = [word_hashes(t) for t in texts]
    if not words:
        return out
    begins = np.cumsum([0, *(len(w) + SHINGLE for w in words)])
    joined = np.concatenate([x for w in words for x in (w, apart)])
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    for size in {s for s, _ in index.classes}:
        hashes = seed_hashes(joined, size)
        for owner, text in _sharing(hashes, size, begins, index):
            template = index.templates[owner]
            own = hashes[begins[text] : begins[text] + max(0, len(words[text]) - size + 1)]
            which = np.minimum(np.searchsorted(template.hashes, own), len(template.hashes) - 1)
            at = np.flatnonzero(template.hashes[which] == own)
            for a, b, shared in _copies(at, which[at], template):
                found[text].append((owner, a, b + size, shared / len(template.hashes)))
    for text, finds in enumerate(found):
        for owner, a, b, share in sorted(finds, key=lambda f: (f[1], f[2], f[0])):
            out[text].append((index.templates[owner].name, a, b, share))
    return out


NOTICES = "array<struct<license:string,first_word:bigint,end_word:bigint,containment:double>>"


def notices(text: Column, templates: dict[str, str] | None = None) -> Column:
    """License notices of a text column, positions counted in words."""
    index = index_templates(TEMPLATES if templates is None else templates)
    names = ("license", "first_word", "end_word", "containment")
    kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.float64())))))

    @F.arrow_udf(NOTICES)
    def run(texts: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(texts), TEXTS):
            found += notices_of(texts.slice(at, TEXTS).to_pylist(), index)
        return pa.array([[dict(zip(names, n)) for n in notices] for notices in found], kind)

    return run(text)

"""Tables of awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, `Text` string, `DOC_ID` int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng: np.random.Generator, n: int, size: int = 300) -> str:
    return " ".join(f"w{x}" for x in rng.integers(0, size, n))


def documents() -> list[tuple]:
    """Nulls everywhere, empty and long texts, ties, repeated rows, copies, characters of many bytes."""
    rng = np.random.default_rng(1)
    base, shared = prose(rng, 120), prose(rng, 70)
    texts = [
        base,
        base,
        base.upper(),
        base + " tail",
        base.replace("w1 ", "x "),
        prose(rng, 30) + " " + shared + " " + prose(rng, 30),
        shared + " " + prose(rng, 90),
        "",
        None,
        " \t\n",
        "one two",
        "one two",
        "ONE two",
        "a b c d e",
        "a b c\x00d e",
        "é" * 500 + " " + prose(rng, 50),
        "è" * 500 + " " + prose(rng, 50),
        "日本語 テキスト " * 40,
        "spam " * 400,
        prose(rng, 6000, 4000),
        "x" * 3000,
        "🙂" * 300,
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", "S1", None][i % 4], len(t or ""), "other", 7) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, base, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None))
    return rows


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def covered(sequences: list, width: int, key) -> list[bytearray]:
    count = Counter(key(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        mask = bytearray(len(s))
        for i in range(len(s) - width + 1):
            if count[key(s[i : i + width])] > 1:
                mask[i : i + width] = b"\1" * width
        out.append(mask)
    return out


def substrings(rows: list[tuple], width: int) -> list[tuple]:
    seqs = [words(r[1]) for r in rows]
    return [(r[0], len(s), sum(m), hashlib.sha256(" ".join(w for w, x in zip(s, m, strict=True) if not x).encode()).hexdigest()) for r, s, m in zip(rows, seqs, covered(seqs, width, tuple), strict=True)]


def byte_strings(rows: list[tuple], width: int) -> list[tuple]:
    seqs = [(r[1] or "").encode() for r in rows]
    out = []
    for r, s, m in zip(rows, seqs, covered(seqs, width, bytes), strict=True):
        spans = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        out.append((r[0], len(s), sum(m), spans, hashlib.sha256(bytes(c for c, x in zip(s, m, strict=True) if not x)).hexdigest()))
    return out


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1))))


def components(rows: list[tuple], percent: int = 80) -> list[tuple]:
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    best: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            best[find(i)] = min(r[0], best.get(find(i), r[0]))
    return [(r[0], len(s), best.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)

"""The draws of ``rng`` in numpy, a whole grid of keys and numbers at once, for Arrow batches.

``draws(heads, numbers, tails)`` is ``rng.draw`` of the text head + number +
tail: the first 32 bits of its md5.  Texts of one length are hashed together, a
word of all of them at a time; those beyond one md5 block go through hashlib.
"""

from __future__ import annotations

import hashlib

import numpy as np

_K = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFT = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages hashed together: arrays of 64 kB.
_CHUNK = 1 << 14
ONE_BLOCK = 55
#: Numbers hashed at once for all heads of a ragged grid.
BLOCK = 512


def _md5(words: list, n: int) -> tuple[np.ndarray, ...]:
    """The four words of the md5 of n one-block messages; a word is an array or, where all have the same, a number."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
        elif i < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, f)
            f ^= d
        else:  # c ^ (b | ~d)
            np.invert(d, f)
            f |= b
            f ^= c
        a += f
        w = words[_WORD[i]]
        if isinstance(w, int):
            a += np.uint32((_K[i] + w) & 0xFFFFFFFF)
        else:
            a += np.uint32(_K[i])
            a += w
        np.left_shift(a, np.uint32(_SHIFT[i]), g)
        a >>= np.uint32(32 - _SHIFT[i])
        a |= g
        a += b
        a, b, c, d = d, a, b, c
    return tuple(x + np.uint32(s) for x, s in zip((a, b, c, d), _START, strict=True))


def _by_length(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, letters) of the texts of every length."""
    size = np.array([len(t) for t in texts])
    out = []
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        out.append((at, np.frombuffer(b"".join(texts[i] for i in at), np.uint8).reshape(len(at), n)))
    return out


def _words(letters: np.ndarray, at: int) -> np.ndarray:
    """The 16 words of a block for every row, with the letters from place ``at`` on and zeros elsewhere."""
    text = np.zeros((len(letters), 64), np.uint8)
    text[:, at : at + letters.shape[1]] = letters
    return text.view("<u4")


def digests(heads: list[bytes], numbers, tails: list[bytes] | None = None, words: int = 1) -> np.ndarray:
    """(heads, numbers, words) words of the md5 of head + number + tail, each 32 bits read big-endian as its hexadecimal text.

    Head, number and tail lie side by side in a block, so its words are those of
    head and tail, by row, or those of the number, by column; no text is put
    together, and words that all messages share stay numbers.
    """
    mids = [str(int(x)).encode() for x in numbers]
    out = np.empty((len(heads), len(mids), words), np.uint32)
    ends = tails if tails is not None else [b""] * len(heads)
    by_mid = _by_length(mids)
    sizes = np.array([(len(h), len(t)) for h, t in zip(heads, ends, strict=True)]).reshape(-1, 2)
    for lh, lt in np.unique(sizes, axis=0).tolist():
        rows = np.flatnonzero((sizes == (lh, lt)).all(1))
        head = np.frombuffer(b"".join(heads[i] for i in rows), np.uint8).reshape(len(rows), lh)
        tail = np.frombuffer(b"".join(ends[i] + b"\x80" for i in rows), np.uint8).reshape(len(rows), lt + 1)
        for cols, mid in by_mid:
            lm = mid.shape[1]
            size = lh + lm + lt
            if size > ONE_BLOCK:
                for i in rows:
                    for j in cols:
                        out[i, j] = np.frombuffer(hashlib.md5(heads[i] + mids[j] + ends[i]).digest()[: 4 * words], ">u4")
                continue
            by_row = _words(head, 0) | _words(tail, lh + lm)
            by_col = _words(mid, lh)
            touched = range(lh // 4, (lh + lm - 1) // 4 + 1)
            shared = [w not in touched and bool((by_row[:, w] == by_row[0, w]).all()) for w in range(16)]
            wide = slice(cols[0], cols[-1] + 1) if cols[-1] - cols[0] + 1 == len(cols) else cols
            step = max(1, _CHUNK // len(cols))
            for at in range(0, len(rows), step):
                part, here = rows[at : at + step], by_row[at : at + step]
                shape = (len(part), len(cols))
                message = []
                for w in range(16):
                    if w == 14:
                        message.append(8 * size)
                    elif shared[w]:
                        message.append(int(by_row[0, w]))
                    elif w in touched:
                        message.append((here[:, w, None] | by_col[None, :, w]).ravel())
                    else:
                        message.append(np.repeat(here[:, w], shape[1]))
                for k, x in enumerate(_md5(message, shape[0] * shape[1])[:words]):
                    x = x.byteswap(inplace=True).reshape(shape)
                    if isinstance(wide, slice):
                        out[part, wide, k] = x
                    else:
                        out[part[:, None], wide[None], k] = x
    return out


def draws(heads: list[bytes], numbers, tails: list[bytes] | None = None) -> np.ndarray:
    """(heads, numbers) whole numbers in [0, 2**32), as ``rng.draw`` of head + number + tail."""
    return digests(heads, numbers, tails)[:, :, 0]


def ragged(heads: list[bytes], size: np.ndarray, of, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values): ``of`` the draws of head + 0, head + 1, ... of every head one after the other, ``size`` numbers each; of(draws, rows)."""
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(start[-1], dtype)
    most = int(size.max(initial=0))
    for lo in range(0, most, BLOCK):
        rows = np.flatnonzero(size > lo)
        at = np.arange(lo, min(lo + BLOCK, most))
        own = at < size[rows, None]
        out[(start[rows, None] + at)[own]] = of(draws([heads[i] for i in rows], at)[own], np.repeat(rows, own.sum(1)))
    return start, out

"""Sets of hashed word shingles, for many texts at a time."""

from __future__ import annotations

import numpy as np

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
R = np.uint64(0x9E3779B97F4A7C15)
A, B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * A
    h = (h ^ (h >> np.uint64(27))) * B
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (runs without space or \\t to \\r, A-Z lower-cased), and how many of them each text has."""
    data = [t.encode("utf-8", "surrogatepass").translate(FOLD) for t in texts]
    raw = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    inside = (raw != 32) & ~((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    begin, length = edge[::2], edge[1::2] - edge[::2]
    bounds = np.cumsum([len(d) + 1 for d in data])
    per_text = np.diff(np.searchsorted(begin, np.concatenate([[0], bounds])))
    if not len(begin):
        return np.zeros(0, np.uint64), per_text
    first = np.cumsum(length) - length
    power = np.cumprod(np.full(int(length.max()), R, np.uint64))
    place = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    sums = np.add.reduceat((raw[inside].astype(np.uint64) + np.uint64(1)) * power[place], first)
    return mixed(sums + length.astype(np.uint64)), per_text


def sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, in order of their hashes: all runs of width words, or the whole text if it has fewer."""
    words, per_text = word_hashes(texts)
    joined = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        joined = mixed(joined + words[k : k + len(joined)] + np.uint64(k + 1))
    out, at = [], 0
    for n in per_text.tolist():
        if n >= width:
            out.append(np.unique(joined[at : at + n - width + 1]))
        elif n:
            h = np.full(1, 7919 * n, np.uint64)
            for k in range(n):
                h = mixed(h * R + words[at + k : at + k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out

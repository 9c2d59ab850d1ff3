"""Hashed n-grams of many texts at once, for models that run on Arrow batches.

Texts are joined to one array of code points; windows never cross from one text into the next, and
long texts are worked through in pieces of bounded size without losing a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Code points that are worked on at once; a single longer text is taken whole.
GROUP = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def groups(texts: Iterable[str], most: int = GROUP) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` code points."""
    run: list[str] = []
    size = 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each text begins, with the end added)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def char_grams(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the window of ``order`` code points that begins at each place (fewer at the end)."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order, np.uint32)
    for k in range(order):
        h = (h ^ points[k:n + k]) * np.uint32(0x01000193 + 2 * 0x9E3779 * (k + 1) | 1)
        h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)).astype(np.int64)


def _classes() -> np.ndarray:
    """Per code point: 0 white space, 1 other letter or digit, 2 lower case, 3 upper case, 4 digit, 5 rest."""
    out = np.full(0x10000, 1, np.uint8)
    for c in range(0x3000):
        x = chr(c)
        out[c] = (0 if x.isspace() else 4 if x.isdigit() else 3 if x.isupper() else 2 if x.islower()
                  else 1 if x.isalnum() else 5)
    return out


_CLASS = _classes()


def tokens(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape, text number) of each token: a run of letters and digits, or of other marks."""
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = _CLASS[np.minimum(points, 0xFFFF)]
    group = np.where(kind == 0, 0, np.where(kind == 5, 2, 1)).astype(np.uint8)
    first = np.empty(len(points), bool)
    first[0] = True
    first[1:] = group[1:] != group[:-1]
    first[starts[:-1][starts[:-1] < len(points)]] = True
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, len(points)))
    place = np.arange(len(points), dtype=np.int64) - np.repeat(begin, length)
    power = np.cumprod(np.full(256, _BASE, np.uint64), dtype=np.uint64)
    lower = points + np.where((kind == 3) & (points < 0x180), np.uint32(32), np.uint32(0)).astype(np.uint32)
    value = (lower.astype(np.uint64) + np.uint64(1)) * _MIX * (power[place & 255] + place.astype(np.uint64))
    h = mixed(np.add.reduceat(value, begin))
    upper = np.add.reduceat((kind == 3).astype(np.int64), begin)
    digit = np.add.reduceat((kind == 4).astype(np.int64), begin)
    shape = np.where(group[begin] == 2, points[begin] + np.uint64(16), np.where(
        digit > 0, 4, np.where(upper == length, np.where(length > 1, 3, 2), np.where(
            upper > 0, 1, 0)))).astype(np.uint64)
    text = np.searchsorted(starts, begin, side="right") - 1
    keep = group[begin] != 0
    return h[keep], shape[keep], text[keep]


def _values() -> np.ndarray:
    """What a code point up to U+FFFF adds to a hash, before its place counts."""
    points = np.arange(0x10000, dtype=np.uint64)
    return (points + np.where((_CLASS == 3) & (points < 0x180), np.uint64(32), np.uint64(0)) + np.uint64(1)) * _MIX


_VALUE = _values()
_IN_WORD = (_CLASS != 0) & (_CLASS != 5)
#: By the place in a token, as far as most tokens go.
_PLACE = np.cumprod(np.full(256, _BASE, np.uint64), dtype=np.uint64) + np.arange(256, dtype=np.uint64)


def words(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of letters and digits: those of ``tokens``, without other marks."""
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    plane = points.max() < 0x10000
    inside = _IN_WORD[points if plane else np.minimum(points, 0xFFFF)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    text_starts = starts[:-1][starts[:-1] < len(points)]
    first[text_starts] = inside[text_starts]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)  # marks and white space are left out
    length = np.diff(np.searchsorted(at, begin), append=len(at))
    place = np.arange(len(at), dtype=np.int32) - np.repeat((np.cumsum(length) - length).astype(np.int32), length)
    value = _VALUE[points[at]] if plane else _value(points[at])
    if length.max() <= 256:
        value *= _PLACE[place]
    else:
        value *= _PLACE[place & 255] + (place & ~255).astype(np.uint64)
    h = mixed(np.add.reduceat(value, np.cumsum(length) - length))
    return h, np.searchsorted(starts, begin, side="right") - 1


def _value(points: np.ndarray) -> np.ndarray:
    return np.where(points < 0x10000, _VALUE[np.minimum(points, 0xFFFF)], (points.astype(np.uint64) + np.uint64(1)) * _MIX)


def windows(h: np.ndarray, text: np.ndarray, order: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of ``order`` tokens inside one text."""
    n = len(h) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, salt, np.uint64)
    for k in range(order):
        out = mixed(out * _BASE + h[k:n + k])
    inside = text[:n] == text[order - 1:]
    return out[inside], text[:n][inside]

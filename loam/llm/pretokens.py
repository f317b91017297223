"""Pre-tokens of many texts at once: where each match of the splitting pattern begins and ends."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

# Fixed value: the published splitting pattern of byte-level BPE vocabularies, which ``_starts`` follows.
COMMON = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The kind of every code point, as the pattern's classes have it."""
    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, found in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.findall(found, every):
            kinds[ord(run[0]) : ord(run[-1]) + 1] = kind
    return kinds


def _starts(point: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point; ``first`` marks the texts' first ones.

    The pre-tokens tile a text, so their starts are all there is to find. A run of one kind is a
    pre-token, but a space before letters, numbers or others joins them, the white space before
    such a space, or before any last white space that something follows, stands alone, and an apostrophe takes the
    contraction's letters from the run behind it.
    """
    kind = _kinds()[point]
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    follows = np.zeros(len(point), bool)  # something else of the same text stands behind a white space
    space = kind == SPACE
    follows[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start = begin | follows
    joined = np.flatnonzero(follows & (point == 0x20)) + 1
    start[joined] = False
    quote = np.flatnonzero((point[:-1] == 0x27) & start[:-1] & begin[1:] & (kind[1:] == LETTER) & ~first[1:])
    if len(quote):
        ends = np.r_[point, np.zeros(2, point.dtype)]
        a, b = ends[quote + 1], ends[quote + 2]
        pair = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        pair &= quote + 2 < len(point)
        pair[pair] &= ~first[quote[pair] + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        taken = quote[one | pair]
        start[taken + 1] = False
        behind = taken + 2 + pair[one | pair]
        start[behind[behind < len(point)]] = True
    return start


def pretokens(texts: list[bytes], pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, the starts and ends of the pre-tokens in them, and how many each text has.

    Any pattern works; the common one is matched for all texts at once. A character that no match
    covers is left out.
    """
    joined = b"".join(texts)
    flat = np.frombuffer(joined, np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)] if texts else np.zeros(1, np.int64)
    if pattern != COMMON:
        split = regex.compile(pattern).finditer
        spans = [[(len(s[: m.start()].encode()), len(s[: m.end()].encode())) for m in split(s)] for s in (t.decode() for t in texts)]
        edges = np.array([(a + at, b + at) for found, at in zip(spans, offsets, strict=False) for a, b in found], np.int64).reshape(-1, 2)
        return flat, edges[:, 0], edges[:, 1], np.array([len(x) for x in spans], np.int64)
    if not len(flat):
        return flat, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    point = np.frombuffer(joined.decode().encode("utf-32-le"), "<u4")
    place = np.flatnonzero((flat & 0xC0) != 0x80) if len(point) < len(flat) else np.arange(len(flat))
    first = np.zeros(len(point), bool)
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[np.searchsorted(place, heads)] = True
    starts = place[_starts(point, first)]
    ends = np.r_[starts[1:], len(flat)]
    return flat, starts, ends, np.diff(np.searchsorted(starts, offsets))

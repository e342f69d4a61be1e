"""Evidence learnt from labels: the weights of word patterns, and where they add up in a text.

A pattern is a hash of neighbouring words: one, two or three of them, with a gap or without, or with listed words put
by their categories. Its weight is the log odds of labelled documents with and without abuse that hold it.
"""

from __future__ import annotations

import numpy as np

from tidelog.llm import lexicon as L
from tidelog.llm.reveal import CATEGORY_SHIFT

_HASH = np.uint64(0xFFFFFFFF)
#: Odd multipliers for the words of a pattern.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: The words of each pattern by their distance from its first one; the last ones put listed words by category.
SHAPES = ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 1, 3), (0, 1), (0, 1, 2))
BY_CATEGORY = 5
#: Words to either side of a listed one whose patterns are of interest also where nothing is wrong.
NEAR = 6
#: Words over which weights are added up.
SPAN = 8
_TABLE_BITS = 22


def patterns(codes: np.ndarray, doc: np.ndarray):
    """(first word, hash) of every pattern, shape by shape; none reaches over a document's end."""
    n = len(codes)
    plain = codes.view(np.uint64) & _HASH
    bits = (codes >> CATEGORY_SHIFT) & ((1 << len(L.CATEGORIES)) - 1)
    classed = np.where(bits > 0, bits.view(np.uint64) << np.uint64(32), plain)
    with np.errstate(over="ignore"):
        for k, shape in enumerate(SHAPES):
            reach = shape[-1]
            if n <= reach:
                continue
            word = classed if k >= BY_CATEGORY else plain
            h = np.full(n - reach, np.uint64(k + 1)) * _MIX[3]
            for j, d in enumerate(shape):
                h = (h ^ (word[d : n - reach + d] * _MIX[j])) * _MIX[(j + 1) % 4]
                h ^= h >> np.uint64(29)
            ok = doc[: n - reach] == doc[reach:] if reach else np.ones(n, bool)
            if k >= BY_CATEGORY:
                any_listed = np.zeros(n - reach, bool)
                for d in shape:
                    any_listed |= bits[d : n - reach + d] > 0
                ok = ok & any_listed
            at = np.flatnonzero(ok)
            yield at, h[at]


def near_listed(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words are within NEAR of a listed one of the same document."""
    hot = np.flatnonzero((codes >> CATEGORY_SHIFT) & L.HOT)
    edge = np.zeros(len(codes) + 1, np.int64)
    lo = np.maximum(np.searchsorted(doc, doc[hot]), hot - NEAR)
    hi = np.minimum(np.searchsorted(doc, doc[hot], "right"), hot + NEAR + 1)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return edge.cumsum()[:-1] > 0


def counted(codes: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document), each pair once: all patterns of toxic documents, of others those near a listed word."""
    wanted = toxic[doc] | near_listed(codes, doc)
    found = [(h[wanted[at]], doc[at[wanted[at]]]) for at, h in patterns(codes, doc)]
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return _pairs(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def _pairs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


class Lookup:
    """Where a hash stands among sorted ones; a table of bits answers for most that are not there."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[hashes >> np.uint64(64 - _TABLE_BITS)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in h, position among the hashes) of those that are there."""
        if not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.table[h >> np.uint64(64 - _TABLE_BITS)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        there = self.hashes[at] == h[maybe]
        return maybe[there], at[there]


def held(codes: np.ndarray, doc: np.ndarray, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(position among the hashes, document), each pair once."""
    found = []
    for at, h in patterns(codes, doc):
        where, which = lookup.find(h)
        found.append((which, doc[at[where]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _pairs(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Log odds of patterns held by so many toxic and clean documents; 0 where there are too few to tell."""
    w = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.where((toxic >= 2) | (clean >= 3), w, 0).astype(np.float32)


def along(codes: np.ndarray, doc: np.ndarray, lookup: Lookup, weight: np.ndarray) -> np.ndarray:
    """For each word the weight, of those of the patterns that begin there, which is furthest from 0."""
    out = np.zeros(len(codes), np.float32)
    for at, h in patterns(codes, doc):
        where, which = lookup.find(h)
        w, i = weight[which], at[where]
        more = np.abs(w) > np.abs(out[i])
        out[i[more]] = w[more]
    return out


def spans(values: np.ndarray, doc: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each word the sum over it and the next ones of its document, `span` in all."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    end = np.minimum(np.arange(len(values)) + span, np.searchsorted(doc, doc, "right"))
    return total[end] - total[:-1]

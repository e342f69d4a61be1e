"""Byte-level BPE as a deterministic automaton over tokens, evaluated for whole batches at once.

Compilation. The automaton starts with one state per byte and an arc between any two. The merges are then applied in
rank order, each as one gadget: the gadget of (a, b) closes the arc from a to b, and adds a state ab whose outgoing
arcs are those b has at that moment and whose incoming arcs are those of a. (The outgoing arcs are copied before the
closing and the incoming ones after it, which is what makes `aaa` read as `aa a`.) After the last gadget the paths of
the automaton are exactly the token sequences BPE can produce, and every byte string has one path.

All arcs would be some billions, so a gadget is stored as the state it copies from, its rank and the arc it closes; an
arc is resolved by following the gadgets back, and answers are kept in a transition table.

Encoding. Texts are cut into words by the tokenizer's pattern, equal words of a batch are encoded once, and all
distinct words are driven through the tables together, one byte position at a time. Decoding emits the labels of the
arcs.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE_OTHER, BLANK, LETTER, NUMBER, OTHER = range(5)
#: The code points with Unicode's White_Space property, as ranges.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Words beyond this many bytes are walked one by one, as few are that long.
LONG_WORD = 256
CACHE_BITS = 20


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    # Beyond the third plane there are no letters and no numbers.
    first = np.array([unicodedata.category(chr(c))[0] for c in range(0x40000)])
    table[:0x40000][first == "L"] = LETTER
    table[:0x40000][first == "N"] = NUMBER
    for lo, hi in WHITE_SPACE:
        table[lo : hi + 1] = SPACE_OTHER
    table[0x20] = BLANK
    return table


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes, by their rule."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def _code_points(b: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code point at each lead byte of UTF-8 text."""
    x = [b[np.minimum(lead + i, len(b) - 1)].astype(np.int32) & 0x3F for i in range(1, 4)]
    c = b[lead].astype(np.int32)
    two, three = ((c & 0x1F) << 6) | x[0], ((c & 0x0F) << 12) | (x[0] << 6) | x[1]
    four = ((c & 0x07) << 18) | (x[0] << 12) | (x[1] << 6) | x[2]
    return np.where(c < 0x80, c, np.where(c < 0xE0, two, np.where(c < 0xF0, three, np.minimum(four, 0x10FFFF))))


def word_starts(b: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Byte offsets at which the words of the concatenated texts b start; no word crosses a text's start.

    Does what the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ does,
    on runs of equal character class.
    """
    table = char_classes()
    wide = b >= 0x80
    if wide.any():
        at = np.flatnonzero((b & 0xC0) != 0x80)
        cls = table[b[at] & 0x7F]
        more = np.flatnonzero(wide[at])
        cls[more] = table[_code_points(b, at[more])]
        docs = np.searchsorted(at, doc_starts)
    else:
        at, cls, docs = None, table[b], doc_starts
    n = len(cls)
    new_doc = np.zeros(n + 1, bool)
    new_doc[docs] = True
    new_doc[n] = True
    group = np.where(cls == BLANK, SPACE_OTHER, cls)
    run = np.ones(n + 1, bool)
    run[1:n] = group[1:] != group[:-1]
    run |= new_doc
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (cls[:-1] == BLANK) & ~new_doc[1:n]
    solid = group != SPACE_OTHER
    # A run of signs, letters or digits takes one blank before it along.
    start = run[:n] & ~(solid & blank_before)
    # The last white space before a solid run, in the same text, is a word of its own or goes with that run.
    last = np.flatnonzero(run[1:n] & solid[1:] & ~solid[:-1] & ~new_doc[1:n]) if n > 1 else np.empty(0, np.int64)
    start[last] = True
    # Contractions: a lone apostrophe that no blank precedes, then letters.
    byte = (lambda i: b[i]) if at is None else (lambda i: b[at[i]])
    signs = np.flatnonzero((group[: n - 1] == OTHER) & run[: n - 1] & run[1:n] & ~new_doc[1:n] & (cls[1:] == LETTER))
    signs = signs[(byte(signs) == 0x27) & ~blank_before[signs]]
    if len(signs):
        one, second = byte(signs + 1), np.minimum(signs + 2, n - 1)
        # Only ASCII bytes are lead bytes equal to these letters.
        two = np.where((signs + 2 < n) & ~run[signs + 2], byte(second), 0)
        eats1 = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        eats2 = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | ((one == ord("l")) & (two == ord("l")))
        for eats, k in ((eats1, 1), (eats2, 2)):
            hit = signs[eats]
            start[hit + 1] = False
            rest = hit + 1 + k
            rest = rest[rest < n]
            start[rest[~run[rest]]] = True
    chosen = np.flatnonzero(start)
    return chosen if at is None else at[chosen]


class Automaton:
    """The compiled tables of one vocabulary file (tokenizers' JSON with vocab and merges)."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        alphabet, vocab = byte_alphabet(), model["vocab"]
        spelt = {s: bytes(alphabet[c] for c in s) for s in vocab}
        size = max(vocab.values()) + 1
        #: Arc labels: what each token emits.
        self.labels: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.labels[i] = spelt[s]
        self.label_bytes = np.frombuffer(b"".join(self.labels), np.uint8)
        self.label_length = np.array([len(x) for x in self.labels], np.int64)
        self.label_start = np.cumsum(self.label_length) - self.label_length
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.birth = np.full(size, -1, np.int64)
        closed: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, ab = vocab[a], vocab[b], vocab[a + b]
            closed.setdefault(a << 16 | b, rank)
            if self.birth[ab] < 0:
                self.left[ab], self.right[ab], self.birth[ab] = a, b, rank
        assert size <= 1 << 16, "arcs are packed into two 16-bit halves"
        self.closed = closed
        self.closed_key = np.array(sorted(closed), np.int64)
        self.closed_rank = np.array([closed[k] for k in self.closed_key.tolist()], np.int64)
        self._tries()
        self.table_key = np.full(1 << CACHE_BITS, -1, np.int64)
        self.table_open = np.zeros(1 << CACHE_BITS, bool)
        self.arcs: dict[int, bool] = {}

    def _tries(self) -> None:
        """step[row of a node, byte] -> node; node 0 is dead, node 1 the root; token[node] or -1."""
        edges: dict[int, int] = {}
        token = [-1, -1]
        for i, label in enumerate(self.labels):
            if not label:
                continue
            node = 1
            for byte in label:
                key = node << 8 | byte
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(token)
                    token.append(-1)
                node = nxt
            token[node] = i
        keys, targets = np.fromiter(edges, np.int64), np.fromiter(edges.values(), np.int64)
        inner = np.unique(keys >> 8)
        self.row = np.zeros(len(token), np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.step = np.zeros((len(inner) + 1, 256), np.int32)
        self.step[self.row[keys >> 8], keys & 255] = targets
        self.token = np.array(token, np.int32)

    def _resolve(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether the arcs from states s to states t are open, by following the gadgets back."""
        open_ = np.ones(len(s), bool)
        limit = np.full(len(s), 1 << 40, np.int64)
        live = np.arange(len(s))
        while len(live):
            a, b = s[live], t[live]
            key = a << 16 | b
            at = np.minimum(np.searchsorted(self.closed_key, key), len(self.closed_key) - 1)
            shut = (self.closed_key[at] == key) & (self.closed_rank[at] <= limit[live])
            open_[live[shut]] = False
            going = ~shut & ((self.birth[a] >= 0) | (self.birth[b] >= 0))
            live, a, b = live[going], a[going], b[going]
            by_s = self.birth[a] > self.birth[b]
            limit[live] = np.where(by_s, self.birth[a] - 1, self.birth[b])
            s[live] = np.where(by_s, self.right[a], a)
            t[live] = np.where(by_s, b, self.left[b])
        return open_

    def open(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Transition lookup for arrays of states; -1 is the start, from which every arc is open."""
        key = np.maximum(s, 0) << 16 | t
        slot = ((key * 0x9E3779B97F4A7C1) >> 24) & ((1 << CACHE_BITS) - 1)
        known = self.table_key[slot] == key
        if not known.all():
            new = np.unique(key[~known])
            found = self._resolve(new >> 16, new & 0xFFFF)
            # The answer and its slot are taken from `new`, as slots may collide within a batch.
            answer = np.empty(len(key), bool)
            answer[known] = self.table_open[slot[known]]
            answer[~known] = found[np.searchsorted(new, key[~known])]
            at = ((new * 0x9E3779B97F4A7C1) >> 24) & ((1 << CACHE_BITS) - 1)
            # Of several in one slot the last stays, in both arrays.
            self.table_key[at] = new
            self.table_open[at] = found
        else:
            answer = self.table_open[slot]
        return answer | (s < 0)

    def _open_one(self, s: int, t: int) -> bool:
        if s < 0:
            return True
        key = s << 16 | t
        if key not in self.arcs:
            if len(self.arcs) > 1 << CACHE_BITS:
                self.arcs.clear()
            self.arcs[key] = bool(self._resolve(np.array([s]), np.array([t]))[0])
        return self.arcs[key]

    def walk(self, word: bytes) -> list[int]:
        """The ids of one word, byte by byte."""
        n = len(word)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            node = 1
            for j in range(i, n):
                node = int(self.step[self.row[node], word[j]])
                if not node:
                    break
                if (t := int(self.token[node])) >= 0:
                    ends[j + 1].append((i, t))
            for start, t in ends[i + 1]:
                if self._open_one(last[start], t):
                    last[i + 1], back[i + 1] = t, start
                    break
            ends[i + 1] = []
        ids = []
        while n:
            ids.append(last[n])
            n = back[n]
        return ids[::-1]

    def encode_words(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the words b[offsets[i]:offsets[i + 1]]."""
        lengths = np.diff(offsets)
        long = np.flatnonzero(lengths > LONG_WORD)
        if len(long):
            short = np.flatnonzero(lengths <= LONG_WORD)
            where = np.repeat(lengths <= LONG_WORD, lengths)
            ids, few = self.encode_words(b[offsets[0] : offsets[-1]][where], np.concatenate([[0], np.cumsum(lengths[short])]))
            walked = [self.walk(b[offsets[i] : offsets[i + 1]].tobytes()) for i in long.tolist()]
            counts = np.empty(len(lengths), np.int64)
            counts[short], counts[long] = few, [len(w) for w in walked]
            of_long = np.repeat(lengths > LONG_WORD, counts)
            out = np.empty(len(of_long), np.int32)
            out[~of_long], out[of_long] = ids, np.concatenate([np.array(w, np.int32) for w in walked])
            return out, counts
        b = b[offsets[0] : offsets[-1]]
        if not len(b):
            return np.empty(0, np.int32), np.zeros(len(lengths), np.int64)
        first = offsets[:-1] - offsets[0]
        word_end = np.repeat(first + lengths, lengths)
        word_first = np.repeat(first, lengths)
        # All token occurrences: from every byte along the trie.
        starts, ends, tokens = [], [], []
        at = np.arange(len(b))
        node = np.ones(len(b), np.int32)
        depth = 0
        while len(at):
            node = self.step[self.row[node], b[at + depth]]
            tok = self.token[node]
            hit = tok >= 0
            starts.append(at[hit])
            ends.append(at[hit] + depth)
            tokens.append(tok[hit])
            depth += 1
            on = (self.row[node] > 0) & (at + depth < word_end[at])
            at, node = at[on], node[on]
        start, end, tok = np.concatenate(starts), np.concatenate(ends), np.concatenate(tokens).astype(np.int64)
        offset = (end - word_first[end]).astype(np.int16)
        order = np.argsort(offset, kind="stable")
        start, end, tok, offset = start[order], end[order], tok[order], offset[order]
        bounds = np.searchsorted(offset, np.arange(offset[-1] + 2))
        # Per byte: the token that ends there on the one path of the prefix, and where it starts.
        state = np.full(len(b), -1, np.int64)
        back = np.zeros(len(b), np.int64)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            s, e, t = start[lo:hi], end[lo:hi], tok[lo:hi]
            before = np.where(s > word_first[s], state[s - 1], -1)
            ok = self.open(before, t)
            state[e[ok]] = t[ok]
            back[e[ok]] = s[ok]
        # Backwards along the paths, all words at once.
        at = first + lengths - 1
        word = np.flatnonzero(lengths > 0)
        at = at[word]
        got_word, got_tok = [], []
        while len(at):
            got_word.append(word)
            got_tok.append(state[at])
            at = back[at] - 1
            on = at >= first[word]
            at, word = at[on], word[on]
        words, toks = np.concatenate(got_word[::-1]), np.concatenate(got_tok[::-1])
        counts = np.bincount(words, minlength=len(lengths))
        return toks[np.argsort(words, kind="stable")].astype(np.int32), counts

    def encode(self, b: np.ndarray, doc_offsets: np.ndarray, counts_only: bool = False):
        """(ids, offsets) of the texts b[doc_offsets[i]:doc_offsets[i + 1]]; only the offsets if counts_only."""
        if not len(b):
            zero = np.zeros(len(doc_offsets), np.int64)
            return zero if counts_only else (np.empty(0, np.int32), zero)
        filled = doc_offsets[:-1][np.diff(doc_offsets) > 0]
        cuts = word_starts(b, filled)
        offsets = np.append(cuts, len(b)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(b)])
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy()
        distinct = coded.dictionary
        bounds = np.frombuffer(distinct.buffers()[1], np.int32)[: len(distinct) + 1].astype(np.int64)
        ids, counts = self.encode_words(np.frombuffer(distinct.buffers()[2], np.uint8), bounds)
        per_word = counts[which]
        ends = np.concatenate([[0], np.cumsum(per_word)])
        out_offsets = ends[np.searchsorted(cuts, doc_offsets)]
        if counts_only:
            return out_offsets
        begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
        return ids[np.repeat(begin[which] - ends[:-1], per_word) + np.arange(ends[-1])], out_offsets

    def decode_lists(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, byte offsets) of the texts whose ids are ids[offsets[i]:offsets[i + 1]]."""
        lengths = self.label_length[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.label_start[ids] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.label_bytes[at], ends[offsets]

    def decode(self, ids) -> bytes:
        """The labels of the arcs, one after the other."""
        return b"".join(map(self.labels.__getitem__, ids))


@lru_cache(2)
def automaton(path: str) -> Automaton:
    """Compiled once per Python worker."""
    return Automaton(path)

"""From a text to coded words: disguises undone, every word a number that holds its hash, categories and marks.

Steps over the whole text undo what crosses blanks: escapes, markup, broken and spaced words. What is left is split at
blanks, and distinct pieces are looked at once per process: encoded data, letters of other scripts, signs for letters.
"""

from __future__ import annotations

import html
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np

from tidelog.llm import lexicon as L

#: A coded word: the hash of its skeleton in the low 32 bits, its categories above, then the marks.
CATEGORY_SHIFT = 32
CAPITAL, UPPER, DISGUISE, END, PLURAL = (1 << (48 + i) for i in range(5))
#: Pieces whose codes are kept; the store is emptied when full. Longer pieces are not kept.
KEPT_PIECES, KEPT_LENGTH = 1 << 17, 40

_LINE_ITEMS = re.compile(r'\\n",\s*"')
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
_CONTROL = re.compile(r"\\[ntr]")
_ANSI = re.compile(r"\x1b\[[0-9;?]*[A-Za-z]")
_TAGS = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|mark|s|small|span|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>", re.I)
_RUN = re.compile(r"[A-Za-z0-9+/=]{48,}")
_RISES, _DIGIT = re.compile("[a-z][A-Z]"), re.compile("[0-9]")
_BROKEN = re.compile(r"-(?<=[^\W\d_]-)(?:[ \t]*\n[ \t#>*]*|[ ])(?=[^\W\d_])")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_]([._*\-~|/])[^\W\d_]\1[^\W\d_](?:\1[^\W\d_])*(?![^\W_])")
_SINGLES = re.compile(b"\x01{3,}")
_LEET = re.compile(r"[a-z]+[0-9@$#*!][a-z0-9@$#*!]*|[0-9@$#*!]+[a-z][a-z0-9@$#*!]*")
_INSIDE = re.compile(r"[a-z][0-9@$]+[a-z]")
_WORD = re.compile(f"[{L.EAST}]|[^\\W\\d_{L.EAST}]+")
_DRAWN = re.compile(r"(.)\1\1")
_PARTS = re.compile(r"[^\W\d_]+(?:([-._*~|/'])[^\W\d_]+(?:\1[^\W\d_]+)*)")
_SIGNS = re.compile(r"[@$#*!]")
_LIKE_LETTERS = re.compile(r"[0-9@$#*!]")
_NOT_NAMES = re.compile("[.!?:;]['\")\\]]*$")


def _encoded(m: re.Match) -> str:
    """A blank for encoded data, else what was found: in written words the case seldom changes within a word."""
    run = m[0]
    return " " if _DIGIT.search(run) and len(_RISES.findall(run)) * 10 >= len(run) else run


def _unescape(text: str) -> str:
    text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def prepare(text: str) -> str:
    """The text with all that crosses blanks undone; letters keep their case."""
    if "\\" in text:
        if '\\n",' in text:
            text = _LINE_ITEMS.sub("\n", text)
        if "\\u" in text:
            text = _unescape(text)
        text = _CONTROL.sub("\n", text)
    if "\x1b[" in text:
        text = _ANSI.sub("", text)
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAGS.sub("", text)
    if "- " in text or "-\n" in text:
        text = _BROKEN.sub("", text)
    return text


@lru_cache(1)
def _by_shape() -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in sorted(L.DISGUISED):
        out.setdefault(len(w), []).append(w)
    return out


def _unleet(token: str) -> str | None:
    """The listed word that a token with digits or signs for letters stands for."""
    bare = token.strip("!*#@$")
    if bare in L.DISGUISED:
        return None
    for cut in (bare, token):
        if len(cut) < 3:
            continue
        for plain in (cut.translate(L.LEET), cut.replace("1", "l").translate(L.LEET), cut.replace("0", "u").translate(L.LEET), _SIGNS.sub("", cut)):
            if plain in L.DISGUISED:
                return plain
        letters = sum(c.isalpha() for c in cut)
        if letters >= 2 and letters * 2 >= len(cut) and _SIGNS.search(cut):
            digits = "".join(c if c in "@$#*!" else c.translate(L.LEET) for c in cut)
            shape = re.compile(_SIGNS.sub(".", digits))
            for w in _by_shape().get(len(cut), ()):
                if shape.fullmatch(w):
                    return w
    return None


def _squeeze(word: str) -> str | None:
    """The listed word behind one with letters drawn out."""
    for plain in (re.sub(r"(.)\1\1+", r"\1", word), re.sub(r"(.)\1\1+", r"\1\1", word), re.sub(r"(.)\1+", r"\1", word)):
        if plain in L.DISGUISED:
            return plain
    return L.SKELETONS.get(L.skeleton(word)) if len(word) > 4 else None


def _code(word: str, raw: str, disguised: bool) -> int:
    out = zlib.crc32(L.skeleton(word).encode("utf-8", "surrogatepass")) | L.WORDS.get(word, 0) << CATEGORY_SHIFT
    if raw[:1].isupper():
        out |= UPPER if len(raw) > 2 and raw.isupper() else CAPITAL
    if disguised:
        out |= DISGUISE
    if len(word) > 4 and word[-1] == "s" and not word.endswith("ss"):
        out |= PLURAL
    return out


def _read(lower: str, piece: str, lo: int, hi: int, spaced: bool) -> list[int]:
    """The coded words of a part as they stand, but for drawn-out letters."""
    out = []
    for m in _WORD.finditer(lower, lo, hi):
        word, hidden = m[0], spaced
        if word not in L.WORDS and len(word) > 2:
            if _DRAWN.search(word):
                if (plain := _squeeze(word)) is not None:
                    word, hidden = plain, True
            elif len(word) > 4 and (plain := L.SKELETONS.get(L.skeleton(word))) is not None and len(plain) == len(word):
                word, hidden = plain, True
        out.append(_code(word, piece[m.start() : m.end()], hidden and word in L.DISGUISED))
    return out


def _codes(piece: str) -> tuple[int, ...]:
    """The coded words of a piece without blanks; a piece put together from single letters ends with a null."""
    if len(piece) >= 48:
        piece = _RUN.sub(_encoded, piece)
    if not piece.isascii():
        piece = L.fold(L.part(piece))
    parts = piece.split()
    return _folded(piece) if len(parts) == 1 else tuple(c for p in parts for c in _folded(p))


def _folded(piece: str) -> tuple[int, ...]:
    if not piece.isalpha():
        piece = _SPACED.sub(lambda m: m[0].replace(m[1], "") + "\x00", piece)
    spaced = "\x00" in piece
    if spaced:
        piece = piece.replace("\x00", "")
    lower = piece.lower()
    if lower in L.WORDS:
        return (_code(lower, piece, spaced and lower in L.DISGUISED),)
    if lower.isalpha():
        return tuple(_read(lower, piece, 0, len(lower), spaced))
    # (from, to, word): disguised words first, what they do not cover is read as it stands.
    taken: list[tuple[int, int, str, bool]] = []
    if _LIKE_LETTERS.search(lower):
        for m in _LEET.finditer(lower):
            plain = _unleet(m[0])
            if plain is not None:
                taken.append((m.start(), m.end(), plain, True))
            elif _INSIDE.search(m[0]):
                # Not listed, but perhaps known to the labels: one word, spelt out.
                taken.append((m.start(), m.end(), _SIGNS.sub("", m[0].strip("@$#*!").translate(L.LEET)), False))
    for m in _PARTS.finditer(lower):
        joined = m[0].replace(m[1], "")
        if len(joined) > 4 and joined in L.DISGUISED and not any(a < m.end() and m.start() < b for a, b, _, _ in taken):
            taken.append((m.start(), m.end(), joined, True))
    taken.sort()
    out: list[int] = []
    at = 0
    for lo, hi, word, hidden in taken:
        out += _read(lower, piece, at, lo, spaced)
        out.append(_code(word, piece[lo:hi], hidden))
        at = hi
    out += _read(lower, piece, at, len(lower), spaced)
    if out and _NOT_NAMES.search(piece):
        out[-1] |= END
    return tuple(out)


_kept: dict[str, tuple[int, ...]] = {}


def _learn(piece: str) -> tuple[int, ...]:
    if piece.isascii() and piece.upper() == piece.lower():
        # Neither letters nor, without any, signs for them; of these only the common ones are kept.
        codes, most = (), 3
    else:
        codes, most = _codes(piece), KEPT_LENGTH
    if len(piece) <= most:
        if len(_kept) >= KEPT_PIECES:
            _kept.clear()
        _kept[piece] = codes
    return codes


def _unspaced(pieces: list[str], single: bytes) -> list[str]:
    """The pieces with runs of three or more single letters put together."""
    out: list[str] = []
    at = 0
    for m in _SINGLES.finditer(single):
        word = "".join(pieces[m.start() : m.end()])
        out += pieces[at : m.start()]
        out += [word + "\x00"] if word.isalpha() else pieces[m.start() : m.end()]
        at = m.end()
    return out + pieces[at:]


def coded(text: str) -> np.ndarray:
    """The coded words of a text."""
    pieces = prepare(text).split()
    single = bytes([len(p) == 1 for p in pieces])
    if b"\x01\x01\x01" in single:
        pieces = _unspaced(pieces, single)
    found = list(map(_kept.get, pieces))
    at = -1
    try:
        while True:
            at = found.index(None, at + 1)
            found[at] = _learn(pieces[at])
    except ValueError:  # none is left
        pass
    return np.fromiter(chain.from_iterable(found), np.int64)


def words(text: str) -> list[str]:
    """The listed words that are found in a text, disguised or not, in order."""
    known = {zlib.crc32(L.skeleton(w).encode()): w for w in sorted(L.WORDS, key=len, reverse=True)}
    return [known.get(int(c) & 0xFFFFFFFF, "") for c in coded(text) if int(c) >> CATEGORY_SHIFT & (1 << len(L.CATEGORIES)) - 1]

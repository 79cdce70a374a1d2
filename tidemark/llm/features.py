"""Counts of characters and words that the quality classifier scores texts by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .base import CHUNK_CHARS, code_points, mix, runs, word_hashes

#: Kinds of code points.
OTHER, UPPER, LOWER, DIGIT, SPACE, STOP, MARK = range(7)
NAMES = (
    "upper", "digit", "stop", "mark", "newline", "repeated_mark", "word_length", "long_words", "short_words", "same_word", "same_gap", "same_shingle",
    "shouted", "marked_words", "bare_marks", "new_words", "words", "digit_words", "capital_words", "lines",
)
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Kind of every code point, by Python's own character classes."""
    if not _kinds:
        k = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            k[i] = UPPER if c.isupper() else LOWER if c.isalpha() else DIGIT if c.isdigit() else SPACE if c.isspace() else OTHER if i > 0x24F else STOP if c in ".,;:'\"()-?" else MARK
        _kinds.append(k)
    return _kinds[0]


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x)])
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def _scan(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters by kind per text, where each text's words begin, their hashes, and what each word is (sizes and yes or no)."""
    flat, starts = code_points(texts)
    kind = kinds()[np.minimum(flat, 0x10FFFF)]
    word, begin, end = word_hashes(flat)
    mark = kind == MARK
    chars = [kind == UPPER, kind == DIGIT, kind == STOP, mark, flat == 10, mark & np.append(mark[1:], False)]
    of = {k: (t[end] - t[begin]) for k, t in ((k, np.concatenate([[0], np.cumsum(kind == k)])) for k in (UPPER, LOWER, DIGIT, MARK))}
    letters, size = of[UPPER] + of[LOWER], end - begin
    about = [
        size, size > 20, size < 3, (of[UPPER] == letters) & (letters > 1), (of[MARK] > 0) & (letters > 0), (of[MARK] > 0) & (letters == 0), of[DIGIT] > 0, (of[UPPER] == 1) & (letters > 1),
    ]
    return np.stack([_sums(x, starts) for x in chars], axis=1), np.searchsorted(begin, starts), word, np.array(about, np.int32).reshape(len(about), -1)


def _parts(text: str) -> Iterator[str]:
    """A long text in parts of CHUNK_CHARS at most, cut after white space, or anywhere in a word that is as long as a part."""
    a = 0
    while a < len(text):
        b = a + CHUNK_CHARS
        if b < len(text):
            b = max((text.rfind(c, a, b) for c in " \n\t"), default=-1) + 1 or b
            b = b if b > a else a + CHUNK_CHARS
        yield text[a:b]
        a = b


def text_features(texts: list[str]) -> np.ndarray:
    """One row of len(NAMES) numbers from 0 to 1 per text; all zeros for a text without words.

    A very long text is scanned in parts, of which only a few numbers a word are kept.
    """
    out = [np.zeros((0, len(NAMES)))]
    for a, b in runs(texts):
        length = np.fromiter(map(len, texts[a:b]), float, b - a)
        if b - a == 1 and len(texts[a]) > CHUNK_CHARS:
            scans = [_scan([x]) for x in _parts(texts[a])]
            chars = np.sum([s[0] for s in scans], axis=0)
            word, about = np.concatenate([s[2] for s in scans]), np.concatenate([s[3] for s in scans], axis=1)
            at = np.array([0, len(word)])
        else:
            chars, at, word, about = _scan(texts[a:b])
        doc = np.repeat(np.arange(b - a), np.diff(at))
        words = np.maximum(np.diff(at), 1).astype(float)
        count = lambda x: _sums(x, at) / words
        same = lambda k: np.concatenate([np.zeros(min(k, len(word)), bool), (word[k:] == word[:-k]) & (doc[k:] == doc[:-k])]) if len(word) else np.zeros(0, bool)
        # words and word pairs seen before in the text
        order = np.lexsort((word, doc))
        seen = np.zeros(len(word), bool)
        seen[order[1:]] = (word[order[1:]] == word[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        pair = np.append(mix(word[:-1] + mix(word[1:])), np.zeros(min(1, len(word)), np.uint64))
        order = np.lexsort((pair, doc))
        again = np.zeros(len(word), bool)
        again[order[1:]] = (pair[order[1:]] == pair[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        again[at[1:][np.diff(at) > 0] - 1] = False  # a text's last word begins no pair
        upper, digit, stop, mark, newline, repeated = (chars / np.maximum(length, 1)[:, None]).T
        size, long, short, shouted, marked, bare, digits, capital = about
        rows = np.stack(
            [
                upper, digit, stop, mark, newline, repeated,
                np.minimum(count(size) / 20, 1), count(long), count(short), count(same(1)), count(same(2)), count(again),
                count(shouted), count(marked), count(bare), 1 - count(seen),
                np.minimum(np.log1p(words) / 12, 1), count(digits), count(capital), np.minimum(newline * 20, 1),
            ],
            axis=1,
        )
        rows[np.diff(at) == 0] = 0
        out.append(rows)
    return np.concatenate(out)

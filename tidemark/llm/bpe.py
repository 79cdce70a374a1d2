"""Byte-pair encoding and decoding by batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from .base import map_batches, texts_of

#: Pieces of text between spaces that a worker remembers, about 200 bytes each.
REMEMBERED = 800_000
#: Bytes of words that one run of merge rounds works on.
ROUND_BYTES = 1 << 21


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it has one, else the next from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class WordBpe:
    """A BPE tokenizer file with word ends: white space dropped, lower case, bytes as characters.

    Merges run in rounds over many words at once: the symbols of all words lie
    in one flat array, the rank of each neighbouring pair is found by binary
    search over the sorted pair keys, and each word merges its lowest pair
    everywhere, from left to right.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars])
        self.last = np.array([vocab[c + suffix] for c in chars])
        merges = [(a, b) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"] for a, b in [m if isinstance(m, list) else m.split(" ")]]
        self.base = len(self.tokens)
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges])
        made = np.array([vocab[a + b] for a, b in merges])
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made[order]
        self.decimal = list(map(str, range(len(self.tokens))))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.place = np.zeros(1 << 20, np.int32), np.zeros(REMEMBERED + 2, np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; a pair that never merges has a rank beyond all others."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys)), self.made[at]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol ids of all words (none empty), one after the other, and how many each has."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), length)
        symbol = self.inner[flat]
        ends = np.cumsum(length) - 1
        symbol[ends] = self.last[flat[ends]]
        never = len(self.keys)
        rank, made = np.full(len(symbol), never), np.zeros(len(symbol), np.int64)  # of the pair that begins here
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], made[inside] = self._lookup(symbol[inside], symbol[inside + 1])
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(np.append(starts, len(word)))
            least = np.minimum.reduceat(rank, starts)
            if (still := least == never).any():
                over = np.repeat(still, size)
                finished.append((word[over], symbol[over]))
                symbol, word, rank, made = symbol[~over], word[~over], rank[~over], made[~over]
                size, least = size[~still], least[~still]
                if not len(symbol):
                    break
            here = rank == np.repeat(least, size)
            if (here[1:] & here[:-1]).any():  # in a run like "aaaa" only every second pair can merge
                first = np.flatnonzero(here & ~np.append(False, here[:-1]))
                at = np.flatnonzero(here)
                here[at[(at - first[np.searchsorted(first, at, side="right") - 1]) % 2 == 1]] = False
            symbol[here] = made[here]
            keep = ~np.append(False, here[:-1])
            new = np.flatnonzero(here[keep])
            symbol, word, rank, made = symbol[keep], word[keep], rank[keep], made[keep]
            near = np.zeros(len(word), bool)
            near[new] = near[new[new > 0] - 1] = True
            changed = np.flatnonzero(near)
            rank[changed] = never
            changed = changed[changed < len(word) - 1]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed], made[changed] = self._lookup(symbol[changed], symbol[changed + 1])
        of, got = (np.concatenate(x) for x in zip(*finished)) if finished else (np.zeros(0, np.int64),) * 2
        return got[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))

    def _words(self, chunks: list[str]) -> list[list[int | str]]:
        """Ids of special tokens and normalised words of each chunk."""
        mark = "\0"
        joined = f" {mark} ".join(chunks)
        if joined.count(mark) != len(chunks) - 1 or any(x in joined for x in self.special):
            if len(chunks) > 1:
                return [w for c in chunks for w in self._words([c])]
            parts: list[int | str] = []
            for x in self.split_special(joined) if self.split_special else [joined]:
                parts += [self.special[x]] if x in self.special else self.words(self.normal(x))
            return [parts]
        out: list[list[int | str]] = [[]]
        for w in self.words(self.normal(joined)) if len(chunks) > 1 else []:
            if w == mark:
                out.append([])
            else:
                out[-1].append(w)
        return out if len(chunks) > 1 else [self.words(self.normal(joined))]

    @staticmethod
    def normal(x: str) -> str:
        x = unicodedata.normalize("NFC", x)
        # a capital sigma becomes the same small letter at every place in a word
        return "".join(map(str.lower, x)) if "Σ" in x else x.lower()

    def learn(self, chunks: list[str]) -> None:
        for c in range(0, len(chunks), 20_000):
            some = chunks[c : c + 20_000]
            parts = self._words(some)
            words = list(dict.fromkeys([w for p in parts for w in p if isinstance(w, str)]))
            coded = [w.encode() for w in words]
            ids, sizes, a, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
            for i, w in enumerate([*coded, b""]):
                if i == len(coded) or size + len(w) > ROUND_BYTES and size:
                    if i > a:
                        got = self.merge(coded[a:i])
                        ids.append(got[0])
                        sizes.append(got[1])
                    a, size = i, 0
                size += len(w)
            flat = np.concatenate(ids).tolist()
            ends = np.cumsum(np.concatenate(sizes)).tolist()
            of = {w: flat[x:y] for w, x, y in zip(words, [0, *ends], ends)}
            each = [[i for w in p for i in (of[w] if isinstance(w, str) else (w,))] for p in parts]
            new = np.array([i for e in each for i in e], np.int32)
            k = len(self.known)
            self.known.update(zip(some, range(k, k + len(some))))
            if len(self.known) + 1 > len(self.place):
                self.place = np.append(self.place, np.zeros(len(self.known), np.int64))
            begin = self.place[k]
            self.place[k + 1 : k + 1 + len(some)] = begin + np.cumsum([len(e) for e in each])
            if begin + len(new) > len(self.ids):
                self.ids = np.append(self.ids, np.zeros(max(len(self.ids), len(new)), np.int32))
            self.ids[begin : begin + len(new)] = new

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces as they stand."""
        return " ".join([self.tokens[i] for i in ids])

    def texts(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text. White space always ends a word, so texts are cut at spaces and each distinct piece is encoded once for as long as it is remembered."""
        split = [t.split(" ") for t in texts]
        get = self.known.get
        where = [[get(c, -1) for c in chunks] for chunks in split]
        if new := list(dict.fromkeys([c for w, chunks in zip(where, split) if -1 in w for i, c in zip(w, chunks) if i < 0])):
            if len(self.known) + len(new) > REMEMBERED:
                self.forget()
                new = list(dict.fromkeys([c for chunks in split for c in chunks]))
                where = [[-1]] * len(split)
            self.learn(new)
            where = [[self.known[c] for c in chunks] if -1 in w else w for w, chunks in zip(where, split)]
        for w in where:
            at = np.array(w)
            begin, size = self.place[at], self.place[at + 1] - self.place[at]
            yield self.ids[np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)].tolist()

    def encode(self, text: str) -> list[int]:
        return next(self.texts([text]))


_models: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    if path not in _models:
        _models[path] = WordBpe(path)
    return _models[path]


def encode_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text, one row per row of docs.

    A null or empty text has no ids and decodes to an empty text. with_ids adds
    `ids` (array<int>) and `decoded`. Other columns are not read.
    """

    def run(batch: dict) -> Iterator[dict]:
        bpe, doc, text = model(tokenizer), batch["doc_id"].to_pylist(), texts_of(batch["text"])
        for a in range(0, len(text), 250):
            got = list(bpe.texts(text[a : a + 250]))
            decimal, decoded = [" ".join([bpe.decimal[i] for i in x]) for x in got], [bpe.decode(x) for x in got]
            out = {
                "doc_id": doc[a : a + 250],
                "n_tokens": list(map(len, got)),
                "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decimal],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
            }
            if with_ids:
                out |= {"ids": got, "decoded": decoded}
            yield out

    more = ", ids array<int>, decoded string" * with_ids
    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + more)

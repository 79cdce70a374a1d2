"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import code_points, map_batches, mix, texts_of

#: Documents of each language that the fit counts, chosen by a hash of their id, about as many of each.
FIT_ROWS = 3_000
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Languages of one matrix of BUCKETS x languages numbers (26 MB). All languages are learned; more of them are scored one block after the other.
BLOCK = 100
#: Characters that one pass works on, and numbers that it gathers at once.
PIECE_CHARS, GATHERED = 1 << 17, 1 << 19
_tables: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Lower case of every letter, by Python's own rules; 32 for all else."""
    if not _tables:
        t = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                t[i] = ord(c.lower()[0])
        _tables.append(t)
    return _tables[0]


def pieces(texts: list[str], size: int) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Texts, each between two spaces, in runs of about `size` characters: text numbers, strings, and how many places of each string begin grams of its own.

    A longer text is cut; a piece has some more characters, for the grams that begin at its end.
    """
    of, parts, own, held = [], [], [], 0
    for i, text in enumerate(texts):
        padded = f" {text} "
        for a in range(0, len(padded), size):
            n = min(size, len(padded) - a)
            if held and held + n > size:
                yield of, parts, own
                of, parts, own, held = [], [], [], 0
            of.append(i)
            parts.append(padded[a : a + n + ORDERS[-1] - 1])
            own.append(n)
            held += n
    if of:
        yield of, parts, own


def grams(texts: list[str], size: int = PIECE_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """For runs of pieces of texts: the text and the beginning of each piece, hashed n-grams of each order at each place, and letters per piece.

    Letters are lower-cased, all else is a space; grams within a run of spaces
    do not count (-1), so that punctuation and digits weigh nothing. A gram lies
    within its text and the space on either side, so texts do not depend on each other.
    """
    for of, parts, own in pieces(texts, size):
        flat, starts = code_points(parts)
        c = letters()[np.minimum(flat, 0x10FFFF)]
        letter = c != 32
        counted = letter.copy()
        first, own_n, length = starts[:-1], np.array(own), np.diff(starts) - 1
        for j in range(ORDERS[-1]):  # what follows a piece's own places, but for its last space
            counted[np.minimum(first + own_n + j, first + length)] = False
        total = np.concatenate([[0], np.cumsum(counted)])
        out, key = [], c.astype(np.uint64)
        for n in ORDERS:
            if n > 1:
                key = key[:-1] * np.uint64(0x110000) + c[n - 1 :] if n < 3 else mix(key[:-1]) + c[n - 1 :]
            good = letter[: len(key)].copy()
            if n > 1:
                good |= letter[n - 1 :]
            full = np.full(len(c), -1, np.int64)
            full[: len(key)] = np.where(good, (mix(key + np.uint64(n << 60)) % np.uint64(BUCKETS)).astype(np.int64), -1)
            end = np.minimum(own_n, length - n + 1)
            for j in range(ORDERS[-1] + 1):
                full[first + np.clip(end + j, 0, length)] = -1  # the last of these is the space between pieces
            out.append(full)
        yield np.array(of), starts[:-1], out, total[starts[1:]] - total[starts[:-1]]


@dataclass(frozen=True)
class LanguageBlock:
    languages: tuple[str, ...]
    #: Log probability in each language (row) of each bucket; the last column, for grams that do not count, is zero.
    logs: np.ndarray

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each text in each language, and letters of each text."""
        out, n_letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for of, starts, keys, found in grams(texts, min(PIECE_CHARS, GATHERED // max(len(self.languages), 1))):
            np.add.at(n_letters, of, found)
            for k in keys:
                np.add.at(out, of, np.add.reduceat(np.take(self.logs, k, axis=1), starts, axis=1).T)
        return out, n_letters


@dataclass(frozen=True)
class LanguageModel:
    blocks: tuple[LanguageBlock, ...]

    @property
    def languages(self) -> tuple[str, ...]:
        return tuple(x for b in self.blocks for x in b.languages)


def held_out(doc_id: str = "doc_id"):
    """Whether the fit must not see a document; a null id is not held out (and not learned from either)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_block(some: DataFrame, languages: tuple[str, ...]) -> LanguageBlock:
    """Counts are added up by Spark; a row per language and bucket that occurs comes to the driver."""

    def count(batch: dict) -> Iterator[dict]:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), texts_of(batch["text"])):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            sums = np.zeros(BUCKETS, np.int64)
            for _, _, keys, _ in grams(texts):
                for k in keys:
                    sums += np.bincount(k[k >= 0], minlength=BUCKETS)
            if len(at := np.flatnonzero(sums)):
                yield {"lang": [lang] * len(at), "bucket": at, "n": sums[at]}

    counts = np.full((len(languages), BUCKETS + 1), SMOOTHING)
    place = {x: i for i, x in enumerate(languages)}
    got = map_batches(some.where(F.col("lang").isin(*languages)), count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts[got["lang"].map(place).to_numpy(int), got["bucket"].to_numpy(int)] += got["n"].to_numpy(float)
    logs = np.log(counts / counts[:, :-1].sum(axis=1, keepdims=True))
    logs[:, -1] = 0
    return LanguageBlock(languages, logs)


def fit(docs: DataFrame, rows: int = FIT_ROWS, block: int = BLOCK) -> LanguageModel:
    """Count n-grams of about `rows` documents of each language that are not held out; null ids, texts and languages are left out.

    Every language that such a document has is learned, `block` of them at a time; all weigh the same.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    names = sorted(sizes)
    if not names:
        return LanguageModel(())
    rate = F.create_map([F.lit(x) for lang, n in sizes.items() for x in (lang, int((1 << 30) * min(1.0, rows / n)))])
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < rate[F.col("lang")]).select("lang", "text")
    return LanguageModel(tuple(fit_block(some, tuple(names[a : a + block])) for a in range(0, len(names), block)))


def identify(docs: DataFrame, model: LanguageModel, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score (posterior probability) of every row's whole text, and the columns named in extra; repeated rows stay.

    `und` and 0 for a null text, one without letters, or if no language was learned.
    Each block of languages is a map over the rows, which carries the best
    language so far, its log likelihood, and the log of the sum of all.
    """
    cols = list(dict.fromkeys(["doc_id", *extra]))
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    state = "_text string, _best string, _top double, _all double"
    rows = docs.select(*cols, F.col("text").alias("_text"), F.lit("und").alias("_best"), F.lit(float("-inf")).alias("_top"), F.lit(float("-inf")).alias("_all"))

    def step(block: LanguageBlock, last: bool):  # noqa: ANN202
        sent = docs.sparkSession.sparkContext.broadcast(block)  # BUCKETS x BLOCK numbers at most

        def run(batch: dict) -> Iterator[dict]:
            text = texts_of(batch["_text"])
            kept = {c: batch[c].to_pylist() for c in (*cols, "_best")}
            before, total = batch["_top"].to_numpy(), batch["_all"].to_numpy()
            names = np.array(sent.value.languages, object)
            for a in range(0, len(text), 500):
                b = slice(a, a + 500)
                sums, n_letters = sent.value.sums(text[b])
                top = sums.max(axis=1)
                every = np.logaddexp(total[b], top + np.log(np.exp(sums - top[:, None]).sum(axis=1)))
                better = (top > before[b]) & (n_letters > 0)
                best, high = np.where(better, names[sums.argmax(axis=1)], np.array(kept["_best"][b], object)), np.where(better, top, before[b])
                out = {c: kept[c][b] for c in cols}
                if last:
                    score = np.exp(np.where(n_letters > 0, high - every, -np.inf))
                    yield out | {"lang_pred": list(best), "score": score}
                else:
                    yield out | {"_text": text[b], "_best": list(best), "_top": high, "_all": every}

        return run

    if not model.blocks:
        return rows.select(*cols, F.col("_best").alias("lang_pred"), F.lit(0.0).alias("score"))
    for i, block in enumerate(model.blocks):
        last = i == len(model.blocks) - 1
        rows = map_batches(rows, step(block, last), ddl + (", lang_pred string, score double" if last else ", " + state))
    return rows

"""Helpers that the corpus operators share: lineage cuts, Arrow maps, flat text arrays, shingle sets."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

#: Rows of an Arrow batch: with long texts, Spark's default of 10,000 would fill a worker's memory. Spark itself ends a batch at 64 MB.
BATCH_ROWS = 1000
#: Characters that one numpy pass works on; a longer text makes passes of its own.
CHUNK_CHARS = 1 << 17
SHINGLE_WORDS = 5
#: Rows, of a few numbers each, that one task writes to a table of known size.
ROWS_PER_FILE = 100_000


def cut(df: DataFrame, rows: int | None = None, session: SparkSession | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, in another session if one is named, so that a lost executor costs no recomputation.

    Where the number of rows is known to be at most `rows`, a file gets ROWS_PER_FILE of them.
    """
    spark = session or df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // ROWS_PER_FILE + 1)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_batches(df: DataFrame, f: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow with columns as Python lists or numpy arrays: f takes a batch and yields batches of result columns."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    small_batches(df.sparkSession)
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in f({n: batch.column(i) for i, n in enumerate(batch.schema.names)}):
                    yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()  # a worker lives on for other tasks

    return df.mapInArrow(run, kind)


def texts_of(column: pa.Array) -> list[str]:
    """A null text counts as an empty one."""
    return [x or "" for x in column.to_pylist()]


def runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about CHUNK_CHARS characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, a space after each, and the place where each begins (one more at the end)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    flat = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits look random (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_CHARS + (1 << 16))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"]


def raw_word_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polynomial hash, begin and end of each word [^\\x20\\x09-\\x0D]+ of flat, A-Z lower-cased; flat ends with a space."""
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    edges = np.flatnonzero(np.diff(space, prepend=True))
    begin, end = edges[0::2], edges[1::2]
    up, down = _power(len(flat))
    value = (flat + np.uint32(32) * ((flat >= 65) & (flat <= 90))).astype(np.uint64)
    value = (value + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD1342543DE82EF95)
    value ^= value >> np.uint64(29)
    value *= up
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    return (total[end] - total[begin]) * down[begin], begin, end


def word_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, begin, end = raw_word_hashes(flat)
    return mix(raw), begin, end


def hashes_of_long(text: str) -> np.ndarray:
    """Hashes of the words of one text, which is worked on in parts of CHUNK_CHARS; a word across parts is put together."""
    out, held, size = [], np.uint64(0), 0  # held, size: hash and length of a word that may go on
    with np.errstate(over="ignore"):
        for a in range(0, len(text), CHUNK_CHARS):
            flat, _ = code_points([text[a : a + CHUNK_CHARS]])
            raw, begin, end = raw_word_hashes(flat)
            length = end - begin
            if size and len(begin) and begin[0] == 0:
                raw[0] = held + raw[0] * np.uint64(pow(_BASE, size, 1 << 64))
                length[0] += size
            elif size:
                out.append(np.array([held], np.uint64))
            size = 0
            if len(end) and end[-1] == len(flat) - 1:
                held, size, raw = raw[-1], int(length[-1]), raw[:-1]
            out.append(raw)
    if size:
        out.append(np.array([held], np.uint64))
    return mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)


_PLACES = mix(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text, the 64-bit hashes of its five-word shingles in order, repeats included.

    Fewer words make one shingle of all; no words make none.
    """
    for a, b in runs(texts):
        if b - a == 1 and len(texts[a]) > CHUNK_CHARS:
            word = hashes_of_long(texts[a])
            at = np.array([0, len(word)])
        else:
            flat, starts = code_points(texts[a:b])
            word, begin, _ = word_hashes(flat)
            at = np.searchsorted(begin, starts)
        n = len(word) - SHINGLE_WORDS + 1
        five = np.zeros(0, np.uint64)
        if n > 0:
            five = word[:n] * _PLACES[0]
            for k in range(1, SHINGLE_WORDS):
                five += word[k : n + k] * _PLACES[k]
            five = mix(five)
        for i in range(b - a):
            x, y = at[i], at[i + 1]
            if y - x >= SHINGLE_WORDS:
                yield five[x : y - SHINGLE_WORDS + 1]
            elif y > x:
                yield mix((word[x:y] * _PLACES[: y - x]).sum(keepdims=True) + np.uint64(y - x))
            else:
                yield five[:0]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def only(df: DataFrame, ids: DataFrame, key: str, limit: int = 2_000_000) -> DataFrame:
    """Rows of df whose key is in ids (distinct). The ids are sent to every task up to `limit` of them (16 MB); more are joined by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids, key, "left_semi")


#: Rows of one key that one task joins with a large row of the other side.
ROWS_PER_SALT = 20_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, _parts): keys that more than ROWS_PER_SALT rows have, at most one for that many rows, and the salts that each needs. To be broadcast."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ROWS_PER_SALT)
    return F.broadcast(cut(n.select(key, (F.floor(F.col("_n") / ROWS_PER_SALT) + 1).cast("int").alias("_parts"))))


def join_hot(rows: DataFrame, big: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """rows joined on key with big, which has one large row a key: rows of a hot key are dealt over its salts by the column `by`, and its row of big is repeated for each."""
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    spread = big.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return dealt.join(spread, [key, "_salt"]).drop("_salt")

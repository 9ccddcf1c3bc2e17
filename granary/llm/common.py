"""Helpers shared by the training-text operators.

Conventions that hold for every operator here:

* a document is identified by ``doc_id`` and carries ``text``; every other column of
  the input is ignored, so extra columns may have any name, also one that the
  operator itself produces;
* a null text counts as the empty text, a null ``doc_id`` stays null in the result;
* rows that repeat are kept: the result has one row for each input row;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.shared import stored  # noqa: F401  the operators take it from here

#: Bytes that end a word for the lower-casing word rule: everything in ASCII but digits and letters.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Bytes that end a word for the white-space rule: tab to carriage return, and space.
_SPACE_BYTES = bytes(32 if 9 <= c <= 13 else c for c in range(256))


#: Bytes of an Arrow batch: what a Python worker holds of its partition at once.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the length of texts; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name, None)
    if not (given and given.rstrip("bB").isdigit() and 0 < int(given.rstrip("bB")) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and the text with null as empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def ascii_lower_words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return _words(text, _WORD_BYTES)


def space_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, unchanged, as UTF-8."""
    return _words(text, _SPACE_BYTES)


def _words(text: str, table: bytes) -> list[bytes]:
    # After the translation the space is the only white space left that bytes.split() knows
    # apart from \t..\r, which both tables turn into spaces.
    return text.encode("utf-8", "surrogatepass").translate(table).split()


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in set(text))


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Row generator over Arrow batches: ``rows`` gets the tuples of one batch and yields tuples."""
    names, types = _arrow_fields(schema)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = list(zip(*rows(zip(*(c.to_pylist() for c in batch.columns), strict=True)), strict=True))
                if columns:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
                    )

    return df.mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}


def _arrow_fields(schema: str) -> tuple[list[str], list[pa.DataType]]:
    pairs = [x.strip().split(" ", 1) for x in schema.split(",")]
    return [n for n, _ in pairs], [_ARROW[t.strip()] for _, t in pairs]


_held: dict = {}


@lru_cache(maxsize=1)
def _malloc_trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def trim() -> None:
    """Give free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def release() -> None:
    """Let go of what operators that ran before in this worker process have kept."""
    _held.clear()
    gc.collect()
    trim()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same over Arrow batches; a worker that waits for its next task holds no free memory."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return task


def held(key, build: Callable):
    """One large object, such as a vocabulary, for the tasks of a worker process; only the last one asked for stays."""
    if key not in _held:
        release()
        _held[key] = build()
    return _held[key]


class WordHashes(dict):
    """word -> 64-bit hash, with a bounded memory."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def portions(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters together, so that arrays over their words stay small."""
    start = size = 0
    for n, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield start, n + 1
            start, size = n + 1, 0
    if start < len(texts):
        yield start, len(texts)

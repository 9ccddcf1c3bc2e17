"""Quality scores from compression with dictionaries of good and of bad text.

Two zstandard dictionaries are trained, on labelled good and on labelled bad text. A text
that is like the good ones compresses better with the first, so the difference of
the two compressed sizes, over their sum, tells which it is closer to. A logistic
curve, fitted on labelled documents that neither dictionary has seen, turns it into a
probability.

Both samples are bounded; every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import id_and_text, map_rows, utf8
from granary.llm.langid import held_out

#: Bounds of what the model is fitted on: documents for each dictionary and the longest one
#: taken, bytes of a dictionary, documents for the calibration.
DICTIONARY_DOCUMENTS = 500
DICTIONARY_LONGEST = 12_000
DICTIONARY_BYTES = 64 << 10
CALIBRATION_DOCUMENTS = 3000
THRESHOLD = 0.3
LEVEL = 3


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)


def features(text: str, good: bytes, bad: bytes) -> tuple[float, float]:
    """Normalised difference of the compressed sizes, and the size per byte with the better dictionary."""
    data = utf8(text)
    with_good, with_bad = len(_compressor(good).compress(data)), len(_compressor(bad).compress(data))
    return (with_bad - with_good) / (with_bad + with_good), min(with_good, with_bad) / (len(data) + 16)


def _inputs(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x[:, 0] * 10, x[:, 1], x[:, 1] ** 2])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Coefficients of a logistic curve, by Newton's method with a small ridge."""
    z = _inputs(x)
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def curve(x: np.ndarray, weights: list[float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(x) @ np.array(weights), -30, 30)))


class Model:
    def __init__(self, good: bytes, bad: bytes, weights: list[float]):
        self.good, self.bad, self.weights = good, bad, weights

    def score(self, texts: list[str]) -> list[float]:
        if not self.weights:
            return [0.5] * len(texts)
        x = np.array([features(text, self.good, self.bad) for text in texts]).reshape(-1, 2)
        return curve(x, self.weights).tolist()


def _first(labels: DataFrame, quality: int, n: int) -> list[int]:
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    found = labels.where(F.col("quality") == quality).select("doc_id").distinct().orderBy(*order).limit(n).collect()
    return [row.doc_id for row in found]


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> Model:
    """Fit on labelled documents that aren't held out; without both labels every score is 0.5.

    Labels other than 0 and 1, null ids and null texts are left out. An id that repeats counts once, with
    the smallest of its texts. For the dictionaries texts of more than DICTIONARY_LONGEST characters
    are left out; every text is scored whole.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder)).select(
        F.col("doc_id").cast("long").alias("doc_id"), "quality"
    )
    each = DICTIONARY_DOCUMENTS + CALIBRATION_DOCUMENTS // 2
    chosen = {quality: _first(known, quality, each) for quality in (1, 0)}
    both = set(chosen[0]) & set(chosen[1])
    chosen = {quality: [i for i in ids if i not in both] for quality, ids in chosen.items()}
    texts = id_and_text(docs).where(F.length("text") > 0)
    dictionary = {}
    for quality, ids in chosen.items():
        # at most half of a small sample, so that the calibration sees something new
        part = ids[: min(DICTIONARY_DOCUMENTS, (len(ids) + 1) // 2)]
        short = texts.where(F.col("doc_id").isin(part) & (F.length("text") <= DICTIONARY_LONGEST))
        found = short.groupBy("doc_id").agg(F.min("text").alias("text")).collect() if part else []
        samples = [utf8(row.text) for row in sorted(found, key=lambda r: part.index(r.doc_id))]
        dictionary[quality] = _dictionary(samples)
    rest = {i: q for q, ids in chosen.items() for i in ids[min(DICTIONARY_DOCUMENTS, (len(ids) + 1) // 2) :]}
    if not rest or not dictionary[1] or not dictionary[0]:
        return Model(b"", b"", [])
    good, bad = dictionary[1], dictionary[0]

    def measured(batch: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in batch:
            yield doc_id, *features(text, good, bad)

    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in sorted(rest)], "doc_id long")
    sample = texts.join(F.broadcast(wanted), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = sorted(map_rows(sample, measured, "doc_id long, x double, size double").collect())
    if len({rest[row.doc_id] for row in rows}) < 2:
        return Model(b"", b"", [])
    x = np.array([(row.x, row["size"]) for row in rows])
    y = np.array([rest[row.doc_id] for row in rows], float)
    return Model(good, bad, fit_logistic(x, y))


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too few samples to train one, the samples themselves."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """Quality of every whole text.

    Returns doc_id, held_out, score (0 to 1, higher: good likelier; a null text counts as
    empty and gets the curve's value for no text) and predicted (1 from THRESHOLD on).
    """
    model = train(docs, labels, modulus, remainder)

    def rows(batch: Iterator[tuple]) -> Iterator[tuple]:
        batch = list(batch)
        return zip([doc_id for doc_id, _ in batch], model.score([text for _, text in batch]), strict=True)

    return map_rows(id_and_text(docs), rows, "doc_id long, score double").select(
        "doc_id",
        held_out(F.col("doc_id"), modulus, remainder).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

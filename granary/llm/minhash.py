"""Near-duplicate removal with DartMinHash signatures.

Every element (a shingle of words) owns the plane of weight times rank, with one dart thrown
per unit of area, at places that only hashes of the element decide. A set keeps the darts
below its elements' weights and below a rank that leaves it about k ln k + 2k of them, for
any size of the set; each dart belongs to one of k coordinates, and the smallest rank of
each coordinate is the signature. Two sets agree in a coordinate with the probability of
their (weighted) Jaccard similarity. A set that misses a coordinate looks at
twice the ranks.

Signatures are cut into bands. Texts that agree in a band are compared exactly, on
their shingles; components of the links found are the classes. Exact copies are
one text from the start, so a hot group of copies is counted, never paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WordHashes, ascii_lower_words, id_and_text, mixed, portions, release, stored, tidied

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 24
BAND_ROWS = 5
#: Up to so many texts of one bucket are compared each with each.
ALL_PAIRS = 32
#: In larger ones, so many leaders for each text come first.
LEADERS = 2
#: 64-bit words of a sketch, and texts of a large bucket on either side that are paired in one place.
SKETCH = 32
BLOCK = 512
#: Characters whose words are worked on at once.
PORTION = 1_500_000

_STEP = 0x9E3779B97F4A7C15
#: Height of the lowest stretch of ranks; each further one reaches twice as high.
_LOWEST = 1 / 64


def _level(n: int, unit: float) -> tuple[float, float]:
    """Start and end of the n-th stretch of ranks or weights: 0 to unit, then doubling."""
    return (0.0, unit) if n == 0 else (unit * 2 ** (n - 1), unit * 2**n)


@lru_cache(maxsize=64)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts in an area."""
    n = np.arange(int(mean + 12 * math.sqrt(mean) + 20))
    logs = n * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(
    elements: np.ndarray, owner: np.ndarray, n: int, k: int, weights: np.ndarray | None = None
) -> np.ndarray:
    """n x k smallest ranks (inf in sets without elements); element i belongs to set owner[i].

    Without weights every element weighs 1, and an element named twice counts once.
    """
    total = np.bincount(owner, weights=weights, minlength=n)
    out = np.full(n * k, np.inf)
    darts = k * math.log(k) + 2 * k
    missing = np.flatnonzero(total > 0)
    while len(missing):
        limit = np.zeros(n)
        limit[missing] = darts / total[missing]
        out.reshape(n, k)[missing] = np.inf
        _throw(elements, owner, k, weights, limit, out)
        missing = missing[np.isinf(out.reshape(n, k)[missing]).any(axis=1)]
        darts *= 2
    return out.reshape(n, k)


def _throw(elements, owner, k, weights, limit, out) -> None:
    top = limit.max()
    heaviest = 1.0 if weights is None else float(weights.max())
    nu = 0
    while _level(nu, 1.0)[0] < heaviest:
        w0, w1 = _level(nu, 1.0)
        rho = 0
        while _level(rho, _LOWEST)[0] < top:
            r0, r1 = _level(rho, _LOWEST)
            reach = limit[owner] > r0
            if weights is not None:
                reach &= weights > w0
            at = np.flatnonzero(reach)
            cell = mixed(elements[at] + np.uint64((64 * nu + rho + 1) * _STEP & (1 << 64) - 1))
            count = np.searchsorted(_poisson((w1 - w0) * (r1 - r0)), _uniform(cell), "right")
            at, cell, count = at[count > 0], cell[count > 0], count[count > 0]
            item = np.repeat(at, count)
            nth = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + 1
            dart = mixed(np.repeat(cell, count) + nth.astype(np.uint64) * np.uint64(_STEP))
            rank = r0 + _uniform(dart) * (r1 - r0)
            good = rank < limit[owner[item]]
            if weights is not None:
                good &= w0 + _uniform(mixed(dart ^ np.uint64(_STEP))) * (w1 - w0) < weights[item]
            dart, rank, item = dart[good], rank[good], item[good]
            coordinate = ((dart * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) * k >> 31
            np.minimum.at(out, owner[item] * k + coordinate, rank)
            rho += 1
        nu += 1


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one shingle."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for d in range(min(size, len(words))):
        out = out * np.uint64(0x100000001B3) + mixed(words[d : d + n])
    return mixed(out)


def _bands(texts: list[str], size: int, bands: int, rows: int, hashes: WordHashes):
    """(16-byte hash of the words, band hashes; both None without words) of each text."""
    names, parts = [], []
    for text in texts:
        words = ascii_lower_words(text)
        names.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
        parts.append(shingles(hashes.array(words), size))
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    ranks = signatures(np.concatenate(parts), owner, len(texts), bands * rows).view(np.uint64)
    ranks = ranks.reshape(len(texts), bands, rows)
    out = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(texts), 0)
    for r in range(rows):
        out = mixed(out * np.uint64(0x100000001B3) + ranks[:, :, r])
    values = out.view(np.int64).tolist()
    return names, [v if name else None for name, v in zip(names, values, strict=True)]


def sign(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, tag (hash of the text), node (16-byte hash of its words) and its band hashes."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes = WordHashes()
        for batch in batches:
            texts, names, values = batch.column(2).to_pylist(), [], []
            for start, stop in portions(texts, PORTION):
                node, found = _bands(texts[start:stop], size, bands, rows, hashes)
                names += node
                values += found
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(values, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "node", "bands"])

    keyed = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("tag"), "text")
    return keyed.mapInArrow(run, "doc_id long, tag long, node binary, bands array<long>")


def _words_of(docs: DataFrame) -> DataFrame:
    """node and its words, compressed."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            names, packed = [], []
            for text in batch.column(0).to_pylist():
                if words := b" ".join(ascii_lower_words(text)):
                    names.append(xxhash.xxh3_128_digest(words))
                    packed.append(pack(words))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(packed, pa.binary())], names=["node", "words"])

    return id_and_text(docs).select("text").mapInArrow(run, "node binary, words binary")


def _compared(pairs: DataFrame, words: DataFrame, size: int, threshold: float) -> DataFrame:
    """a, b and whether their sets of shingles have the similarity asked for."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes, unpack = WordHashes(), zstandard.ZstdDecompressor().decompress
        known: dict[bytes, np.ndarray] = {}

        def of(packed: bytes) -> np.ndarray:
            found = known.get(packed)
            if found is None:
                if len(known) >= 64:
                    known.clear()
                found = known[packed] = np.unique(shingles(hashes.array(unpack(packed).split(b" ")), size))
            return found

        for batch in batches:
            alike = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = of(left), of(right)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    alike.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(both >= threshold * (len(x) + len(y) - both))
            columns = [batch.column(0), batch.column(1), pa.array(alike, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "alike"])

    left = words.select(F.col("node").alias("a"), F.col("words").alias("words_a"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("words_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "words_a", "words_b")
    return joined.mapInArrow(run, "a binary, b binary, alike boolean")


def _ordered(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _each_with_each(members: DataFrame, key: str) -> DataFrame:
    x, y = members.alias("x"), members.alias("y")
    both = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}")).where(F.col("x.node") < F.col("y.node"))
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once, with n, its number of rows."""
    return rows.join(stored(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")), key)


def _sketches(words: DataFrame, size: int) -> DataFrame:
    """node, total (its number of shingles) and w0, w1, ...: bit h says if an odd number of shingles hash to h."""
    names = [f"w{k}" for k in range(SKETCH)]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes, unpack = WordHashes(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            totals, rows = [], np.zeros((batch.num_rows, SKETCH), np.int64)
            for n, packed in enumerate(batch.column(1).to_pylist()):
                found = np.unique(shingles(hashes.array(unpack(packed).split(b" ")), size))
                odd = np.bincount((found % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
                rows[n] = np.packbits(odd.astype(np.uint8)).view(np.int64)
                totals.append(len(found))
            columns = [batch.column(0), pa.array(totals, pa.int64()), *(pa.array(rows[:, k]) for k in range(SKETCH))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "total", *names])

    return words.select("node", "words").mapInArrow(run, ", ".join(["node binary", "total long", *(f"{w} long" for w in names)]))


def _across(large: DataFrame, found: DataFrame, words: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs a < b of large buckets that ``found`` leaves in different components and that may be alike.

    Pairs within a component would change no class. So in each bucket all texts outside of its
    largest component meet all texts of the bucket. Of these pairs only those are left out that
    cannot be alike: shingles of one text alone flip at most one bit of the sketch each, so
    the bits that differ are no more than the shingles that are not shared. Both sides are dealt into
    blocks that meet two by two, so that a hot bucket is spread.
    """
    labelled = large.join(components(found), "node", "left").select("bucket", "n", "node", F.coalesce("label", "node").alias("label"))
    sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("m")).groupBy("bucket")
    most = sizes.agg(F.max(F.struct("m", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    rows = stored(labelled.join(stored(most.select("bucket", "most")), "bucket"))
    sketches = stored(_sketches(words.join(rows.select("node").distinct(), "node", "left_semi"), size))
    blocks = {"x": F.ceil((F.col("n") - F.col("most.m")) / BLOCK).cast("int"), "y": F.ceil(F.col("n") / BLOCK).cast("int")}
    rows = rows.join(sketches, "node").withColumns(blocks)
    own = lambda side: F.pmod(F.xxhash64("node"), side).cast("int")
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1))
    x = rows.where(F.col("label") != F.col("most.label")).withColumn("i", own("x")).withColumn("j", every("y")).alias("x")
    y = rows.withColumn("j", own("y")).withColumn("i", every("x")).alias("y")
    total = F.col("x.total") + F.col("y.total")
    differ = sum((F.bit_count(F.col(f"x.w{k}").bitwiseXOR(F.col(f"y.w{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col("x.w0").bitwiseXOR(F.col("y.w0"))))
    shorter, longer = F.least("x.total", "y.total"), F.greatest("x.total", "y.total")
    may_be = (shorter >= threshold * longer - 1e-6 * total) & ((total - differ) * (1 + threshold) >= (2 * threshold - 1e-6) * total)
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("bucket", "i", "j")]
    met = x.join(y, [*same, F.col("x.label") != F.col("y.label"), may_be])
    return met.select(*_ordered(F.col("x.node"), F.col("y.node"))).distinct()


def links(docs: DataFrame, signed: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs a < b of nodes, verified exactly, whose components are those of all links among candidates.

    Texts that agree in a band are candidates. Up to ALL_PAIRS texts of a bucket are compared
    each with each. A larger bucket holds near copies of one text, or texts that share a long passage:
    there each text is first compared with the LEADERS texts that share most with all others, as the
    original of many copies does. This links most near copies at a few pairs a text; then all other
    pairs of such a bucket are looked at, but those whose texts are in one component by now.
    """
    texts = stored(signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("bands").alias("bands")))
    members = stored(_shared(texts.select("node", F.explode("bands").alias("bucket")), "bucket"))
    words = stored(
        _words_of(docs).join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("words").alias("words"))
    )
    central = members.groupBy("node").agg(F.sum("n").alias("shares"))
    large = members.where(F.col("n") > ALL_PAIRS)
    most = F.struct(F.col("shares"), F.col("node"))
    ranked = large.join(central, "node").groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(LEADERS)).alias("half"))
    leaders = stored(ranked.agg(F.max(most)["node"].alias("leader")).select("bucket", "leader"))
    led = large.join(leaders, "bucket").where(F.col("node") != F.col("leader")).select(*_ordered(F.col("node"), F.col("leader")))
    small = _each_with_each(members.where(F.col("n") <= ALL_PAIRS), "bucket")
    found = stored(_compared(stored(small.unionByName(led).distinct()), words, size, threshold)).where("alike").select("a", "b")
    if large.isEmpty():
        return found
    rest = _across(large, found, words, size, threshold)
    return found.unionByName(stored(_compared(stored(rest), words, size, threshold)).where("alike").select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for every node of an edge.

    Labels go to the neighbours and then jump to their labels' labels, so rounds grow with the
    logarithm of a component's width.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        low = labels.join(heard, F.col("node") == F.col("a")).select("node", "label", F.least("label", "heard").alias("low"))
        roots = labels.select(F.col("node").alias("root"), F.col("label").alias("jump"))
        after = stored(
            low.join(roots, F.col("low") == F.col("root"), "left").select(
                "node", F.least("low", F.coalesce("jump", "low")).alias("label"), (F.col("label") != F.least("low", F.coalesce("jump", "low"))).alias("moved")
            )
        )
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels


def classify(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Classes of near-duplicate documents.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; two documents are
    linked if their sets of ``size``-word shingles have a Jaccard similarity of ``threshold``
    or more (a shorter text is one shingle), and classes are the components of links. Returns one
    row per row of ``docs``: doc_id, tag (hash of the text), class_id (the smallest doc_id of the class), class_size
    and kept (true for the row with the smallest doc_id of its class, the smallest tag among
    equal ids). A null id comes after all others: class_id is null only where no row of the class has an
    id. A document without words is a class of its own: its class_id is its id. Rows
    that repeat share their class and are all kept or not.
    """
    signed = stored(sign(docs, size))
    labels = components(links(docs, signed, size, threshold))
    nodes = signed.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first"), F.count("*").alias("n")
    )
    placed = stored(nodes.join(labels, "node", "left").select("node", "first", "n", F.coalesce("label", "node").alias("label")))
    classes = placed.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"))
    member = placed.select("node", "label").join(classes, "label").select("node", "first", "class_size")
    return signed.join(member, "node", "left").select(
        "doc_id",
        "tag",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tag") == F.col("first.tag")))).alias("kept"),
    )


def keep_first(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each near-duplicate class, with all columns of ``docs``; rows that repeat stay once."""
    kept = classify(docs, size, threshold).where("kept").select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"))
    tagged = docs.withColumn("__tag_of", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = tagged.join(
        kept.distinct(), tagged["doc_id"].cast("long").eqNullSafe(kept["__id"]) & (F.col("__tag_of") == F.col("__tag")), "left_semi"
    )
    return joined.dropDuplicates(["doc_id", "__tag_of"]).select(*docs.columns)

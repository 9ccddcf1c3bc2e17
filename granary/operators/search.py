"""Hashed embeddings and explainable hybrid search of a set of queries against all chunks.

The query set is held by every task, in blocks of bounded size; chunks are read once and never paired
up in a join. Each task keeps the best rows of each query, so that only queries x pool x tasks rows are shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.config import DOMAIN_PHRASES, RELIABILITY_BOOST, SEARCH_STOPWORDS
from granary.functions.text import fold, folded_tokens, once, phrases, squash, tokens, total
from granary.sources import policy as P
from granary.sources.shared import stored

DIMENSIONS = 256
MIN_SCORE = 0.02
#: Queries that a task holds at once.
QUERY_BLOCK = 2000
#: Chunks that are scored at once.
ROWS = 1000
#: Hits, a few numbers each, that may be sent to all tasks.
BROADCAST_HITS = 200_000


def bucket(token: Column) -> Column:
    """md5 of a token modulo 256."""
    return F.conv(F.right(F.md5(token.cast("binary")), F.lit(2)), 16, 10).cast("int")


def hash_embed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, bucket and weight of the unit-length bag-of-words vector of each row's text, in long form; nothing is shuffled."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("bucket", T.IntegerType()), T.StructField("weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = _Embedder()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                vectors = embed(_Words(part.column(1)))
                row, place = np.nonzero(vectors)
                columns = [part.column(0).take(pa.array(row)), pa.array(place, pa.int32()), pa.array(vectors[row, place])]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "bucket", "weight"])

    return docs.select(key, tokens(F.col(text)).alias("words")).mapInArrow(run, schema)


#: The version of hashed vectors.
HASH_VERSION = f"hash-{DIMENSIONS}"


def with_embedding(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, the unit-length bag-of-words vector as ``embedding map<int,double>``, and ``embedding_version``."""
    schema = T.StructType([*docs.schema, T.StructField("embedding", T.MapType(T.IntegerType(), T.DoubleType())), T.StructField("embedding_version", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = _Embedder()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                vectors = embed(_Words(part.column(part.num_columns - 1)))
                row, place = np.nonzero(vectors)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                maps = pa.MapArray.from_arrays(pa.array(ends), pa.array(place, pa.int32()), pa.array(vectors[row, place].astype(float)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], maps, pa.array([HASH_VERSION] * part.num_rows)], names=schema.names)

    return docs.select("*", F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("__words")).mapInArrow(run, schema)


def cosine(left: Column, right: Column) -> Column:
    """0 for empty vectors or vectors of different length."""
    dot = F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    ok = (F.size(left) == F.size(right)) & (norm(left) > 0) & (norm(right) > 0)
    return F.when(ok, dot / (norm(left) * norm(right))).otherwise(0.0)


def _important(words: Column) -> Column:
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in SEARCH_STOPWORDS]))


def _counted(query: Column, text: Column, use) -> Column:
    """``use`` gets a struct of the query's words, its important ones, and how many of them and of its phrases occur."""

    def count(x: Column) -> Column:
        important = _important(x["words"])
        return F.struct(
            F.size(x["words"]).alias("words"),
            F.size(important).alias("important"),
            F.size(F.array_intersect(important, x["tokens"])).alias("hit"),
            F.size(F.filter(phrases(x["words"]), lambda p: F.contains(x["folded"], p))).alias("phrase"),
        )

    parts = F.struct(tokens(query).alias("words"), tokens(text, 1).alias("tokens"), fold(text).alias("folded"))
    return once(once(parts, count), use)


def keyword_boost(query: Column, text: Column) -> Column:
    def boost(c: Column) -> Column:
        cover = c["hit"] / F.greatest(F.lit(1), c["important"])
        score = F.least(F.lit(1.4), c["hit"] * 0.08 + c["phrase"] * 0.18 + cover * 0.32)
        return F.when((c["words"] == 0) | (text == ""), 0.0).otherwise(score)

    return _counted(query, text, boost)


def title_boost(query: Column, title: Column) -> Column:
    return _counted(query, title, lambda c: F.when(title == "", 0.0).otherwise(F.least(F.lit(0.5), c["hit"] * 0.08 + c["phrase"] * 0.12)))


def domain_phrase_boost(query: Column, text: Column) -> Column:
    q, t = F.array_join(tokens(query), " "), fold(text)
    each = [F.when(F.contains(q, F.lit(p)) & F.contains(t, F.lit(p)), v).otherwise(0.0) for p, v in DOMAIN_PHRASES.items()]
    return F.least(F.lit(1.1), total(each))


class _Words:
    """A column of lists of words: its different words, and for each place its row and which of them it is."""

    def __init__(self, lists: pa.Array):
        coded = lists.flatten().dictionary_encode()
        self.rows = len(lists)
        self.words: list[str] = coded.dictionary.to_pylist()
        self.which = coded.indices.to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


class _Embedder:
    """Unit vectors of token buckets, with a bounded memory of words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _bucket(self, word: str) -> int:
        place = self.known.get(word)
        if place is None:
            if len(self.known) > 200_000:
                self.known.clear()
            place = self.known[word] = hashlib.md5(word.encode()).digest()[-1]
        return place

    def __call__(self, words: _Words) -> np.ndarray:
        places = np.array([self._bucket(w) for w in words.words], np.int64)
        at = words.row * DIMENSIONS + (places[words.which] if len(places) else 0)
        vectors = np.bincount(at, minlength=words.rows * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.float64)
        norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


class _Index:
    """Terms and the queries that have them: counts, for rows that hold terms, how many each query has."""

    def __init__(self, terms: list[list[str]]):
        self.n = len(terms)
        owners: dict[str, list[int]] = {}
        for query, own in enumerate(terms):
            for term in own:
                owners.setdefault(term, []).append(query)
        self.number = {term: k for k, term in enumerate(owners)}
        self.sizes = np.array([len(x) for x in owners.values()], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.owner = np.array([q for x in owners.values() for q in x], np.int64)

    def count(self, rows: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        """rows x queries; a term that a row holds several times counts once, for a query that has it twice, twice."""
        pair = np.unique(row * max(1, len(self.sizes)) + term)
        row, term = np.divmod(pair, max(1, len(self.sizes)))
        n = self.sizes[term]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        query = self.owner[np.repeat(self.first[term], n) + nth]
        return np.bincount(np.repeat(row, n) * self.n + query, minlength=rows * self.n).reshape(rows, self.n)


class _Queries:
    """A block of queries, ready to be scored against chunks."""

    def __init__(self, rows: list[tuple]):
        import ahocorasick

        self.ids = [r[0] for r in rows]
        self.vectors = _Embedder()(_Words(pa.array([r[1] for r in rows], pa.list_(pa.string()))))
        self.important = np.array([max(1, len(r[2])) for r in rows])
        self.empty = np.array([not r[1] for r in rows])
        self.domain = np.array([[v if p in " ".join(r[1]) else 0.0 for p, v in DOMAIN_PHRASES.items()] for r in rows]).reshape(len(rows), -1)
        self.words, self.phrases = _Index([r[2] for r in rows]), _Index([r[3] for r in rows])
        self.automaton = ahocorasick.Automaton()
        for phrase, k in self.phrases.number.items():
            self.automaton.add_word(phrase, k)
        self.automaton.make_automaton()

    def word_hits(self, words: _Words) -> np.ndarray:
        """Important words of each query in each row."""
        number = np.array([self.words.number.get(w, -1) for w in words.words], np.int64)
        term = number[words.which] if len(number) else words.which
        return self.words.count(words.rows, words.row[term >= 0], term[term >= 0])

    def phrase_hits(self, texts: list[str]) -> np.ndarray:
        """Phrases of each query in each text; every text is read once."""
        found = [{k for _, k in self.automaton.iter(text)} if self.phrases.number else () for text in texts]
        row = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        return self.phrases.count(len(texts), row, np.array([k for x in found for k in x], np.int64))

    def domain_hits(self, texts: list[str]) -> np.ndarray:
        holds = np.array([[p in text for p in DOMAIN_PHRASES] for text in texts], np.float64).reshape(len(texts), -1)
        return np.minimum(1.1, holds @ self.domain.T)


def prepare_chunks(chunks: DataFrame) -> DataFrame:
    """What scoring needs of each chunk, once at index time: folded text, tokens, dedupe key, reliability, penalty."""
    title, url, text = F.col("title"), F.col("url"), F.col("text")
    warnings = P.source_warnings(title, url, text)
    level = P.infer_reliability(url, F.coalesce("reliability_level", F.lit("internet")))
    folded = chunks.select(
        "chunk_id",
        "source_id",
        F.coalesce(fold(text), F.lit("")).alias("folded"),
        F.coalesce(fold(title), F.lit("")).alias("folded_title"),
        F.sha2(F.lower(squash(F.substring(text, 1, 240))).cast("binary"), 256).alias("text_key"),
        F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in RELIABILITY_BOOST.items()], F.lit(0.0)).alias("reliability"),
        P.source_penalty(warnings).alias("penalty"),
    )
    return folded.select(
        F.col("chunk_id").cast("long").alias("chunk_id"), F.col("source_id").cast("string").alias("source_id"), "text_key", "reliability", "penalty",
        "folded", "folded_title", folded_tokens(F.col("folded")).alias("tokens"), folded_tokens(F.col("folded_title")).alias("title_tokens"),
    )


def query_block(queries: DataFrame, key: str, text: str) -> DataFrame:
    words = tokens(F.col(text))
    return queries.select(F.col(key).cast("long").alias("query_id"), words.alias("words"), _important(words).alias("important"), phrases(words).alias("phrases"))


def hybrid_search(chunks: DataFrame, queries: DataFrame, key: str, text: str, pool: int = 40) -> DataFrame:
    """query_id, chunk_id, source_id, place, score and its six parts: the ``pool`` best hits of each query.

    Scores above MIN_SCORE count, rounded to four places, ties by chunk_id; of hits with the same
    source and the same first 240 characters only the best stays. Chunks are scored where they
    are; only the best hits of each task are shuffled, never a text.
    """
    prepared = prepare_chunks(chunks)
    asked = query_block(queries, key, text)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    if blocks > 1:
        prepared = stored(prepared)
    found = None
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).collect()
        part = prepared.mapInArrow(_scorer([tuple(r) for r in rows], pool), _HITS)
        part = part if blocks == 1 else stored(part)
        found = part if found is None else found.unionByName(part)
    best = [F.desc("score"), "chunk_id"]
    once_ = F.row_number().over(Window.partitionBy("query_id", "source_id", "text_key").orderBy(*best))
    different = found.withColumn("nth", once_).where("nth = 1").drop("nth", "text_key")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*best)).cast("long")
    return different.withColumn("place", place).where(F.col("place") <= pool)


def texts_of(hits: DataFrame, texts: DataFrame, key: str, most: int) -> DataFrame:
    """Hits with their texts. ``most`` bounds the hits: up to BROADCAST_HITS of them go to the texts, which then stay where they are."""
    return texts.join(F.broadcast(hits), key) if most <= BROADCAST_HITS else texts.join(hits, key)


_PARTS = ("vector", "keyword", "title", "domain", "reliability", "penalty")
_HITS = "query_id long, chunk_id long, source_id string, text_key string, score double, " + ", ".join(f"s_{p} double" for p in _PARTS)


def _scored(queries: _Queries, embed: _Embedder, batch: pa.RecordBatch) -> list[np.ndarray]:
    """rows x queries: score and its parts."""
    column = {name: batch.column(name) for name in batch.schema.names}
    words, folded, folded_title = _Words(column["tokens"]), column["folded"].to_pylist(), column["folded_title"].to_pylist()
    vector = embed(words) @ queries.vectors.T
    hit, phrase = queries.word_hits(words), queries.phrase_hits(folded)
    keyword = np.minimum(1.4, hit * 0.08 + phrase * 0.18 + hit / queries.important * 0.32)
    keyword[:, queries.empty] = 0.0
    keyword[np.array([not text for text in folded], bool)] = 0.0
    hit, phrase = queries.word_hits(_Words(column["title_tokens"])), queries.phrase_hits(folded_title)
    title = np.minimum(0.5, hit * 0.08 + phrase * 0.12)
    domain = queries.domain_hits([f"{a} {b}" for a, b in zip(folded_title, folded, strict=True)])
    reliability, penalty = (np.repeat(np.array(column[c], np.float64)[:, None], len(queries.ids), 1) for c in ("reliability", "penalty"))
    return [vector + keyword + title + domain + reliability - penalty, vector, keyword, title, domain, reliability, penalty]


def _scorer(rows: list[tuple], pool: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        queries, embed = _Queries(rows), _Embedder()
        # best hit of each source and text, for each query; never more than the pool stay
        best: list[dict[tuple, tuple]] = [{} for _ in rows]
        step = max(1, ROWS * 100 // (100 + len(rows)))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                score, *parts = _scored(queries, embed, batch)
                # half up, as Spark and SQL round
                rounded = np.floor(score * 10000 + 0.5 + 1e-9) / 10000
                chunk = np.array(batch.column("chunk_id"), np.int64)
                places = list(zip(batch.column("source_id").to_pylist(), batch.column("text_key").to_pylist(), strict=True))
                for n, hits in enumerate(best):
                    good = np.flatnonzero(score[:, n] > MIN_SCORE)
                    if len(hits) >= pool:
                        good = good[rounded[good, n] >= min(x[0] for x in hits.values())]
                    new: set[tuple] = set()
                    for r in good[np.lexsort((chunk[good], -rounded[good, n]))].tolist():
                        if places[r] not in new:  # the first one of its place is the best of this batch
                            new.add(places[r])
                            old, hit = hits.get(places[r]), (float(rounded[r, n]), int(chunk[r]))
                            if old is None or (hit[0], -hit[1]) > (old[0], -old[1]):
                                hits[places[r]] = (*hit, *(float(p[r, n]) for p in parts))
                            if len(new) >= pool:
                                break
                    if len(hits) > pool:
                        best[n] = dict(heapq.nlargest(pool, hits.items(), key=lambda x: (x[1][0], -x[1][1])))
        out = [(query, hit[1], *place, hit[0], *hit[2:]) for query, hits in zip(queries.ids, best, strict=True) for place, hit in hits.items()]
        if out:
            names = [x.split()[0] for x in _HITS.split(", ")]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.float64()] * (1 + len(_PARTS))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def dense_search(vectors: DataFrame, queries: DataFrame, key: str, column: str, k: int = 5) -> DataFrame:
    """query_id, key, place and cosine of the k nearest rows of each query, the query itself left out.

    Scores are rounded to five places, ties go by key. Queries come in blocks; a task multiplies its batches with a block and
    keeps the best k of each query, so that it sends k rows a query, however many rows it reads. Vectors that are null, hold
    a null or have another length than the query have no score with it.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("vector"))
    if blocks > 1:
        rows = stored(rows)
    found = None
    for b in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).select(F.col(key).cast("long"), F.col(column).cast("array<double>")).collect()
        part = rows.mapInArrow(_nearest([(r[0], r[1]) for r in asked], k), "query_id long, key long, score double")
        part = part if blocks == 1 else stored(part)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    ranked = found.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)
    return ranked.select("query_id", F.col("key").alias(key), "place", "score")


class _Nearest:
    """The first k rows of each query: higher scores first, ties by key."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._open = 0

    def add(self, score: np.ndarray, keys: np.ndarray) -> None:
        """``score`` is queries x rows, minus infinity where there is none."""
        query, row = np.nonzero((score >= self.floor[:, None]) & (score > -np.inf))
        self._parts.append((query, score[query, row], keys[row]))
        self._open += len(query)
        if self._open > 1_000_000:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, score, keys = (np.concatenate(x) for x in zip(*self._parts, strict=True)) if self._parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        order = np.lexsort((keys, -score, query))
        query, score, keys = query[order], score[order], keys[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        last = nth == self.k - 1
        self.floor[query[last]] = score[last]
        self._parts, self._open = [tuple(x[nth < self.k] for x in (query, score, keys))], 0
        return self._parts[0]


def _nearest(asked: list[tuple[int, list[float] | None]], k: int):
    def units(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """length -> (places, unit vectors) of those that are whole."""
        by_length: dict[int, list[int]] = {}
        for n, v in enumerate(vectors):
            if v is not None and None not in v:
                by_length.setdefault(len(v), []).append(n)
        out = {}
        for length, places in by_length.items():
            x = np.array([vectors[n] for n in places], np.float64).reshape(len(places), length)
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            out[length] = np.array(places), np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, given = np.array([a for a, _ in asked], np.int64), units([v for _, v in asked])
        best = _Nearest(len(asked), k)
        step = max(1, 2_000_000 // max(1, len(asked)))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                keys = np.array(batch.column(0), np.int64)
                for length, (places, rows) in units(batch.column(1).to_pylist()).items():
                    if length in given:
                        own, vectors = given[length]
                        score = np.full((len(asked), len(places)), -np.inf)
                        # half up, as Spark and SQL round
                        score[own] = np.floor(vectors @ rows.T * 100_000 + 0.5 + 1e-9) / 100_000
                        score[ids[:, None] == keys[places][None, :]] = -np.inf
                        best.add(score, keys[places])
        query, score, keys = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(keys), pa.array(score)], names=["query_id", "key", "score"])

    return run


def evaluate(cases: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """Per case: recall of expected terms, reciprocal rank of the first hit with all top terms, pass flag.

    ``cases`` has query_id, expected and top (arrays of lower-case terms); ``hits`` has query_id, place and lower-case text.
    """
    ranked = hits.where(F.col("place") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("hits"))
    rows = cases.join(ranked, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<place:bigint,text:string>>")))
    every = F.array_join(F.transform("hits", lambda h: h["text"]), " ")
    matched = F.size(F.filter("expected", lambda t: F.contains(every, t)))
    holds = F.filter("hits", lambda h: F.forall("top", lambda t: F.contains(h["text"], t)))
    rank = F.when(F.size(holds) > 0, 1.0 / holds[0]["place"]).otherwise(0.0)
    some = F.size("hits") > 0
    first_ok = (F.size("top") == 0) | (some & F.forall("top", lambda t: F.contains(F.col("hits")[0]["text"], t)))
    enough = some & ((F.size("expected") == 0) | (matched >= F.greatest(F.lit(1), F.floor(F.size("expected") / 2))))
    recall = F.when(F.size("expected") > 0, matched / F.size("expected")).otherwise(some.cast("double"))
    return rows.select("query_id", recall.alias("recall"), rank.alias("reciprocal_rank"), some.alias("cited"), (enough & first_ok).alias("passed"))


def evaluation_summary(results: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 3)
    return results.agg(
        F.count("*").alias("cases"), mean("passed").alias("pass_rate"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"),
        mean("cited").alias("cite_rate"), F.round(1 - F.avg(F.col("cited").cast("double")), 3).alias("refusal_rate"),
    )

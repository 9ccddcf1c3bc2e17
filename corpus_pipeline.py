"""Corpus pipeline: from raw documents to token ids, in five stages.

Each stage gets what its predecessor kept, as a table that was written and read again,
and its decisions take effect. All but the last return the columns of ``documents``.

1. language ID: documents without any letter (no language) go;
2. MinHash near-dedup: of each near-duplicate class the document with the smallest id stays;
3. substring dedup: words in a window of 20 that also starts earlier are cut out;
4. benchmark decontamination: documents with a window of 10 benchmark words go;
5. byte-level BPE: token counts, and hashes of the ids and of the bytes decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, decontaminate, langid, minhash, queries, substring
from granary.llm.common import bounded_batches, documents, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return langid.keep_identified(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return minhash.keep_first(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    cut = substring.remove_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontaminate.remove_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return bpe.encode_documents(docs, queries.VOCABULARY, queries.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", decontaminate_benchmark),
    ("byte-level BPE", encode),
]
#: Models and signatures are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs)
    return docs

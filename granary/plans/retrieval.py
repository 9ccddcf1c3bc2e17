"""Queries of embedding, search and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.config import (
    BEFORE_HARVEST_TERMS, CHAT_STOPWORDS, DISEASE_TERMS, DOMAIN_PHRASES, FOLDED_STOPWORDS, HARVEST_TERMS, RELIABILITY_BOOST, SEARCH_STOPWORDS, SEED_TERMS,
)
from granary.functions import sql as S
from granary.functions import text as T
from granary.operators import answers as A
from granary.operators import search, taxonomy
from granary.plans.corpus import _PENALTY, _classified, _level, _pairs
from granary.plans.tables import SOURCES, read, sources

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _embed_sql(table: str, key: str, text: str, name: str) -> str:
    return f"""{name}b AS (SELECT {key} AS k, CAST('0x' || right(md5(t), 2) AS INT) AS b, count(*) AS n FROM (SELECT {key}, unnest({S.tokens(text)}) AS t FROM {table}) GROUP BY ALL),
    {name}v AS (SELECT k, b, n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS w FROM {name}b)"""


@query("hash_embed", f"WITH {_embed_sql('documents', 'doc_id', 'text', 'd')} SELECT k AS doc_id, b AS bucket, round(w, 6) AS weight FROM dv")
def q_embed(spark, sf):
    return search.hash_embed(read(spark, sf, "documents"), "doc_id", "text").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query("cosine_similarity", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def q_cosine(spark, sf):
    e = read(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(search.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("dense_search", "SELECT query_id, vec_id, place, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)) WHERE place <= 5")
def q_dense(spark, sf):
    e = read(spark, sf, "embeddings")
    return search.dense_search(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding")


_PAIRS = "p AS (SELECT a.conv_id, a.turn, a.text AS q, b.text AS x FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


def pairs(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("x"))
    return c.withColumnRenamed("text", "q").join(after, ["conv_id", "turn"])


_STOP = S.listed(SEARCH_STOPWORDS)
_COUNTS = f"""{_PAIRS}, w AS (SELECT *, {S.tokens('q')} AS ws, {S.fold('x')} AS fx FROM p),
n AS (SELECT *, list_filter(list_distinct(ws), lambda i: NOT list_contains({_STOP}, i)) AS imp, {S.phrases('ws')} AS ph FROM w),
h AS (SELECT *, len(list_intersect(imp, {S.tokens('x', 1)})) AS hit, len(list_filter(ph, lambda i: contains(fx, i))) AS phrase FROM n)"""


@query("keyword_boost", f"WITH {_COUNTS} SELECT conv_id, turn, round(CASE WHEN len(ws) = 0 OR x = '' THEN 0 ELSE least(1.4, hit * 0.08::DOUBLE + phrase * 0.18::DOUBLE + hit / greatest(1, len(imp)) * 0.32::DOUBLE) END, 4) AS boost FROM h")
def q_keyword(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", F.round(search.keyword_boost(F.col("q"), F.col("x")), 4).alias("boost"))


@query("title_boost", f"WITH {_COUNTS} SELECT conv_id, turn, round(CASE WHEN x = '' THEN 0 ELSE least(0.5, hit * 0.08::DOUBLE + phrase * 0.12::DOUBLE) END, 4) AS boost FROM h")
def q_title(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", F.round(search.title_boost(F.col("q"), F.col("x")), 4).alias("boost"))


_DOMAIN = " + ".join(f"CASE WHEN contains(q, '{p}') AND contains(x, '{p}') THEN {v} ELSE 0 END" for p, v in DOMAIN_PHRASES.items())


@query("domain_phrase_boost", f"WITH {SOURCES}, d AS (SELECT source_id, array_to_string({S.tokens('title')}, ' ') AS q, {S.fold('title')} AS x FROM s) SELECT source_id, round(least(1.1, {_DOMAIN})::DOUBLE, 4) AS boost FROM d")
def q_domain(spark, sf):
    return sources(spark, sf).select("source_id", F.round(search.domain_phrase_boost(F.col("title"), F.col("title")), 4).alias("boost"))


def chunks(spark, sf):
    s = sources(spark, sf)
    return s.select(F.col("doc_id").alias("chunk_id"), F.col("host_group").alias("source_id"), "title", "url", "reliability_level", F.col("raw_text").alias("text"))


def hits(spark, sf):
    return search.hybrid_search(chunks(spark, sf), read(spark, sf, "benchmark"), "item_id", "text")


_BOOST = "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RELIABILITY_BOOST.items()) + " ELSE 0.0 END"
_SEARCH = f"""{SOURCES}, {_embed_sql('documents', 'doc_id', 'text', 'd')}, {_embed_sql('benchmark', 'item_id', 'text', 'q')},
vec AS (SELECT q.k AS qk, d.k AS dk, sum(q.w * d.w) AS v FROM qv q JOIN dv d ON q.b = d.b GROUP BY ALL),
ch AS (SELECT doc_id, host_group, {S.fold('raw_text')} AS fx, {S.fold('title')} AS ft, md5(lower({S.squash('substr(raw_text, 1, 240)')})) AS tk,
  list_distinct({S.tokens('raw_text', 1)}) AS tx, list_distinct({S.tokens('title', 1)}) AS tt, {_level('url', "coalesce(reliability_level, 'internet')")} AS level,
  {S.flags(_pairs('title', 'url', 'raw_text'))} AS warnings FROM s),
qs AS (SELECT item_id, {S.tokens('text')} AS ws FROM benchmark),
qi AS (SELECT *, list_filter(list_distinct(ws), lambda i: NOT list_contains({_STOP}, i)) AS imp, {S.phrases('ws')} AS ph, array_to_string(ws, ' ') AS joined FROM qs),
sco AS (SELECT item_id, doc_id, host_group, tk,
  coalesce(v, 0) + CASE WHEN len(ws) = 0 OR fx = '' THEN 0 ELSE least(1.4::DOUBLE, len(list_intersect(imp, tx)) * 0.08::DOUBLE + len(list_filter(ph, lambda i: contains(fx, i))) * 0.18::DOUBLE + len(list_intersect(imp, tx)) / greatest(1, len(imp)) * 0.32::DOUBLE) END
  + least(0.5::DOUBLE, len(list_intersect(imp, tt)) * 0.08::DOUBLE + len(list_filter(ph, lambda i: contains(ft, i))) * 0.12::DOUBLE)
  + least(1.1, {" + ".join(f"CASE WHEN contains(joined, '{p}') AND contains(ft || ' ' || fx, '{p}') THEN {v} ELSE 0 END" for p, v in DOMAIN_PHRASES.items())})
  + {_BOOST} - {_PENALTY} AS score FROM qi CROSS JOIN ch LEFT JOIN vec ON qk = item_id AND dk = doc_id),
dd AS (SELECT *, round(score, 4) AS rs, row_number() OVER (PARTITION BY item_id, host_group, tk ORDER BY round(score, 4) DESC, doc_id) AS dup FROM sco WHERE score > 0.02),
hits AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rs DESC, doc_id) AS place FROM dd WHERE dup = 1)"""


@query("hybrid_search", f"WITH {_SEARCH} SELECT item_id AS query_id, doc_id AS chunk_id, place, rs AS score FROM hits WHERE place <= 5")
def q_search(spark, sf):
    return hits(spark, sf).where("place <= 5").select("query_id", "chunk_id", "place", F.round("score", 4).alias("score"))


@query("rank_dedupe_topk", f"WITH {_SEARCH} SELECT item_id AS query_id, doc_id AS chunk_id FROM hits WHERE place <= 10")
def q_rank(spark, sf):
    return hits(spark, sf).where("place <= 10").select("query_id", "chunk_id")


_SCOPE = f"{_SEARCH}, {_classified(chr(39).join(['title || ', ' ', ' || url']))}, sp AS (SELECT h.*, row_number() OVER (PARTITION BY item_id ORDER BY h.place) AS r FROM hits h JOIN cl USING (doc_id) WHERE h.place <= 40 AND h.doc_id % 13 <> 0 AND category = 'cham_soc_dinh_duong')"


@query("scoped_topk", f"WITH {_SCOPE} SELECT item_id AS query_id, doc_id AS chunk_id, r AS rank FROM sp WHERE r <= 5")
def q_scoped(spark, sf):
    """The pool is cut first, then seeds and other categories go: fewer than k can remain."""
    from pyspark.sql import Window

    facts = sources(spark, sf).select(F.col("doc_id").alias("chunk_id"), taxonomy.classify(F.concat_ws(" ", "title", "url"))["category"].alias("category"))
    kept = hits(spark, sf).join(facts, "chunk_id").where("chunk_id % 13 <> 0 AND category = 'cham_soc_dinh_duong'")
    order = Window.partitionBy("query_id").orderBy("place")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 5").select("query_id", "chunk_id", "rank")


_EVAL = f"""{_SEARCH}, t5 AS (SELECT item_id, place, lower(text) AS x FROM hits JOIN documents USING (doc_id) WHERE place <= 5),
cs AS (SELECT item_id, list_distinct({S.tokens('text', 6)})[1:0] AS none, list_sort(list_distinct({S.tokens('text', 6)}))[1:4] AS expected, list_sort(list_distinct({S.tokens('text', 3)}))[1:1] AS top FROM benchmark),
g AS (SELECT item_id, string_agg(x, ' ' ORDER BY place) AS allx, count(*) AS n, arg_min(x, place) AS x1 FROM t5 GROUP BY 1),
rk AS (SELECT c.item_id, min(place) FILTER (len(list_filter(top, lambda i: contains(x, i))) = len(top)) AS p FROM cs c JOIN t5 USING (item_id) GROUP BY 1),
ev AS (SELECT c.item_id, expected, top, coalesce(n, 0) AS n, len(list_filter(expected, lambda i: contains(allx, i))) AS m, x1, p FROM cs c LEFT JOIN g USING (item_id) LEFT JOIN rk USING (item_id))"""
_CASES = f"SELECT item_id, CASE WHEN len(expected) > 0 THEN coalesce(m, 0) / len(expected) ELSE CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END END AS recall, coalesce(1.0 / p, 0) AS rr, n > 0 AS cited, n > 0 AND (len(expected) = 0 OR m >= greatest(1, len(expected) // 2)) AND (len(top) = 0 OR len(list_filter(top, lambda i: contains(x1, i))) = len(top)) AS passed FROM ev"


def top_texts(spark, sf, texts, k=5):
    """query_id, chunk_id, place and what ``texts`` has of the k best chunks."""
    top = hits(spark, sf).where(F.col("place") <= k).select("query_id", "chunk_id", "place", "score", "source_id")
    return search.texts_of(top, texts, "chunk_id", read(spark, sf, "benchmark").count() * k)


def evaluation(spark, sf):
    words = lambda n: F.array_sort(F.array_distinct(T.tokens(F.col("text"), n)))
    cases = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(words(6), 1, 4).alias("expected"), F.slice(words(3), 1, 1).alias("top"))
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.lower("text").alias("text"))
    return search.evaluate(cases, top_texts(spark, sf, texts))


@query("retrieval_eval", f"WITH {_EVAL}, c AS ({_CASES}) SELECT count(*) AS cases, round(avg(CASE WHEN passed THEN 1.0 ELSE 0 END), 3) AS pass_rate, round(avg(recall), 3) AS recall, round(avg(rr), 3) AS mrr, round(avg(CASE WHEN cited THEN 1.0 ELSE 0 END), 3) AS cite_rate, round(1 - avg(CASE WHEN cited THEN 1.0 ELSE 0 END), 3) AS refusal_rate FROM c")
def q_eval(spark, sf):
    return search.evaluation_summary(evaluation(spark, sf))


@query("cite_sources", f"WITH {_SEARCH} SELECT item_id AS query_id, host_group AS source_id, min(place) AS rank FROM hits WHERE place <= 10 GROUP BY ALL")
def q_cite(spark, sf):
    return hits(spark, sf).where("place <= 10").groupBy("query_id", "source_id").agg(F.min("place").alias("rank"))


_STOPS = S.listed([*dict.fromkeys(A.folded_word(w) for w in CHAT_STOPWORDS), *FOLDED_STOPWORDS])
_TERMS = f"list_filter(list_distinct({S.tokens('b.text')}), lambda t: NOT list_contains({_STOPS}, t))"
_MATCHED = "list_filter(ws, lambda t: CASE WHEN len(t) <= 3 THEN list_contains(regexp_extract_all(x, '[\\p{L}\\p{N}_]+'), t) ELSE contains(x, t) END)"
_ASKED = f"qt AS (SELECT item_id, {S.fold('b.text')} AS q, {_TERMS} AS ws FROM benchmark b)"
_GATE_SQL = f"""{_SEARCH}, {_ASKED}, g AS (SELECT item_id, string_agg({S.fold("(raw_text || ' ' || title || ' ' || url)")}, ' ' ORDER BY place) AS x FROM hits JOIN s USING (doc_id) WHERE place <= 5 GROUP BY 1),
m AS (SELECT item_id, ws, x, {_MATCHED} AS matched FROM qt JOIN g USING (item_id))"""


def asked_terms(spark, sf):
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), A.important_terms(F.col("text")).alias("ws"))


@query("relevance_gate", f"""WITH {_GATE_SQL} SELECT item_id AS query_id, len(matched) AS matched, CASE WHEN len(ws) = 0 THEN true
  WHEN len(list_intersect(ws, {S.listed(SEED_TERMS)})) > 0 THEN {S.has_any('x', SEED_TERMS)} AND len(matched) >= 1
  WHEN len(list_intersect(ws, {S.listed(DISEASE_TERMS)})) > 0 THEN len(matched) >= 1 ELSE len(matched) >= least(2, len(ws)) END AS enough FROM m""")
def q_gate(spark, sf):
    texts = sources(spark, sf).select(F.col("doc_id").alias("chunk_id"), T.fold(F.concat_ws(" ", "raw_text", "title", "url")).alias("x"))
    together = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda h: h["x"]), " ")
    joined = top_texts(spark, sf, texts).groupBy("query_id").agg(together.alias("x"))
    rows = asked_terms(spark, sf).join(joined, "query_id").withColumn("matched", A.matched_terms(F.col("ws"), F.col("x")))
    return rows.select("query_id", F.size("matched").cast("long").alias("matched"), A.is_enough(F.col("ws"), F.col("matched"), F.col("x")).alias("enough"))


_LOW = "|".join(A.TRAINING_NOISE)
_ON_TOPIC = f"CASE WHEN contains(q, 'truoc thu hoach') THEN {S.has_any('x', BEFORE_HARVEST_TERMS)} WHEN contains(q, 'thu hoach') THEN {S.has_any('x', HARVEST_TERMS)} ELSE true END"
_IS_LOW = rf"(regexp_matches(x, '(^|[^\p{{L}}\p{{N}}_])({_LOW})($|[^\p{{L}}\p{{N}}_])') AND NOT ((contains(q, 'truoc thu hoach') OR (contains(q, 'thu hoach') AND {S.has_any('q', ('luu y', 'cham soc', 'chuan bi'))})) AND {S.has_any('x', ('truoc thu hoach', 'qua chin'))}))"


@query("filter_relevant_chunks", f"""WITH {_SEARCH}, {_ASKED}, h5 AS (SELECT item_id, doc_id, place, q, ws, {S.squash(S.fold("(title || ' ' || url || ' ' || raw_text)"))} AS x FROM hits JOIN s USING (doc_id) JOIN qt USING (item_id) WHERE place <= 5),
f AS (SELECT *, len(ws) = 0 OR (len({_MATCHED}) > 0 AND {_ON_TOPIC} AND NOT {_IS_LOW}) AS good FROM h5) SELECT item_id AS query_id, doc_id AS chunk_id FROM (SELECT *, bool_or(good) OVER (PARTITION BY item_id) AS any_good FROM f) WHERE good OR (NOT any_good AND place = 1)""")
def q_filter(spark, sf):
    from pyspark.sql import Window

    texts = sources(spark, sf).select(F.col("doc_id").alias("chunk_id"), T.squash(T.fold(F.concat_ws(" ", "title", "url", "raw_text"))).alias("x"))
    top = top_texts(spark, sf, texts).join(asked_terms(spark, sf), "query_id")
    question, x, ws = F.col("question"), F.col("x"), F.col("ws")
    good = (F.size(ws) == 0) | ((F.size(A.matched_terms(ws, x)) > 0) & A.is_on_topic(question, x) & ~A.is_low_value(question, x))
    flagged = top.withColumn("good", good).withColumn("some", F.max("good").over(Window.partitionBy("query_id")))
    return flagged.where(F.col("good") | (~F.col("some") & (F.col("place") == 1))).select("query_id", "chunk_id")


_ISSUE = " OR ".join([
    r"regexp_matches(lower(x), '(^|[^\p{L}\p{N}_])(carbendazim|mancozeb|glyphosate|chlorpyrifos|copper oxychloride)($|[^\p{L}\p{N}_])')",
    r"regexp_matches(lower(x), '(liều|pha|phun)\s+\d+.*(thuốc|hoạt chất|trừ|diệt|nấm|sâu|cỏ)')",
    r"(regexp_matches(lower(x), '(^|[^\p{L}\p{N}_])\d+([,.]\d+)?\s?(ml|g|kg|l|lit|lít|gram)($|[^\p{L}\p{N}_])') AND regexp_matches(lower(x), '(thuốc|hoạt chất|trừ sâu|trừ nấm|diệt cỏ|bảo vệ thực vật|bv tv)'))",
    *(f"contains(lower(x), '{c}')" for c in ("chắc chắn khỏi", "đảm bảo khỏi", "không có rủi ro")),
])


@query("safe_recommendations", f"""WITH {_SEARCH}, c AS (SELECT item_id, string_agg(text, ' ' ORDER BY place) AS x FROM hits JOIN documents USING (doc_id) WHERE place <= 2 GROUP BY 1),
p AS (SELECT item_id, list_filter(list_transform(string_split(replace(x, chr(10), ' '), '.'), lambda x: trim(x)), lambda x: len(x) BETWEEN 45 AND 220 AND NOT ({_ISSUE}))[1:4] AS ok FROM c)
SELECT item_id AS query_id, CASE WHEN len(ok) = 0 THEN {S.quoted(A.NO_ADVICE)} ELSE array_to_string(ok, '|') END AS items FROM p""")
def q_safe(spark, sf):
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    together = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda h: h["text"]), " ")
    found = top_texts(spark, sf, texts, 2).groupBy("query_id").agg(together.alias("x"))
    return found.select("query_id", F.array_join(A.recommendations(F.col("x")), "|").alias("items"))

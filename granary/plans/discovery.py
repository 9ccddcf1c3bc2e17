"""Queries on pages, links, cleaned text, chunks and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.config import CHAT_STOPWORDS, DISEASE_TERMS, HARVEST_CHECKLIST, SEED_TERMS
from granary.functions import folds
from granary.functions import sql as S
from granary.functions import text as T
from granary.operators import answers as A
from granary.operators import discovery as D
from granary.plans.corpus import _PENALTY, _level, _pairs
from granary.plans.tables import SOURCES, read, sources
from granary.sources import policy as P

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("extract_title", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def q_title(spark, sf):
    return read(spark, sf, "pages").select("page_id", D.title(F.col("html")).alias("title"))


@query("normalize_link", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_replace(url_decode(regexp_replace(url, '[?#].*$', '')), '/+$', '') ELSE '' END AS link FROM pages")
def q_normalize(spark, sf):
    return read(spark, sf, "pages").select("page_id", D.normalize_link(F.col("url")).alias("link"))


_SIGNALS = (*D.SIGNALS, "/fr/", "/en/", ".org")
_H, _PATH = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))", "regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '^/+|/+$', '', 'g')"


@query("link_is_relevant", f"SELECT page_id, CASE WHEN {S.has_any(_H, D.BLOCKED_HOSTS)} THEN false WHEN {S.has_any(f'({_H} || chr(47) || {_PATH})', D.BLOCKED_PATHS)} OR regexp_matches({_PATH}, '\\.(jpg|jpeg|png|webp|gif|svg|css|js)$') THEN false ELSE {S.has_any(f'({_H} || chr(47) || {_PATH})', _SIGNALS)} END AS relevant FROM pages")
def q_relevant(spark, sf):
    return read(spark, sf, "pages").select("page_id", D.is_relevant(F.col("url"), _SIGNALS).alias("relevant"))


@query("fetch_preflight", "SELECT event_id, CASE WHEN user_id % 10 <> 0 AND event_type NOT IN ('view', 'click') THEN 'content_type' WHEN user_id % 10 <> 0 AND value > 100 THEN 'content_length' END AS skip_reason FROM events")
def q_preflight(spark, sf):
    status = F.when(F.col("user_id") % 20 == 0, 405).when(F.col("user_id") % 10 != 0, 200)
    kind = F.when(F.col("event_type") == "view", "text/html; charset=utf-8").when(F.col("event_type") == "click", "application/pdf").otherwise("video/mp4")
    return read(spark, sf, "events").select("event_id", D.preflight(status, kind, F.col("value"), 100).alias("skip_reason"))


_LEXICON = ("cà phê", "bệnh", "giống", "the", "tưới", "phân bón")


@query("candidate_score", f"""WITH {SOURCES}, h AS (SELECT *, lower(title || ' ' || substr(raw_text, 1, 200) || ' ' || url) AS hay, {_level('url', "'internet'")} AS level,
  {S.flags(_pairs('title', 'url', 'substr(raw_text, 1, 200)'))} AS warnings, {S.tokens('host_group || title')} AS qt FROM s)
  SELECT source_id, round(greatest(0, len(list_filter(list_distinct(qt), lambda i: contains(hay, i))) * 0.8::DOUBLE + len({S.hits('hay', _LEXICON)}) * 0.35::DOUBLE + CASE level WHEN 'official' THEN 2.2 WHEN 'semi_official' THEN 1.1 ELSE 0 END - {_PENALTY} * 2.0)::DOUBLE, 3) AS score FROM h""")
def q_candidate(spark, sf):
    text = F.substring("raw_text", 1, 200)
    hay = F.lower(F.concat_ws(" ", "title", text, "url"))
    terms = F.array_distinct(T.tokens(F.concat("host_group", "title")))
    penalty = P.source_penalty(P.source_warnings(F.col("title"), F.col("url"), text))
    return sources(spark, sf).select("source_id", D.candidate_score(terms, hay, F.col("url"), penalty, _LEXICON).alias("score"))


@query("unwrap_redirect_url", "SELECT page_id, url AS target FROM pages")
def q_unwrap(spark, sf):
    """Wraps each page's address as two search engines do, and gets it back."""
    url = F.col("url")
    ddg = F.concat(F.lit("//duckduckgo.com/l/?x=1&uddg="), F.url_encode(url), F.lit("&rut=2"))
    b64 = F.regexp_replace(F.translate(F.regexp_replace(F.base64(url.cast("binary")), r"\s", ""), "+/", "-_"), "=+$", "")
    bing = F.concat(F.lit("https://www.bing.com/ck/a?!&u=a1"), b64, F.lit("&ntb=1"))
    wrapped = F.when(F.col("page_id") % 3 == 0, ddg).when(F.col("page_id") % 3 == 1, bing).otherwise(url)
    return read(spark, sf, "pages").select("page_id", D.unwrap_redirect(wrapped).alias("target"))


_VARIANTS = ("khuyến nông", "tài liệu kỹ thuật", "PDF", "pdf", "phân bón", "cà phê")


@query("query_variants", f"""WITH t AS (SELECT item_id, {S.squash('text')} AS t FROM benchmark), v AS (SELECT item_id, list_transform([t, {", ".join(f"t || ' {x}'" for x in _VARIANTS)}], lambda x: CASE WHEN contains(lower(x), 'cà phê') THEN x ELSE x || ' cà phê' END) AS v FROM t),
  k AS (SELECT item_id, list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i)[1:8] AS v FROM v) SELECT item_id, CAST(i - 1 AS INT) AS variant, v[i] AS query FROM (SELECT item_id, v, unnest(range(1, len(v) + 1)) AS i FROM k)""")
def q_variants(spark, sf):
    found = D.query_variants(T.squash(F.col("text")), list(_VARIANTS), "cà phê")
    return read(spark, sf, "benchmark").select("item_id", F.posexplode(found).alias("variant", "query"))


@query("triage_links", "WITH l AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url, page_id FROM pages), h AS (SELECT url, replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), 'www.', '') AS host, min(page_id) AS p FROM l GROUP BY ALL), seeds AS (SELECT DISTINCT host FROM h WHERE p % 3 = 0), seen AS (SELECT DISTINCT url FROM l WHERE page_id % 5 = 0), t AS (SELECT url, CASE WHEN host NOT IN (SELECT host FROM seeds) THEN 'candidate_external' WHEN url IN (SELECT url FROM seen) THEN 'seen' ELSE 'queued' END AS state, p FROM h), n AS (SELECT url, row_number() OVER (ORDER BY p, url) AS place FROM t WHERE state = 'queued') SELECT url, CASE WHEN place > 40 THEN 'over_budget' ELSE state END AS state FROM t LEFT JOIN n USING (url)")
def q_triage(spark, sf):
    rows = read(spark, sf, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("url"), "page_id")
    first = rows.groupBy("url").agg(F.min("page_id").alias("p"))
    return D.triage(rows, first.where("p % 3 = 0"), rows.where("page_id % 5 = 0"), budget=40, order=("page_id",))


# ---------------------------------------------------------------- folds over text (small helpers, rows only)
@query("extract_html_text")
def q_html(spark, sf):
    text = folds.html_text_udf("html")
    return read(spark, sf, "pages").select("page_id", text.alias("text")).withColumn("n", F.length("text"))


@query("extract_links")
def q_links(spark, sf):
    links = F.transform(folds.html_links_udf("html", "url"), D.normalize_link)
    kept = F.filter(links, lambda x: (x != "") & D.is_relevant(x))
    first = F.slice(F.array_sort(F.array_distinct(kept)), 1, 25)
    return read(spark, sf, "pages").select("page_id", F.array_join(first, " ").alias("links"))


@query("clean_text")
def q_clean(spark, sf):
    return read(spark, sf, "documents").select("doc_id", folds.clean_text_udf("text").alias("cleaned")).withColumn("n", F.length("cleaned"))


@query("chunk_documents")
def q_chunks(spark, sf):
    return folds.chunk_documents(read(spark, sf, "documents"), "doc_id", F.regexp_replace("text", "\n", "\n\n"))


_AT = "2024-01-01T00:00:00+00:00"


@query("chunk_metadata", f"""WITH {SOURCES}, c AS (SELECT *, list_filter(string_split(raw_text, chr(10)), lambda x: len(trim(x)) >= 40) AS ls FROM s)
SELECT sha1(source_id || '#' || (i - 1)) AS chunk_id, source_id, 'manual' AS source_type, coalesce(nullif(title, 'Untitled'), 'Tài liệu chưa đặt tên') AS title, url, NULL::VARCHAR AS file_name, NULL::INT AS page, '{_AT}' AS crawled_at,
  coalesce(reliability_level, 'manual') AS reliability_level, CASE WHEN doc_id % 2 = 0 THEN 'disease' END AS category, NULL::VARCHAR AS category_label, NULL::DOUBLE AS category_confidence, '' AS category_terms, CAST(i - 1 AS INT) AS ordinal
FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM c)""")
def q_metadata(spark, sf):
    lines = F.filter(F.split("raw_text", "\n"), lambda x: F.length(F.trim(x)) >= 40)
    rows = sources(spark, sf).select(
        "source_id", F.nullif("title", F.lit("Untitled")).alias("title"), "url", "reliability_level",
        F.when(F.pmod("doc_id", F.lit(2)) == 0, "disease").alias("category"), F.posexplode(lines).alias("ordinal", "text"),
    )
    found = D.with_metadata(rows, _AT)
    return found.withColumn("category_terms", F.array_join("category_terms", ",")).drop("text")


# ---------------------------------------------------------------- parts of answers
PLACES = ("Tây Nguyên", "Đắk Lắk", "Đắk Nông", "Gia Lai", "Lâm Đồng", "Kon Tum", "Tây Bắc", "Sơn La", "Điện Biên", "Lai Châu")


_ITEMS = ", ".join(f"CASE WHEN {S.has_any('f', triggers)} THEN {S.quoted(item)} END" for triggers, item in HARVEST_CHECKLIST)
_TALK = "title || ' ' || raw_text || CASE WHEN doc_id % 5 = 0 THEN ' sân phơi, quả xanh ở Gia Lai' ELSE '' END"


@query("mentions", f"WITH {SOURCES}, k AS (SELECT source_id, lower({_TALK}) AS l, {S.fold('(' + _TALK + ')')} AS f FROM s) SELECT source_id, array_to_string(list_filter({S.listed(PLACES)}, lambda p: contains(l, lower(p))), ',') AS places, array_to_string(list_filter([{_ITEMS}], lambda x: x IS NOT NULL), ' ') AS checklist FROM k")
def q_mentions(spark, sf):
    talk = F.concat("title", F.lit(" "), "raw_text", F.when(F.col("doc_id") % 5 == 0, " sân phơi, quả xanh ở Gia Lai").otherwise(""))
    places = T.once(F.lower(talk), lambda low: F.filter(F.array(*[F.lit(p) for p in PLACES]), lambda p: F.contains(low, F.lower(p))))
    return sources(spark, sf).select("source_id", F.array_join(places, ",").alias("places"), F.array_join(A.checklist(talk), " ").alias("checklist"))


_OLD, _MIXED, _BROKEN = A.OLD_LETTERS, A.MIXED_CASE, A.BROKEN


@query("ocr_garbage_flag", f"SELECT doc_id, regexp_matches(text, '{_OLD}') OR regexp_matches(text, '{_MIXED}') OR (n > 0 AND (CASE WHEN len(text) < 120 THEN true ELSE n >= 3 OR n / greatest(1, len(text)) > 0.010 END)) AS garbage FROM (SELECT doc_id, text, len(regexp_extract_all(lower(text), '{_BROKEN}')) AS n FROM documents)")
def q_ocr(spark, sf):
    return read(spark, sf, "documents").select("doc_id", A.is_garbage(F.col("text")).alias("garbage"))


_LOW = "|".join(f"({p})" for p in A.LOW_VALUE_LINES)


def _garbage_sql(x: str) -> str:
    n = f"len(regexp_extract_all(lower({x}), '{_BROKEN}'))"
    return f"(regexp_matches({x}, '{_OLD}') OR regexp_matches({x}, '{_MIXED}') OR ({n} > 0 AND (len({x}) < 120 OR {n} >= 3 OR {n} / greatest(1, len({x})) > 0.010)))"


_ASKED = "list_filter(list_distinct(string_split_regex(lower(title || ' the with from'), '[^\\p{L}\\p{N}_]+')), lambda t: len(t) >= 4 AND NOT list_contains(" + S.listed(CHAT_STOPWORDS) + ", t))"


@query("summarize_extractive", f"""WITH {SOURCES}, p AS (SELECT doc_id, {_ASKED} AS ask, unnest(range(1, len(ps) + 1)) AS i, ps FROM (SELECT *, string_split_regex(raw_text, '[.\n]') AS ps FROM s)),
  s1 AS (SELECT doc_id, ask, i, {S.squash('ps[i]')} AS x FROM p), k AS (SELECT *, len(list_filter(ask, lambda t: contains(lower(x), t))) AS hits FROM s1 WHERE len(x) BETWEEN 35 AND 260 AND NOT starts_with(x, ',') AND NOT regexp_matches(lower(x), {S.quoted(_LOW)}) AND NOT {_garbage_sql('x')}),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i) AS place FROM k) SELECT doc_id, md5(string_agg('- ' || x || '.', chr(10) ORDER BY i)) AS summary, count(*) AS sentences FROM r WHERE place <= 4 GROUP BY 1""")
def q_summary(spark, sf):
    """Row-local: sentences are ranked within the array of their document, by words of the question, here title and three words."""
    words = F.array_distinct(F.split(F.lower(F.concat("title", F.lit(" the with from"))), r"[^\p{L}\p{N}_]+"))
    asked = F.filter(words, lambda t: (F.length(t) >= 4) & ~t.isin(*CHAT_STOPWORDS))
    parts = F.transform(F.split("raw_text", r"[.\n]"), lambda x, i: F.struct(i.alias("i"), T.squash(x).alias("x")))
    kept = F.filter(parts, lambda p: F.length(p["x"]).between(35, 260) & ~F.startswith(p["x"], F.lit(",")) & ~F.lower(p["x"]).rlike(_LOW) & ~A.is_garbage(p["x"]))
    rows = sources(spark, sf).select("doc_id", asked.alias("asked"), kept.alias("kept"))
    found = lambda x: F.size(F.filter("asked", lambda t: F.contains(x, t)))
    scored = F.transform("kept", lambda p: F.struct((-found(F.lower(p["x"]))).alias("k"), p["i"].alias("i"), p["x"].alias("x")))
    ordered = F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, 4), lambda p: F.struct(p["i"].alias("i"), p["x"].alias("x"))))
    some = rows.select("doc_id", ordered.alias("s")).where(F.size("s") > 0)
    body = F.array_join(F.transform("s", lambda p: F.concat(F.lit("- "), p["x"], F.lit("."))), "\n")
    return some.select("doc_id", F.md5(body).alias("summary"), F.size("s").cast("long").alias("sentences"))


@query("label_query", "SELECT doc_id, concat_ws(' ', CASE WHEN quality = 1 THEN 'cây khỏe' ELSE 'gỉ sắt' END, CASE WHEN toxic = 1 THEN 'lá vàng' END, 'cà phê triệu chứng nguyên nhân xử lý') AS q FROM labels")
def q_label(spark, sf):
    label = F.when(F.col("quality") == 1, "cây khỏe").otherwise("gỉ sắt")
    return read(spark, sf, "labels").select("doc_id", A.label_query(label, F.when(F.col("toxic") == 1, "lá vàng")).alias("q"))


_FOLDED = f"list_distinct({S.tokens('text')})"


@query("term_overlap", f"WITH q AS (SELECT doc_id, {_FOLDED} AS w FROM documents) SELECT doc_id, len(list_intersect(w, {S.listed(SEED_TERMS)})) AS seeds, len(list_intersect(w, {S.listed(DISEASE_TERMS)})) AS diseases FROM q")
def q_overlap(spark, sf):
    words = F.array_distinct(T.tokens(F.col("text")))
    common = lambda terms: F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in terms]))).cast("long")
    return read(spark, sf, "documents").select("doc_id", common(SEED_TERMS).alias("seeds"), common(DISEASE_TERMS).alias("diseases"))

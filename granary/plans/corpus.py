"""Queries of the corpus build: reliability, warnings, gate, dedupe, taxonomy, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import config
from granary.config import POLICY
from granary.functions import sql as S
from granary.functions import text as T
from granary.operators import answers as A
from granary.operators import dedupe, quality, taxonomy
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


joined = lambda c: F.array_join(c, ",")


# ---------------------------------------------------------------- SQL building blocks
def _host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def _in(url: str, domains) -> str:
    h = f"replace({_host(url)}, 'www.', '')"
    return "(" + " OR ".join(f"{h} = '{d}' OR ends_with({h}, '.{d}')" for d in domains) + ")"


def _level(url: str, current: str) -> str:
    return f"""CASE WHEN {current} IN ('official', 'semi_official', 'manual') THEN {current}
      WHEN {_in(url, POLICY.official)} THEN 'official' WHEN {_in(url, POLICY.semi_official)} THEN 'semi_official'
      WHEN {S.has_any(_host(url), POLICY.official_tokens)} THEN 'official'
      WHEN {S.has_any(_host(url), POLICY.semi_official_tokens)} THEN 'semi_official' ELSE 'internet' END"""


def _pairs(title: str, url: str, text: str):
    h, head = _host(url), f"lower({title} || ' ' || {url} || ' ' || substr({text}, 1, 1200))"
    official = f"({_level(url, 'NULL')}) = 'official'"
    low = f"({_in(url, POLICY.low_trust)} OR {S.has_any(h, POLICY.low_trust_tokens)} OR {S.has_any(head, POLICY.low_trust_tokens)})"
    return [
        ("low_trust_commercial_domain", f"{low} AND NOT {official}"),
        ("commercial_or_vendor_content", f"NOT {official} AND {S.matches(head, config.COMMERCIAL)}"),
        ("possible_vietnamese_encoding_error", S.matches(f"({title} || ' ' || substr({text}, 1, 400))", config.BAD_ENCODING)),
        ("social_source_too_short_for_rag", f"{S.has_any(h, POLICY.social_tokens)} AND len({text}) < 800"),
    ]


_PENALTY = "least(0.9, " + " + ".join(f"CASE WHEN list_contains(warnings, '{w}') THEN {p} ELSE 0 END" for w, p in POLICY.penalties.items()) + ")"
_SHRUNK = "(len(raw_text) > 0 AND len(cleaned_text) / len(raw_text) < 0.15)"
_SHORT = "len(cleaned_text) < 500"
_CRITICAL = f"list_filter(warnings, lambda w: list_contains({S.listed(POLICY.critical)}, w))"


def _rel_penalty(level: str) -> str:
    return f"CASE {level} WHEN 'official' THEN 0.0 WHEN 'semi_official' THEN 0.08 WHEN 'manual' THEN 0.05 ELSE 0.22 END"


def _review(level: str, score: str) -> str:
    ok = f"({score} >= 0.65 AND len({_CRITICAL}) = 0 AND {level} IN ('manual', 'official', 'semi_official'))"
    bad = f"({score} < 0.25 OR len({_CRITICAL}) >= 3)"
    return f"""CASE WHEN {ok} THEN 'approved' WHEN {bad} THEN 'rejected' ELSE 'needs_review' END AS review_status,
    CASE WHEN {ok} THEN 'indexed' WHEN {bad} THEN 'blocked' ELSE 'held_for_review' END AS indexing_status,
    CASE WHEN {ok} AND {level} = 'manual' THEN 'manual source passed quality gate' WHEN {ok} THEN 'trusted source passed quality gate'
      WHEN {bad} THEN 'critical quality/reliability risk' ELSE 'source needs human review before indexing' END AS decision_reason,
    array_to_string({_CRITICAL}, ',') AS blocking"""


GATE = f"""{SOURCES}, w AS (
  SELECT *, {_level('url', 'reliability_level')} AS level,
    {S.flags([('cleaned_text_too_short', _SHORT), ('too_much_text_removed', _SHRUNK), *_pairs('title', 'url', 'cleaned_text')])} AS warnings FROM s
), q AS (SELECT *, round(quality_score0, 9) AS quality_score FROM (
  SELECT *, greatest(0.0, least(1.0, 1.0 - {_rel_penalty('reliability_level')} - least(0.5, len(warnings) * 0.08)
    - CASE WHEN {_SHORT} THEN 0.18 ELSE 0 END - CASE WHEN {_SHRUNK} THEN 0.12 ELSE 0 END))::DOUBLE AS quality_score0 FROM w)
)"""

CHUNKS = """c AS (
  SELECT source_id, count(*) AS chunk_count, avg(len(x)) AS avg_chunk_chars
  FROM (SELECT source_id, unnest(string_split(raw_text, chr(10))) AS x FROM s) WHERE len(trim(x)) >= 40 GROUP BY source_id
)"""
REPORT = f"""{SOURCES}, {CHUNKS}, r0 AS (
  SELECT s.*, {_level('url', 'reliability_level')} AS level, chunk_count, avg_chunk_chars,
    {S.duplicate_line_ratio('cleaned_text')}::DOUBLE AS dup, {S.noise_line_ratio('cleaned_text')}::DOUBLE AS noise, {S.signal_ratio('cleaned_text')}::DOUBLE AS signal
  FROM s LEFT JOIN c ON s.source_id = c.source_id
), r1 AS (
  SELECT *, {S.flags([('cleaned_text_too_short', _SHORT), ('too_much_text_removed', _SHRUNK),
    ('possible_boilerplate_or_marketing_noise', 'noise > 0.18'), ('high_duplicate_lines', 'dup > 0.16'),
    ('chunks_too_small', 'avg_chunk_chars < 350'), ('missing_source_locator', "url = ''"), ('internet_source_needs_review', "level = 'internet'"),
    *_pairs('title', 'url', 'cleaned_text')])} AS warnings FROM r0
), r2 AS (
  SELECT *, round(greatest(0.0, 1.0 - {_rel_penalty('level')} - least(0.45, len(warnings) * 0.07) - least(0.2, noise) - least(0.2, dup) - {_PENALTY})::DOUBLE, 9) AS quality_score FROM r1
), r AS (SELECT *, {_review('level', 'quality_score')} FROM r2)"""


def chunk_sizes(src: DataFrame) -> DataFrame:
    """Lines of 40 characters or more as chunks: their number and mean size, null without any, within each source's row."""
    sized = src.withColumn("sizes", F.transform(F.filter(F.split("raw_text", "\n"), lambda x: F.length(F.trim(x)) >= 40), F.length))
    n, all_ = F.nullif(F.size("sizes"), F.lit(0)), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    return sized.withColumns({"chunk_count": n.cast("long"), "avg_chunk_chars": all_ / n}).drop("sizes")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each source, from its own row; ``host_group`` and ``doc_id`` stay with it."""
    return quality.source_quality(chunk_sizes(sources(spark, sf_dir)), "doc_id", "host_group")


# ---------------------------------------------------------------- predicates on sources
@query("source_type", f"WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN split_part(url, '?', 1) || '.pdf' WHEN 1 THEN split_part(url, '#', 1) || '/a.DOCX?x=1' ELSE url END AS url FROM pages) SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '\\.(pdf|docx|txt)$') THEN regexp_extract(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '\\.(pdf|docx|txt)$', 1) ELSE 'web' END AS source_type FROM p")
def q_source_type(spark, sf):
    base = F.when(F.col("page_id") % 5 == 0, F.concat(F.substring_index("url", "?", 1), F.lit(".pdf"))).when(
        F.col("page_id") % 5 == 1, F.concat(F.substring_index("url", "#", 1), F.lit("/a.DOCX?x=1"))
    ).otherwise(F.col("url"))
    return read(spark, sf, "pages").select("page_id", P.source_type(base).alias("source_type"))


@query("infer_reliability", f"WITH {SOURCES} SELECT source_id, {_level('url', 'reliability_level')} AS level FROM s")
def q_reliability(spark, sf):
    return sources(spark, sf).select("source_id", P.infer_reliability(F.col("url"), F.col("reliability_level")).alias("level"))


@query("source_warnings", f"WITH {SOURCES} SELECT source_id, array_to_string({S.flags(_pairs('title', 'url', 'cleaned_text'))}, ',') AS warnings FROM s")
def q_warnings(spark, sf):
    return sources(spark, sf).select("source_id", joined(P.source_warnings(F.col("title"), F.col("url"), F.col("cleaned_text"))).alias("warnings"))


@query("source_penalty", f"WITH {SOURCES}, w AS (SELECT source_id, {S.flags(_pairs('title', 'url', 'cleaned_text'))} AS warnings FROM s) SELECT source_id, round(CAST({_PENALTY} AS DOUBLE), 4) AS penalty FROM w")
def q_penalty(spark, sf):
    warned = P.source_warnings(F.col("title"), F.col("url"), F.col("cleaned_text"))
    return sources(spark, sf).select("source_id", F.round(P.source_penalty(warned), 4).alias("penalty"))


@query("match_trusted_domains", f"WITH {SOURCES}, d AS (SELECT unnest({S.listed(POLICY.official + POLICY.semi_official)}) AS domain) SELECT source_id, domain FROM (SELECT source_id, replace({_host('url')}, 'www.', '') AS h FROM s) JOIN d ON h = domain OR ends_with(h, '.' || domain)")
def q_domains(spark, sf):
    """Host suffixes turn the suffix match into an equality; the domain list is a fixed policy, so it is broadcast."""
    domains = spark.createDataFrame([(d,) for d in POLICY.official + POLICY.semi_official], "domain string")
    rows = sources(spark, sf).select("source_id", F.explode(P.host_suffixes(P.bare_host(F.col("url")))).alias("domain"))
    return rows.join(F.broadcast(domains), "domain").select("source_id", "domain")


@query("indexing_warnings", f"WITH {GATE} SELECT source_id, array_to_string(warnings, ',') AS warnings FROM q")
def q_indexing_warnings(spark, sf):
    return quality.gate(sources(spark, sf)).select("source_id", joined("warnings").alias("warnings"))


@query("indexing_quality_score", f"WITH {GATE} SELECT source_id, round(quality_score, 4) AS quality_score FROM q")
def q_indexing_score(spark, sf):
    return quality.gate(sources(spark, sf)).select("source_id", F.round("quality_score", 4).alias("quality_score"))


@query("review_decision", f"WITH {GATE} SELECT source_id, {_review('level', 'quality_score')} FROM q")
def q_review(spark, sf):
    g = quality.gate(sources(spark, sf))
    return g.select("source_id", "review_status", "indexing_status", "decision_reason", joined("blocking_warnings").alias("blocking"))


@query("exclude_seed_samples", "SELECT doc_id FROM documents WHERE NOT (doc_id % 13 = 0 OR source IN ('src1', 'src5'))")
def q_seed(spark, sf):
    seed = F.coalesce(F.col("doc_id") % 13 == 0, F.lit(False)) | F.coalesce(F.col("source").isin("src1", "src5"), F.lit(False))
    return read(spark, sf, "documents").where(~seed).select("doc_id")


@query("backfill_category", f"""WITH {SOURCES}, {{classified}} SELECT source_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'khac_lien_quan' END, category) AS category FROM cl""")
def q_backfill(spark, sf):
    stored = F.when(F.col("doc_id") % 3 == 0, "khac_lien_quan")
    return sources(spark, sf).select("source_id", F.coalesce(stored, taxonomy.classify(F.concat_ws(" ", "title", "url"))["category"]).alias("category"))


def _classified(text: str, keep: str = "s.*") -> str:
    folded = S.squash(S.fold(text))
    scores = ", ".join(
        f"(SELECT len(h) + 1.5 * len(list_filter(h, lambda t: contains(t, ' '))) FROM (SELECT {S.hits('f', terms)} AS h))" for terms in taxonomy.FOLDED.values()
    )
    counts = ", ".join(f"len({S.hits('f', terms)})" for terms in taxonomy.FOLDED.values())
    return f"""fo AS (SELECT s.*, {folded} AS f FROM s), sc AS (SELECT *, [{scores}]::DOUBLE[] AS scores, [{counts}] AS counts FROM fo),
    cl AS (SELECT *, CASE WHEN list_max(scores) > 0 THEN list_extract({S.listed(taxonomy.FOLDED)}, list_position(scores, list_max(scores))) ELSE 'khac_lien_quan' END AS category,
      round(least(1.0, list_max(scores) / 4.0), 3) AS confidence, list_extract(counts, list_position(scores, list_max(scores))) AS n_terms FROM sc)"""


SQL["backfill_category"] = SQL["backfill_category"].format(classified=_classified("title || ' ' || url"))


@query("classify_text", f"WITH {SOURCES}, {_classified(chr(39).join(['title || ', ' ', ' || url || ', ' ', ' || substr(cleaned_text, 1, 4000)']))} SELECT source_id, category, confidence, CAST(n_terms AS INT) AS n_terms FROM cl")
def q_classify(spark, sf):
    text = F.concat_ws(" ", "title", "url", F.substring("cleaned_text", 1, 4000))
    return sources(spark, sf).select("source_id", taxonomy.classify(text).alias("c")).select("source_id", "c.*")


@query("category_scope", f"WITH {SOURCES}, {_classified(chr(39).join(['title || ', ' ', ' || url']))} SELECT source_id FROM cl WHERE (CASE WHEN doc_id % 4 = 0 THEN 'bao_ve_cay_trong' ELSE 'x' END) = 'bao_ve_cay_trong' OR category = 'bao_ve_cay_trong'")
def q_scope(spark, sf):
    stored = F.when(F.col("doc_id") % 4 == 0, "bao_ve_cay_trong").otherwise("x")
    again = taxonomy.classify(F.concat_ws(" ", "title", "url"))["category"]
    return sources(spark, sf).where((stored == "bao_ve_cay_trong") | (again == "bao_ve_cay_trong")).select("source_id")


@query("confidence_band", "SELECT event_id, CASE WHEN value / 500 >= 0.22 THEN 'cao' WHEN value / 500 >= 0.12 THEN 'trung_binh' ELSE 'thap' END AS band FROM events")
def q_band(spark, sf):
    score = F.col("value") / 500
    return read(spark, sf, "events").select("event_id", F.when(score >= 0.22, "cao").when(score >= 0.12, "trung_binh").otherwise("thap").alias("band"))


_NAMES = {key: name for key, (name, _) in config.CATEGORIES.items()}
_KEYS = (*_NAMES, "other", None)


@query("handbook_articles", f"""WITH {SOURCES}, k AS (SELECT *, [{", ".join(S.quoted(k) if k else "NULL" for k in _KEYS)}][CAST(doc_id % {len(_KEYS)} AS INT) + 1] AS key FROM s) SELECT source_id, coalesce(nullif(nullif(title, 'Untitled'), ''), host_group || '.txt', 'Tài liệu') AS title, CASE key {" ".join(f"WHEN '{k}' THEN {S.quoted(v)}" for k, v in _NAMES.items())} ELSE coalesce(key, 'Tổng hợp') END AS category, concat_ws(' | ', reliability_level, url) AS description FROM k""")
def q_handbook(spark, sf):
    """Category by its label, an unknown one by its key, without any the default."""
    key = F.element_at(F.array(*[F.lit(k) for k in _KEYS]), (F.col("doc_id") % len(_KEYS) + 1).cast("int"))
    title = F.coalesce(F.nullif(F.nullif(F.col("title"), F.lit("Untitled")), F.lit("")), F.concat("host_group", F.lit(".txt")), F.lit("Tài liệu"))
    category = F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in _NAMES.items()], key, F.lit("Tổng hợp"))
    return sources(spark, sf).select("source_id", title.alias("title"), category.alias("category"), F.concat_ws(" | ", "reliability_level", "url").alias("description"))


@query("valid_feedback", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click', 'signup')")
def q_feedback(spark, sf):
    return read(spark, sf, "events").where(F.col("event_type").isin("view", "click", "signup")).select("event_id", "event_type")


@query("manifest_check", "SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'bad_scheme' WHEN page_id % 4 = 3 THEN 'bad_class' ELSE 'ok' END AS state, 'unreviewed' AS review_status FROM pages")
def q_manifest(spark, sf):
    scheme = F.lower(F.parse_url("url", F.lit("PROTOCOL")))
    label = F.element_at(F.array(*[F.lit(x) for x in ("than_thu", "cay_khoe", "dom_mat_cua", "other")]), (F.col("page_id") % 4 + 1).cast("int"))
    known = label.isin("gi_sat_la_ca_phe", "dom_mat_cua", "than_thu", "cay_khoe")
    state = F.when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), "bad_scheme").when(~known, "bad_class").otherwise("ok")
    return read(spark, sf, "pages").select("page_id", state.alias("state"), F.lit("unreviewed").alias("review_status"))


# ---------------------------------------------------------------- scalar functions
@query("fold_text", f"SELECT doc_id, md5({S.fold('text')}) AS folded FROM documents")
def q_fold(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query("content_hash", f"SELECT doc_id, {S.content_hash('text')} AS content_hash FROM documents")
def q_hash(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("source_id", "SELECT page_id, substr(sha1(url), 1, 16) AS source_id, 'url:' || url || '|sha256:' || sha256(html) AS dedupe_key FROM pages")
def q_source_id(spark, sf):
    key = F.concat(F.lit("url:"), "url", F.lit("|sha256:"), F.sha2("html", 256))
    return read(spark, sf, "pages").select("page_id", dedupe.source_id(F.col("url")).alias("source_id"), key.alias("dedupe_key"))


@query("short_hash", "SELECT conv_id, turn, substr(sha256(text), 1, 12) AS short_hash, len(text) AS n FROM conversations")
def q_short_hash(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", dedupe.short_hash(F.col("text")).alias("short_hash"), F.length("text").cast("long").alias("n"))


@query("clean_noise", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s.,;:!?%()/\-+]', ' ', 'g'), '[ \t]+', ' ', 'g')) AS cleaned FROM documents")
def q_clean_noise(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(T.clean_noise(F.col("text"))).alias("cleaned"))


@query("tokens", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)")
def q_tokens(spark, sf):
    t = read(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("query_phrases", f"WITH t AS (SELECT item_id, {S.tokens('text')} AS t FROM benchmark) SELECT item_id, array_to_string({S.phrases('t')}, '|') AS phrases FROM t")
def q_phrases(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.array_join(T.phrases(T.tokens(F.col("text"))), "|").alias("phrases"))


@query("query_terms", rf"SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda t: len(t) >= 3), {S.tokens('text')}))), ' ') AS terms FROM benchmark")
def q_terms(spark, sf):
    raw = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) >= 3)
    return read(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_union(raw, T.tokens(F.col("text")))), " ").alias("terms"))


_STOP = [*dict.fromkeys(A.folded_word(w) for w in config.CHAT_STOPWORDS), *config.FOLDED_STOPWORDS]


@query("important_query_terms", f"SELECT item_id, array_to_string(list_sort(list_filter(list_distinct({S.tokens('text')}), lambda t: NOT list_contains({S.listed(_STOP)}, t))), ' ') AS terms FROM benchmark")
def q_important(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(A.important_terms(F.col("text"))), " ").alias("terms"))


@query("duplicate_line_ratio", f"SELECT doc_id, round({S.duplicate_line_ratio('text')}::DOUBLE, 6) AS ratio FROM documents")
def q_dup_ratio(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.round(T.duplicate_line_ratio(F.col("text")), 6).alias("ratio"))


@query("noise_line_ratio", f"SELECT doc_id, round({S.noise_line_ratio('text')}::DOUBLE, 6) AS ratio FROM documents")
def q_noise_ratio(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.round(T.noise_line_ratio(F.col("text")), 6).alias("ratio"))


@query("vietnamese_signal_ratio", f"SELECT doc_id, round({S.signal_ratio('text')}::DOUBLE, 6) AS ratio FROM documents")
def q_signal(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.round(T.signal_ratio(F.col("text")), 6).alias("ratio"))


@query("drop_repeated_headers", r"""WITH l AS (
  SELECT doc_id, i, trim(ls[i]) AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
), k AS (SELECT *, regexp_replace(lower(l), '\d+', '#', 'g') AS key FROM l),
r AS (SELECT doc_id, key FROM k WHERE len(l) BETWEEN 5 AND 120 GROUP BY ALL HAVING count(*) >= 3)
SELECT doc_id, count(*) FILTER (r.key IS NULL) AS kept, md5(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (r.key IS NULL), '')) AS digest
FROM k LEFT JOIN r USING (doc_id, key) GROUP BY doc_id""")
def q_headers(spark, sf):
    """Row-local: the repeated keys of a document come from its own array of lines. A document without a text has no lines."""
    # F.trim itself takes a second argument, which would be the place of the line
    ls = F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(T.SPACES)))
    key = lambda x: F.regexp_replace(T.lower_each(x), r"\d+", "#")
    short = F.transform(F.filter(ls, lambda x: F.length(x).between(5, 120)), key)
    # in sorted order a key that occurs three times equals the one two places on
    often = T.once(F.array_sort(short), lambda o: F.array_distinct(F.filter(o, lambda x, i: x == F.try_element_at(o, i + 3))))
    both = F.struct(ls.alias("ls"), often.alias("often"))
    lines = T.once(both, lambda b: F.filter(b["ls"], lambda x: ~F.array_contains(b["often"], key(x))))
    kept = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", lines.alias("ls"))
    return kept.select("doc_id", F.size("ls").cast("long").alias("kept"), F.md5(F.array_join("ls", "\n")).alias("digest"))


# ---------------------------------------------------------------- dedupe and versions
_CANON = f"h AS (SELECT doc_id, {S.content_hash('text')} AS content_hash FROM documents)"


@query("canonical_docs", f"WITH {_CANON} SELECT doc_id, content_hash, min(doc_id) OVER (PARTITION BY content_hash) AS duplicate_of, doc_id <> min(doc_id) OVER (PARTITION BY content_hash) AS is_duplicate FROM h")
def q_canonical(spark, sf):
    return dedupe.canonical(read(spark, sf, "documents"), "doc_id", "text")


@query("find_duplicates", f"WITH {_CANON}, st AS (SELECT * FROM h WHERE doc_id % 2 = 0), i AS (SELECT * FROM h) SELECT i.doc_id, i.content_hash, CASE WHEN min(st.doc_id) <> i.doc_id THEN min(st.doc_id) WHEN max(st.doc_id) <> i.doc_id THEN max(st.doc_id) END AS duplicate_of, coalesce(min(st.doc_id) <> i.doc_id OR max(st.doc_id) <> i.doc_id, false) AS is_duplicate FROM i LEFT JOIN st USING (content_hash) GROUP BY i.doc_id, i.content_hash")
def q_find_duplicates(spark, sf):
    h = read(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return dedupe.new_documents(h, h.where("doc_id % 2 = 0"), "doc_id")


@query("duplicate_report", f"WITH {_CANON}, {SOURCES}, {CHUNKS}, f AS (SELECT content_hash, min(doc_id) AS first FROM h GROUP BY 1) SELECT h.doc_id, first AS existing, s.title AS existing_title, coalesce(chunk_count, 0) AS chunks FROM h JOIN f USING (content_hash) JOIN s ON s.doc_id = first LEFT JOIN c ON c.source_id = s.source_id WHERE h.doc_id <> first")
def q_duplicate_report(spark, sf):
    dup = dedupe.canonical(read(spark, sf, "documents"), "doc_id", "text").where("is_duplicate").select("doc_id", F.col("duplicate_of").alias("existing"))
    facts = chunk_sizes(sources(spark, sf)).select(F.col("doc_id").alias("existing"), F.col("title").alias("existing_title"), F.coalesce("chunk_count", F.lit(0)).alias("chunks"))
    return dup.join(facts, "existing").select("doc_id", "existing", "existing_title", "chunks")


@query("latest_and_backup", "SELECT user_id, event_id, CASE r WHEN 1 THEN 'live' ELSE 'backup' END AS state FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 2")
def q_latest(spark, sf):
    return dedupe.latest_and_backup(read(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("user_id", "event_id", "state")


@query("dedupe_index", f"WITH l AS (SELECT source, doc_id, i, ls[i] AS x FROM (SELECT source, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents))) SELECT source, sha256({S.squash('lower(x)')}) AS text_hash, min(doc_id * 1000000 + i) AS ordinal, count(*) AS copies FROM l GROUP BY 1, 2")
def q_dedupe_index(spark, sf):
    rows = read(spark, sf, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    return dedupe.dedupe_index(rows.select("source", "x", (F.col("doc_id") * 1000000 + F.col("i") + 1).alias("ordinal")), "source", "x", "ordinal")


@query("upsert_chunks", "WITH st AS (SELECT o_custkey AS src, o_orderkey AS id, 'old' AS v FROM orders WHERE o_orderkey % 2 = 0), i AS (SELECT o_custkey AS src, o_orderkey AS id, 'new' AS v FROM orders WHERE o_orderkey % 2 <> 0), kept AS (SELECT * FROM st WHERE src NOT IN (SELECT src FROM i)) SELECT * FROM kept UNION ALL SELECT * FROM i WHERE id NOT IN (SELECT id FROM kept)")
def q_upsert(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("id"))
    return dedupe.upsert(o.where("id % 2 = 0").withColumn("v", F.lit("old")), o.where("id % 2 <> 0").withColumn("v", F.lit("new")), "src", "id")


# ---------------------------------------------------------------- reports
@query("source_quality_inputs", f"WITH {SOURCES}, {CHUNKS} SELECT s.source_id, len(raw_text) AS raw_chars, len(cleaned_text) AS cleaned_chars, coalesce(chunk_count, 0) AS chunk_count, round(coalesce(avg_chunk_chars, 0), 3) AS avg_chars FROM s LEFT JOIN c ON s.source_id = c.source_id")
def q_inputs(spark, sf):
    rows = chunk_sizes(sources(spark, sf))
    return rows.select("source_id", F.length("raw_text").cast("long").alias("raw_chars"), F.length("cleaned_text").cast("long").alias("cleaned_chars"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.round(F.coalesce("avg_chunk_chars", F.lit(0.0)), 3).alias("avg_chars"))


@query("source_quality", f"WITH {REPORT} SELECT source_id, level AS reliability_level, coalesce(chunk_count, 0) AS chunk_count, round(dup, 3) AS dup, round(noise, 3) AS noise, round(signal, 3) AS signal, round(quality_score, 4) AS quality_score, array_to_string(warnings, ',') AS warnings, review_status, indexing_status FROM r")
def q_source_quality(spark, sf):
    return report(spark, sf).select(
        "source_id", "reliability_level", "chunk_count", F.round("duplicate_line_ratio", 3).alias("dup"), F.round("noise_line_ratio", 3).alias("noise"),
        F.round("vietnamese_signal_ratio", 3).alias("signal"), F.round("quality_score", 4).alias("quality_score"), joined("warnings").alias("warnings"), "review_status", "indexing_status",
    )


_TYPE = r"CASE WHEN regexp_matches(lower(url), '\.(pdf|docx|txt)$') THEN regexp_extract(lower(url), '\.(pdf|docx|txt)$', 1) ELSE 'web' END"


@query("quality_summary", "WITH " + REPORT + f", p AS (SELECT unnest([{{'property': 'reliability_level', 'value': level}}, {{'property': 'source_type', 'value': {_TYPE}}}, {{'property': 'review_status', 'value': review_status}}, {{'property': 'indexing_status', 'value': indexing_status}}]) AS p, coalesce(chunk_count, 0) AS c, quality_score AS q FROM r), "
"i AS (SELECT coalesce(sum(chunk_count) FILTER (doc_id % 10 <> 0), 0) AS there, coalesce(sum(chunk_count) FILTER (indexing_status = 'indexed'), 0) AS allowed FROM r) "
"SELECT p.property AS property, p.value AS value, count(*) AS n, CAST(sum(c) AS BIGINT) AS chunks, round(avg(q), 3) AS mean_score FROM p GROUP BY ALL "
"UNION ALL SELECT 'index', unnest(['vector_chunk_count', 'chunks_indexable', 'real_index_drift']), CAST(unnest([there, allowed, abs(allowed - there)]) AS BIGINT), NULL, NULL FROM i")
def q_summary(spark, sf):
    """The index has all chunks of nine sources of ten, also of those that may not be in it."""
    return quality.quality_summary(report(spark, sf), line_chunks(spark, sf).where("cast(source_id AS long) % 10 <> 0").select("source_id"))


@query("source_progress", f"WITH {REPORT}, n AS (SELECT source_id, len(raw_text) > 0 AS a, len(cleaned_text) > 0 AS b, coalesce(chunk_count, 0) > 0 AS c FROM r) SELECT source_id, array_to_string(list_filter([CASE WHEN a THEN 'raw' END, CASE WHEN b THEN 'clean' END, CASE WHEN c THEN 'chunk' END, CASE WHEN c THEN 'index' END], lambda x: x IS NOT NULL), ',') AS done, 25 * (a::INT + b::INT + 2 * c::INT) AS percent FROM n")
def q_source_progress(spark, sf):
    return quality.source_progress(report(spark, sf))


@query("warning_counts", f"WITH {REPORT} SELECT warning, count(*) AS n FROM (SELECT unnest(warnings) AS warning FROM r) GROUP BY 1")
def q_warning_counts(spark, sf):
    return quality.warning_counts(report(spark, sf))


@query("worst_sources", f"WITH {REPORT} SELECT source_id, round(quality_score, 4) AS quality_score FROM (SELECT *, len(cleaned_text) AS n FROM r ORDER BY round(quality_score, 4), n DESC, source_id LIMIT 20)")
def q_worst(spark, sf):
    rows = report(spark, sf).select("source_id", F.round("quality_score", 4).alias("quality_score"), "cleaned_char_count")
    return rows.orderBy("quality_score", F.desc("cleaned_char_count"), "source_id").limit(20).drop("cleaned_char_count")


@query("source_view", f"WITH {REPORT}, v AS (SELECT source_id, round(quality_score, 4) AS score, len(cleaned_text) AS n, unnest(list_filter(['all', CASE WHEN len(warnings) > 0 THEN 'warnings' END, review_status, level], lambda x: x IS NOT NULL)) AS view FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY score, n DESC, source_id) AS place FROM v) SELECT view, CAST(place AS INT) AS place, source_id FROM k WHERE place <= 18")
def q_view(spark, sf):
    return quality.source_views(report(spark, sf))


@query("source_mix", f"WITH {SOURCES} SELECT replace({_host('url')}, 'www.', '') AS domain, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 3) AS share FROM s GROUP BY 1 ORDER BY n DESC, domain LIMIT 12")
def q_mix(spark, sf):
    counts = sources(spark, sf).groupBy(P.bare_host(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("domain", "n", F.round(F.col("n") / F.col("total"), 3).alias("share")).orderBy(F.desc("n"), "domain").limit(12)


QUERIES["domain_concentration"], SQL["domain_concentration"] = QUERIES.pop("source_mix"), SQL.pop("source_mix")
_COVER_TEXT = "lower(title || ' ' || coalesce(host_group, ''))"


def _covered(topics) -> str:
    rows = ", ".join(f"{{'topic': {S.quoted(k)}, 'terms': {S.hits('tx', terms)}}}" for k, terms in topics.items())
    return f"m AS (SELECT r.*, m.topic AS topic, m.terms AS terms FROM (SELECT *, unnest([{rows}]) AS m FROM (SELECT *, {_COVER_TEXT} AS tx FROM r)) AS r WHERE len(m.terms) > 0)"


def _matched(spark, sf, topics):
    """Title and group of each report row against the topics."""
    rows = report(spark, sf).select("source_id", "doc_id", "reliability_level", "quality_score", F.lower(F.concat_ws(" ", "title", "host_group")).alias("t"))
    return taxonomy.coverage(rows, F.col("t"), topics)


def _coverage_sql(topics) -> str:
    return f"""WITH {REPORT}, {_covered(topics)} SELECT k.topic AS topic, count(m.topic) AS n, count(*) FILTER (m.level = 'official') AS official,
      CASE WHEN count(m.topic) > 0 THEN 'covered' ELSE 'gap' END AS status FROM (SELECT unnest({S.listed(topics)}) AS topic) k LEFT JOIN m ON k.topic = m.topic GROUP BY 1"""


@query("topic_coverage", _coverage_sql(config.TOPICS))
def q_topics(spark, sf):
    return taxonomy.coverage_report(_matched(spark, sf, config.TOPICS), config.TOPICS)


@query("region_coverage", _coverage_sql(config.REGIONS))
def q_regions(spark, sf):
    return taxonomy.coverage_report(_matched(spark, sf, config.REGIONS), config.REGIONS)


@query("topic_top_sources", f"WITH {REPORT}, {_covered(config.TOPICS)} SELECT topic, source_id, place, array_to_string(terms[1:5], ',') AS terms FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(quality_score, 6) DESC, doc_id) AS place FROM m) WHERE place <= 4")
def q_topic_top(spark, sf):
    rows = _matched(spark, sf, config.TOPICS).withColumn("quality_score", F.round("quality_score", 6))
    return taxonomy.top_sources(rows).select("topic", "source_id", F.col("place").cast("long").alias("place"), F.array_join("terms", ",").alias("terms"))


def trust(spark: SparkSession, sf: str) -> DataFrame:
    """One row: shares, densities, coverage and the score with its six truncated deductions."""
    t = F.lower(F.concat_ws(" ", "title", "host_group"))
    rows = report(spark, sf).select("reliability_level", "warnings", P.bare_host(F.col("url")).alias("domain"), t.alias("t"))
    high = F.size(F.filter("warnings", lambda w: w.isin(*POLICY.high_risk)))
    covered = {f"{kind}_{n}": F.max(T.contains_any(F.col("t"), terms)) for kind, topics in (("topic", config.TOPICS), ("region", config.REGIONS)) for n, terms in enumerate(topics.values())}
    # one pass: a row for each domain, then one for all
    domains = rows.groupBy("domain").agg(
        F.count("*").alias("n"), F.count_if(F.col("reliability_level") != "internet").alias("reviewed"), F.sum(F.size("warnings")).alias("warnings"),
        F.sum(high).alias("high"), *[c.alias(k) for k, c in covered.items()],
    )
    rate = lambda kind: T.total([F.coalesce(F.max(k), F.lit(False)).cast("double") for k in covered if k.startswith(kind)]) / sum(k.startswith(kind) for k in covered)
    row = domains.agg(
        F.sum("n").alias("sources"), (F.sum("reviewed") / F.sum("n")).alias("reviewed_share"), F.sum("warnings").alias("warning_total"),
        F.sum("high").alias("high_risk_total"), (F.max("n") / F.sum("n")).alias("top_domain_share"), rate("topic").alias("topic_rate"), rate("region").alias("region_rate"),
    )

    def cut(limit: int, value) -> F.Column:
        return F.least(F.lit(limit), F.floor(F.round(value, 9)).cast("int"))

    n = F.col("sources")
    score = 100 - (
        cut(35, (1 - F.col("reviewed_share")) * 35) + cut(20, F.col("warning_total") / n * 6) + cut(20, F.col("high_risk_total") / n * 18)
        + cut(15, (1 - F.col("topic_rate")) * 15) + cut(10, F.greatest(F.lit(0.0), F.col("top_domain_share") - 0.12) * 60) + cut(10, (1 - F.col("region_rate")) * 10)
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    return row.withColumn("trust_score", score).withColumn("band", F.when(score >= 80, "ready").when(score >= 60, "review").otherwise("high_risk"))


def _rate(topics, name: str) -> str:
    conditions = ", ".join(f"CASE WHEN (SELECT count(*) FROM (SELECT {_COVER_TEXT} AS t FROM r) WHERE {S.has_any('t', terms)}) > 0 THEN 1.0 ELSE 0.0 END" for terms in topics.values())
    return f"(SELECT list_avg([{conditions}])) AS {name}"


_TRUST = f"""WITH {REPORT}, f AS (
  SELECT count(*) AS sources, avg(CASE WHEN level <> 'internet' THEN 1.0 ELSE 0.0 END) AS reviewed_share, CAST(sum(len(warnings)) AS BIGINT) AS warning_total,
    CAST(sum(len(list_filter(warnings, lambda w: list_contains({S.listed(POLICY.high_risk)}, w)))) AS BIGINT) AS high_risk_total FROM r
), d AS (SELECT max(n) / sum(n) AS top_domain_share FROM (SELECT replace({_host('url')}, 'www.', '') AS dd, count(*) AS n FROM r GROUP BY 1)),
t AS (SELECT {_rate(config.TOPICS, 'topic_rate')}, {_rate(config.REGIONS, 'region_rate')}),
x AS (SELECT *, greatest(0, least(100, 100 - (least(35, floor(round((1 - reviewed_share) * 35, 9))) + least(20, floor(round(warning_total / sources * 6, 9))) + least(20, floor(round(high_risk_total / sources * 18, 9)))
  + least(15, floor(round((1 - topic_rate) * 15, 9))) + least(10, floor(round(greatest(0, top_domain_share - 0.12) * 60, 9))) + least(10, floor(round((1 - region_rate) * 10, 9)))))) AS trust FROM f, d, t)"""


@query("trust_report", _TRUST + " SELECT sources, round(reviewed_share, 4) AS reviewed_share, warning_total, high_risk_total, round(top_domain_share, 4) AS top_domain_share, round(topic_rate, 4) AS topic_rate, round(region_rate, 4) AS region_rate, CAST(trust AS INT) AS trust_score, CASE WHEN trust >= 80 THEN 'ready' WHEN trust >= 60 THEN 'review' ELSE 'high_risk' END AS band FROM x")
def q_trust(spark, sf):
    rounded = {c: F.round(c, 4) for c in ("reviewed_share", "top_domain_share", "topic_rate", "region_rate")}
    return trust(spark, sf).withColumns(rounded).select("sources", "reviewed_share", "warning_total", "high_risk_total", "top_domain_share", "topic_rate", "region_rate", F.col("trust_score").cast("int").alias("trust_score"), "band")


_RISKS = [
    ("source_bias", "(1 - reviewed_share) > 0.75 OR reviewed_share < 0.25"),
    ("coverage_gap", "topic_rate < 0.85"),
    ("regional_bias", "region_rate < 1"),
    ("data_quality", "high_risk_total > greatest(10, sources * 0.2)"),
    ("source_concentration", "top_domain_share > 0.2"),
    ("feedback_loop", "false"),
    ("data_leakage", "false"),
]


@query("risk_register", _TRUST + " SELECT unnest([" + ", ".join(f"'{k}'" for k, _ in _RISKS) + "]) AS risk, unnest([" + ", ".join(f"CASE WHEN {c} THEN 'high' ELSE 'controlled' END" for _, c in _RISKS) + "]) AS severity FROM x")
def q_risks(spark, sf):
    rows = F.array(*[F.struct(F.lit(k).alias("risk"), F.when(F.expr(c), "high").otherwise("controlled").alias("severity")) for k, c in _RISKS])
    return trust(spark, sf).select(F.explode(rows).alias("r")).select("r.*")


@query("pipeline_funnel", f"WITH {GATE}, n AS (SELECT count(*) AS all_ FROM q), f AS (SELECT 'raw' AS step, count(*) AS done FROM q UNION ALL SELECT 'cleaned', count(*) FILTER (len(cleaned_text) > 0) FROM q UNION ALL SELECT 'chunked', count(*) FILTER (len(cleaned_text) >= 40) FROM q UNION ALL SELECT 'indexed', count(*) FILTER (indexing_status = 'indexed') FROM (SELECT *, {_review('level', 'quality_score')} FROM q)) SELECT step, done, all_ - done AS waiting, CASE WHEN done > 0 THEN 'done' ELSE 'waiting' END AS status, round(done * 100 / greatest(1, all_), 1) AS percent FROM f, n")
def q_funnel(spark, sf):
    n = F.length("cleaned_text")
    one = quality.gate(sources(spark, sf)).agg(
        F.count("*").alias("raw"), F.count_if(n > 0).alias("cleaned"), F.count_if(n >= 40).alias("chunked"), F.count_if(F.col("indexing_status") == "indexed").alias("indexed")
    )
    steps = one.selectExpr("raw AS every", "stack(4, 'raw', raw, 'cleaned', cleaned, 'chunked', chunked, 'indexed', indexed) AS (step, done)")
    status = F.when(F.col("done") > 0, "done").otherwise("waiting")
    return steps.select("step", "done", (F.col("every") - F.col("done")).alias("waiting"), status.alias("status"), F.round(F.col("done") * 100 / F.greatest(F.lit(1), F.col("every")), 1).alias("percent"))


@query("chunk_stats", f"WITH {SOURCES}, {CHUNKS} SELECT source_id, chunk_count, round(avg_chunk_chars, 3) AS avg_chars FROM c")
def q_chunk_stats(spark, sf):
    return chunk_sizes(sources(spark, sf)).where("chunk_count > 0").select("source_id", "chunk_count", F.round("avg_chunk_chars", 3).alias("avg_chars"))


@query("chunk_previews", "SELECT doc_id, CAST(i AS INT) AS ordinal, substr(ls[i], 1, 900) AS preview FROM (SELECT doc_id, ls, unnest(range(1, least(12, len(ls)) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: len(trim(x)) >= 40) AS ls FROM documents))")
def q_previews(spark, sf):
    ls = F.slice(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) >= 40), 1, 12)
    return read(spark, sf, "documents").select("doc_id", F.posexplode(ls).alias("i", "x")).select("doc_id", (F.col("i") + 1).alias("ordinal"), F.substring("x", 1, 900).alias("preview"))


def line_chunks(spark, sf):
    """Lines of 40 characters or more of every source; what its id says was decided on three of four before."""
    kept = F.filter(F.split("raw_text", "\n"), lambda x: F.length(F.trim(x)) >= 40)
    n = F.pmod("doc_id", F.lit(4))
    return sources(spark, sf).select(
        "source_id", "title", "url", "reliability_level",
        F.when(n == 1, "rejected").when(n == 2, "needs_review").alias("review_status"), F.when(n == 0, "indexed").alias("indexing_status"),
        F.posexplode(kept).alias("ordinal", "text"),
    )


_REBUILD = f"""WITH {SOURCES.replace("text AS raw_text, CASE WHEN doc_id % 9 = 0 THEN substr(text, 1, 60) ELSE text END AS cleaned_text", "'' AS raw_text, array_to_string(list_filter(string_split(text, chr(10)), lambda x: len(trim(x)) >= 40), chr(10)) AS cleaned_text, list_filter(string_split(text, chr(10)), lambda x: len(trim(x)) >= 40) AS chunks")}, {GATE[len(SOURCES) + 2 :]},
g AS (SELECT source_id, doc_id, chunks, quality_score, {_review('level', 'quality_score')} FROM q),
d AS (SELECT source_id, chunks, CASE WHEN len(chunks) = 0 THEN 'needs_review' ELSE CASE doc_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'needs_review' ELSE review_status END END AS review_status,
  CASE WHEN len(chunks) = 0 THEN 'held_for_review' ELSE CASE doc_id % 4 WHEN 0 THEN 'indexed' WHEN 1 THEN 'blocked' WHEN 2 THEN 'held_for_review' ELSE indexing_status END END AS indexing_status,
  CASE WHEN len(chunks) > 0 AND doc_id % 4 = 3 THEN round(quality_score, 3) END AS quality_score FROM g)"""


@query("rebuild_gate", f"{_REBUILD} SELECT source_id, review_status, indexing_status, CAST(len(chunks) AS BIGINT) AS chunk_count, quality_score FROM d")
def q_rebuild(spark, sf):
    return quality.rebuild_gate(sources(spark, sf), line_chunks(spark, sf))


@query("rebuild_union", f"{_REBUILD} SELECT source_id, CAST(i - 1 AS INT) AS ordinal, md5(chunks[i]) AS digest, quality_score FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM d WHERE indexing_status = 'indexed')")
def q_union(spark, sf):
    chunks = line_chunks(spark, sf)
    return quality.rebuild_union(chunks, quality.rebuild_gate(sources(spark, sf), chunks)).select("source_id", "ordinal", F.md5("text").alias("digest"), "quality_score")


@query("list_sources", "SELECT source, max(doc_id) AS last_doc, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source")
def q_list(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.max("doc_id").alias("last_doc"), F.max_by("lang", "doc_id").alias("lang"))


@query("reviewer_agreement", f"WITH {GATE}, g AS (SELECT doc_id, {_review('level', 'quality_score')} FROM q) SELECT review_status, quality, count(*) AS n FROM g JOIN labels USING (doc_id) GROUP BY ALL")
def q_agreement(spark, sf):
    g = quality.gate(sources(spark, sf)).select("doc_id", "review_status")
    return g.join(read(spark, sf, "labels"), "doc_id").groupBy("review_status", "quality").agg(F.count("*").alias("n"))


@query("flagship", f"WITH {GATE}, {_CANON}, k AS (SELECT content_hash, min(doc_id) AS doc_id FROM h GROUP BY 1), g AS (SELECT doc_id, {_review('level', 'quality_score')}, quality_score, len(cleaned_text) AS n FROM q) SELECT review_status, indexing_status, count(*) AS sources, CAST(sum(n) AS BIGINT) AS chars, round(avg(quality_score), 4) AS mean_score FROM g JOIN k USING (doc_id) GROUP BY ALL")
def flagship(spark, sf):
    """documents -> hash -> canonical -> gate -> summary: the corpus build in one query; text is never shuffled."""
    g = quality.gate(sources(spark, sf)).select("doc_id", "review_status", "indexing_status", "quality_score", F.length("cleaned_text").alias("n"))
    first = dedupe.canonical(read(spark, sf, "documents"), "doc_id", "text").where("NOT is_duplicate").select("doc_id")
    return g.join(first, "doc_id").groupBy("review_status", "indexing_status").agg(
        F.count("*").alias("sources"), F.sum("n").alias("chars"), F.round(F.avg("quality_score"), 4).alias("mean_score")
    )

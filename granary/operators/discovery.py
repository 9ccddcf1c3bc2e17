"""Links and search candidates: normalising, relevance, preflight, scores, triage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import contains_any, first_true, hits
from granary.sources import policy as P
from granary.sources.shared import stored

# fixed values: hosts and paths that a crawl leaves alone, and signs of the domain
BLOCKED_HOSTS = (
    "twitter.com", "x.com", "linkedin.com", "pinterest.com", "tiktok.com", "zalo.me", "maps.app.goo.gl", "goo.gl", "online.gov.vn", "dmca.com",
)
SOCIAL_HOSTS = ("facebook.com", "youtube.com", "youtu.be")
BLOCKED_PATHS = (
    "user", "login", "register", "tai-khoan", "lost-password", "my-account", "cart", "gio-hang", "checkout", "shop", "cua-hang", "product",
    "product-category", "danh-muc", "category", "tag", "author", "lien-he", "contact", "gioi-thieu", "about", "chinh-sach", "privacy", "terms",
    "bao-hanh", "van-chuyen", "thanh-toan", "share", "sharer", "pin", "search", "may-pha", "may-xay", "linh-kien", "phu-kien", "barista",
    "secondhand", "da-qua-su-dung", "ban-dong", "cho-thue",
)
SIGNALS = (
    "ca-phe", "caphe", "coffee", "benh", "giong", "gi-sat", "ri-sat", "than-thu", "dom-mat-cua", "cercospora", "anthracnose", "khuyen-nong",
    "nong-nghiep", "ky-thuat", "quy-trinh", "bon-phan", "phan-bon", "sau-benh", "benh-hai", "cay-trong", "cay-ca-phe", "pdf", "tailieu", "tai-lieu",
)
ASSETS = r"\.(jpg|jpeg|png|webp|gif|svg|css|js)$"
ALLOWED_TYPES = (
    "text/html", "application/xhtml", "text/plain", "application/pdf", "application/msword",
    "application/vnd.openxmlformats-officedocument.wordprocessingml",
)


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def normalize_link(url: Column) -> Column:
    """http links without query and fragment, percent-decoded (a plus sign stays), without closing slashes; else empty."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    return F.when(url.rlike("^https?://"), F.regexp_replace(decoded, "/+$", "")).otherwise("")


def is_relevant(url: Column, signals=SIGNALS) -> Column:
    host, path = P.host(url), F.regexp_replace(F.lower(P.url_path(url)), "^/+|/+$", "")
    both = F.concat(host, F.lit("/"), path)
    sharing = contains_any(path, ("sharer", "share.php", "sharearticle", "intent", "dialog", "plugins"))
    facebook = ~path.rlike(r"(^|/)(login|sharer\.php|share\.php|plugins|privacy|help|marketplace|groups_browse)(/|$)") & (path != "")
    social = first_true(
        [
            (sharing, F.lit(False)),
            (F.contains(host, F.lit("facebook.com")), facebook),
            (F.contains(host, F.lit("youtube.com")), path.rlike("^(watch|shorts/|playlist|channel/|c/|@)")),
            (F.contains(host, F.lit("youtu.be")), path != ""),
        ],
        F.lit(False),
    )
    return first_true(
        [
            (contains_any(host, BLOCKED_HOSTS), F.lit(False)),
            (contains_any(host, SOCIAL_HOSTS), social),
            (contains_any(both, BLOCKED_PATHS) | path.rlike(ASSETS), F.lit(False)),
        ],
        contains_any(both, signals),
    )


def preflight(status: Column, content_type: Column, length: Column, most: int = 10 << 20) -> Column:
    """Why a fetch is skipped, null if it isn't; an unanswered or failed HEAD passes."""
    answered = status.isNotNull() & (status < 400)
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(answered & (kind != "") & ~kind.rlike("|".join(map(re.escape, ALLOWED_TYPES))), "content_type").when(
        answered & (length > most), "content_length"
    )


def candidate_score(query_terms: Column, hay: Column, url: Column, penalty: Column, lexicon) -> Column:
    found = F.size(F.filter(query_terms, lambda t: F.contains(hay, t)))
    level = P.infer_reliability(url, F.lit("internet"))
    bonus = F.when(level == "official", 2.2).when(level == "semi_official", 1.1).otherwise(0.0)
    kind = F.when(P.source_type(url).isin("pdf", "docx"), 0.4).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), found * 0.8 + F.size(hits(hay, lexicon)) * 0.35 + bonus + kind - penalty * 2.0), 3)


def unwrap_redirect(url: Column) -> Column:
    """The target of a search engine's redirect link; other links stay."""
    direct = F.try_url_decode(F.regexp_extract(url, r"[?&]uddg=([^&#]*)", 1))
    code = F.regexp_extract(url, r"[?&]u=(?:a1)?([^&#]*)", 1)
    padded = F.rpad(F.translate(code, "-_", "+/"), (F.ceil(F.length(code) / 4) * 4).cast("int"), F.lit("="))
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    bing = (F.contains(P.host(url), F.lit("bing.com"))) & F.contains(url, F.lit("/ck/a"))
    return F.when(F.contains(url, F.lit("duckduckgo.com/l/")), F.coalesce(direct, F.lit(""))).when(
        bing & decoded.rlike("^https?://"), decoded
    ).otherwise(url)


def query_variants(topic: Column, extra: list[str], crop: str, most: int = 8) -> Column:
    """The topic and its variants, the crop added where it is missing, distinct without regard to case."""
    every = [topic] + [F.concat(topic, F.lit(f" {x}")) for x in extra]
    named = F.array(*[F.when(F.contains(F.lower(v), F.lit(crop)), v).otherwise(F.concat(v, F.lit(f" {crop}"))) for v in every])
    low = F.transform(named, F.lower)
    return F.slice(F.filter(named, lambda v, i: F.array_position(low, F.lower(v)) == i + 1), 1, most)


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order over the whole table, with their ``place`` from 1 on; no task sorts more than its range.

    Rows are dealt by range; how many lie in the ranges before says where a range begins, and ranges behind the n-th row
    are left out.
    """
    parts = stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("__part", before.alias("__before")).where(F.col("__before") < n)  # a row for each range
    placed = parts.join(F.broadcast(begins), "__part").withColumn("place", F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return placed.where(F.col("place") <= n).drop("__part", "__before")


def triage(links: DataFrame, seeds: DataFrame, seen: DataFrame, budget: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """url and state of discovered http and https links: candidate_external off the seeds' hosts, else seen, or queued.

    With a budget only the first new links are queued, in ``order`` (columns of ``links``, where a link was met first) and
    then by url; all others are over_budget.
    """
    hosts = seeds.select(P.bare_host(F.col("url")).alias("host")).distinct().withColumn("own", F.lit(True))
    known = seen.select("url").distinct().withColumn("seen", F.lit(True))
    met = F.min(F.struct(*order)) if order else F.lit(0)
    rows = links.where(F.lower("url").rlike("^https?://")).groupBy("url").agg(met.alias("met")).withColumn("host", P.bare_host(F.col("url")))
    state = F.when(F.col("own").isNull(), "candidate_external").when(F.col("seen"), "seen").otherwise("queued")
    rows = rows.join(hosts, "host", "left").join(known, "url", "left").select("url", "met", state.alias("state"))
    if budget is None:
        return rows.select("url", "state")
    rows = stored(rows)
    within = first_n(rows.where("state = 'queued'").select("met", "url"), budget, "met", "url").select("url", F.lit(True).alias("within"))
    late = (F.col("state") == "queued") & F.col("within").isNull()
    return rows.join(within, "url", "left").select("url", F.when(late, "over_budget").otherwise(F.col("state")).alias("state"))


#: What a chunk has where its source says nothing, in the order of the columns.
CHUNK_DEFAULTS = {
    "source_type": ("string", "manual"), "title": ("string", "Tài liệu chưa đặt tên"), "url": ("string", None), "file_name": ("string", None), "page": ("int", None),
    "crawled_at": ("string", None), "reliability_level": ("string", "manual"), "category": ("string", None), "category_label": ("string", None),
    "category_confidence": ("double", None), "category_terms": ("array<string>", []),
}


def with_metadata(chunks: DataFrame, crawled_at: str) -> DataFrame:
    """chunk_id, source_id and the metadata of chunks, with defaults for what is null or not there; ``crawled_at`` is the time of the run.

    ``chunks`` has source_id, ordinal and text. A chunk's id is a hash of its source and ordinal, so a run that is repeated
    makes the same ids; a chunk without a source is its own source.
    """
    own = F.coalesce(F.nullif("source_id", F.lit("")), F.sha1(F.coalesce("text", F.lit("")).cast("binary")))

    def value(name: str, kind: str, default):
        fixed = F.array().cast(kind) if default == [] else F.lit(crawled_at if name == "crawled_at" else default).cast(kind)
        return (F.coalesce(F.col(name).cast(kind), fixed) if name in chunks.columns else fixed).alias(name)

    columns = [value(name, *kind) for name, kind in CHUNK_DEFAULTS.items()]
    return chunks.select(F.sha1(F.concat(own, F.lit("#"), F.col("ordinal").cast("string")).cast("binary")).alias("chunk_id"), own.alias("source_id"), *columns, "ordinal", "text")

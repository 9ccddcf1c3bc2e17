"""Where a text comes from: its type, how reliable its host is, and what warns against it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.config import BAD_ENCODING, COMMERCIAL, POLICY, Policy
from granary.functions.text import contains_any, first_true, flags, total

LEVELS = ("official", "semi_official", "manual")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def bare_host(url: Column) -> Column:
    return F.replace(host(url), F.lit("www."), F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def source_type(url: Column) -> Column:
    """pdf, docx, txt by the suffix of the path, else web."""
    suffix = F.lower(F.regexp_extract(url_path(url), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin("pdf", "docx", "txt"), suffix).otherwise("web")


def host_suffixes(h: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: turns "equals or ends with .domain" into a plain equality."""
    parts = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def in_domains(url: Column, domains) -> Column:
    return F.arrays_overlap(host_suffixes(bare_host(url)), F.array(*[F.lit(d) for d in domains]))


def infer_reliability(url: Column, current: Column, policy: Policy = POLICY) -> Column:
    h = host(url)
    return first_true(
        [
            (current.isin(*LEVELS), current),
            (in_domains(url, policy.official), F.lit("official")),
            (in_domains(url, policy.semi_official), F.lit("semi_official")),
            (contains_any(h, policy.official_tokens), F.lit("official")),
            (contains_any(h, policy.semi_official_tokens), F.lit("semi_official")),
        ],
        F.lit("internet"),
    )


def source_warning_pairs(title: Column, url: Column, text: Column, policy: Policy = POLICY) -> list[tuple[str, Column]]:
    h = host(url)
    head = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit("")), F.substring(text, 1, 1200)))
    trusted = infer_reliability(url, F.lit(None).cast("string"), policy) == "official"
    low = in_domains(url, policy.low_trust) | contains_any(h, policy.low_trust_tokens) | contains_any(head, policy.low_trust_tokens)
    early = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(text, 1, 400))
    return [
        ("low_trust_commercial_domain", low & ~trusted),
        ("commercial_or_vendor_content", ~trusted & head.rlike(COMMERCIAL)),
        ("possible_vietnamese_encoding_error", early.rlike(BAD_ENCODING)),
        ("social_source_too_short_for_rag", contains_any(h, policy.social_tokens) & (F.length(text) < 800)),
    ]


def source_warnings(title: Column, url: Column, text: Column, policy: Policy = POLICY) -> Column:
    return flags(source_warning_pairs(title, url, text, policy))


def source_penalty(warnings: Column, policy: Policy = POLICY) -> Column:
    return F.least(F.lit(0.9), total([F.when(F.array_contains(warnings, w), p).otherwise(0.0) for w, p in policy.penalties.items()]))

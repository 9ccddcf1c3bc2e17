"""The text expressions in DuckDB's SQL, written independently for the checks."""

from __future__ import annotations

from granary import config


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(quoted(x) for x in items) + "]"


def fold(c: str) -> str:
    return f"replace(strip_accents(lower({c})), 'đ', 'd')"


def squash(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def tokens(c: str, shortest: int = 3) -> str:
    return rf"list_filter(regexp_extract_all({fold(c)}, '[\p{{L}}\p{{N}}_]+'), lambda t: len(t) >= {shortest})"


def matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {quoted(pattern)})"


def has_any(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(t)})" for t in terms) + ")"


def hits(c: str, terms) -> str:
    return f"list_filter({listed(terms)}, lambda t: contains({c}, t))"


def lines(c: str) -> str:
    return rf"string_split_regex({c}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def content_hash(c: str) -> str:
    return f"sha256(replace(lower({squash(c)}), 'ß', 'ss'))"


def flags(pairs) -> str:
    inner = ", ".join(f"CASE WHEN {condition} THEN {quoted(name)} END" for name, condition in pairs)
    return f"list_filter([{inner}], lambda f: f IS NOT NULL)"


def phrases(words: str) -> str:
    def of(k: int) -> str:
        return f"list_transform(range(1, greatest(1, len({words}) - {k - 2})), lambda i: array_to_string({words}[i : i + {k - 1}], ' '))"

    return f"list_concat(list_concat({of(4)}, {of(3)}), {of(2)})"


def duplicate_line_ratio(c: str) -> str:
    return f"""(SELECT CASE WHEN count(*) > 0 THEN 1 - count(DISTINCT l) / count(*) ELSE 0 END FROM
      (SELECT {squash('lower(x)')} AS l FROM (SELECT unnest({lines(c)}) AS x) WHERE len(trim(x)) >= 24))"""


def noise_line_ratio(c: str) -> str:
    return f"""(SELECT CASE WHEN count(*) > 0 THEN count(*) FILTER ({matches('x', config.NOISE_LINE)}) / count(*) ELSE 0 END FROM
      (SELECT unnest({lines(f'lower({c})')}) AS x) WHERE len(trim(x)) > 0)"""


def signal_ratio(c: str) -> str:
    return rf"""(SELECT CASE WHEN count(*) > 0 THEN count(*) FILTER (regexp_matches(w, '{config.VIETNAMESE}')) / count(*) ELSE 0 END FROM
      (SELECT unnest(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')) AS w))"""

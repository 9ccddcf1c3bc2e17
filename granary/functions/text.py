"""Column expressions on text: folding, tokens, lines, hashes, ratios. All stay inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary import config

TOKEN = r"[\p{L}\p{N}_]+"
#: Unicode's space separators.
SPACES = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@lru_cache(maxsize=1)
def _latin_table() -> tuple[str, str]:
    """Accented lower-case Latin letters and their base letters, by the rule of Unicode decomposition."""
    pairs = [("đ", "d")]
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if char != base and len(base) == 1 and char == char.lower():
            pairs.append((char, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Lower case without accents."""
    table, base = _latin_table()
    return F.regexp_replace(F.translate(F.lower(c), table, base), r"\p{Mn}", "")


def lower_each(c: Column) -> Column:
    """Lower case letter by letter, whatever stands beside it: a final sigma is one as any other, a dotted I is an i."""
    return F.lower(F.translate(c, "\u0130\u03a3", "i\u03c3"))


def squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column, shortest: int = 3) -> Column:
    """Folded words of at least ``shortest`` characters, in order."""
    return folded_tokens(fold(c), shortest)


def folded_tokens(folded: Column, shortest: int = 3) -> Column:
    """The same of a text that is folded already; the pattern itself leaves shorter words out."""
    pattern = TOKEN if shortest <= 1 else rf"{TOKEN[:-1]}{{{shortest},}}"
    return F.regexp_extract_all(folded, F.lit(pattern), 0)


def phrases(words: Column) -> Column:
    """All runs of four, three and two words."""
    n = F.size(words)

    def of(k: int) -> Column:
        starts = F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))

    return F.concat(of(4), of(3), of(2))


def contains_any(c: Column, terms) -> Column:
    return c.rlike(config.any_of(terms))


def hits(c: Column, terms) -> Column:
    """The terms that occur in a text, in their order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(c, t))


def lines(c: Column) -> Column:
    return F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")


def content_hash(c: Column) -> Column:
    """The same for texts that differ in case and white space only."""
    return F.sha2(F.replace(F.lower(squash(c)), F.lit("ß"), F.lit("ss")), 256)


def clean_noise(c: Column) -> Column:
    c = F.regexp_replace(c, "[﻿ ]", " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_\s.,;:!?%()/\-+]", " ")
    return F.regexp_replace(c, r"[ \t]+", " ")


def duplicate_line_ratio(c: Column) -> Column:
    """Share of lines of 24 characters or more that repeat an earlier one."""
    long = F.transform(F.filter(lines(F.lower(c)), lambda x: F.length(F.trim(x)) >= 24), squash)
    return once(long, lambda x: F.when(F.size(x) > 0, 1 - F.size(F.array_distinct(x)) / F.size(x)).otherwise(0.0))


def noise_line_ratio(c: Column, pattern: str = config.NOISE_LINE) -> Column:
    kept = F.filter(lines(F.lower(c)), lambda x: F.length(F.trim(x)) > 0)
    return once(kept, lambda k: F.when(F.size(k) > 0, F.size(F.filter(k, lambda x: x.rlike(pattern))) / F.size(k)).otherwise(0.0))


def signal_ratio(c: Column, letters: str = config.VIETNAMESE) -> Column:
    """Share of words that hold one of the letters, a class of characters."""
    own = letters[1:-1]
    one = F.translate(F.lower(c), own, own[0] * len(own))
    holding = rf"{own[0]}{TOKEN[:-1]}*+"  # from the first such letter to the end of the word
    counts = F.struct(F.regexp_count(one, F.lit(holding)).alias("holding"), F.regexp_count(one, F.lit(TOKEN)).alias("all"))
    return once(counts, lambda n: F.when(n["all"] > 0, n["holding"] / n["all"]).otherwise(0.0))


def flags(pairs) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in pairs]))


def first_true(pairs, default) -> Column:
    """The value of the first condition that holds."""
    return F.coalesce(*[F.when(condition, value) for condition, value in pairs], default)


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]

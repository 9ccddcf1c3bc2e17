"""License scans: Aho-Corasick finds notices and identifier tags, a shunting-yard parser evaluates expressions.

One automaton walks the words of a text, joined by single spaces, and reports every
notice phrase whose words stand consecutively. Where the words of an identifier
tag occur, the rest of that line of the original text is read as a licence expression
of identifiers, ``and``, ``or``, ``with`` and parentheses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from granary.llm.common import ascii_lower_words, id_and_text, map_rows

#: Phrases and labels that every scan reports (fixed values).
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices, as words after lower-casing.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG_WORDS = ("spdx license identifier", "license expression")
_TAG = re.compile(r"(?:spdx-license-identifier|license-expression)\s*[:=][ \t]*([^\r\n]*)")

#: How much a licence lets a user of the text do, by the start of its identifier; the longest start counts.
PERMISSIVENESS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "cc0": 1.0, "unlicense": 1.0, "public-domain": 1.0,
    "zlib": 1.0, "cc-by": 0.9, "cc-by-sa": 0.5, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2,
    "cc-by-nd": 0.2, "cc-by-nc": 0.1, "proprietary": 0.0,
}
UNKNOWN = 0.5
#: An exception (``with``) takes back part of what the licence asks for.
EXCEPTION = 0.2

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")


def to_postfix(expression: str) -> list[str] | None:
    """Shunting yard: a lower-case licence expression in postfix order, None if it isn't well formed."""
    output: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        if token == "(":
            if not operand_next:
                return None
            waiting.append(token)
        elif token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                output.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif token in _PRECEDENCE:
            if operand_next:
                return None
            while waiting and _PRECEDENCE.get(waiting[-1], 0) >= _PRECEDENCE[token]:
                output.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        else:
            if not operand_next:
                break  # prose after the expression
            output.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return output + waiting[::-1]


def permissiveness(licence: str) -> float:
    starts = [k for k in PERMISSIVENESS if licence == k or licence.startswith((f"{k}-", f"{k}.", f"{k}+"))]
    return PERMISSIVENESS[max(starts, key=len)] if starts else UNKNOWN


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """Permissiveness of an expression and the licences in it: ``or`` lets one choose, ``and`` binds to both."""
    stack: list[float] = []
    licences: set[str] = set()
    pending: list[str] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            pending.append(token)
            stack.append(permissiveness(token))
            licences.add(token)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            licences.discard(pending[-1])
            stack.append(min(1.0, left + EXCEPTION) if left < 1 else left)
        else:
            stack.append(max(left, right) if token == "or" else min(left, right))
    return stack.pop(), licences


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**NOTICE_PHRASES, **BASE_PHRASES}.items():
        found.add_word(f" {phrase} ", (phrase.count(" ") + 2, label, phrase in BASE_PHRASES))
    for words in TAG_WORDS:
        found.add_word(f" {words} ", (0, "", False))
    found.make_automaton()
    return found


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = ascii_lower_words(text)
    joined = b"".join((b" ", b" ".join(words), b" ")).decode("utf-8", "surrogatepass")
    base: set[str] = set()
    labels: set[str] = set()
    starts: list[int] = []
    tagged = False
    spaces = before = 0  # spaces up to the last place looked at
    for end, (borders, label, is_base) in _automaton().iter(joined):
        if not borders:
            tagged = True
            continue
        labels.add(label)
        if is_base:
            base.add(label)
            spaces, before = spaces + joined.count(" ", before, end + 1), end + 1
            starts.append(spaces - borders)
    scores = [permissiveness(label) for label in labels]
    if tagged:
        for expression in _TAG.findall(text.lower()):
            if postfix := to_postfix(expression):
                score, licences = evaluate(postfix)
                scores.append(score)
                labels |= licences
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        min(scores, default=0.0),
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """Licence notices and expressions of every whole text.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word
    (their smallest and largest start, null without any), base_labels and labels (sorted,
    comma-joined, empty without any) and score: the permissiveness of everything found
    together, 0 where nothing was found. A null or empty text has no words. Rows are independent.
    """

    def rows(batch: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in batch:
            yield doc_id, *scan(text)

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double"
    )
    return map_rows(id_and_text(docs), rows, schema)

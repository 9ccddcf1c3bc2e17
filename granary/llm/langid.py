"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text is built. A text is parsed against
each of them: from the current place take the longest match that occurs in the labelled
text, then start anew behind it. Few phrases mean that the text is made of long parts
of that language. The count of phrases, normalised to bits per letter by the size of the
labelled text, is an upper estimate of the cross entropy; the smallest one wins.

Labelled text is a bounded sample; everything else covers all documents whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import has_letter, held, id_and_text, tidied

#: Bounds of the labelled sample: documents, and characters, for each language.
SAMPLE_DOCUMENTS = 60
SAMPLE_LETTERS = 16_000
#: The most frequent letters have columns in the table of moves; moves by the others are searched in a sorted list.
ALPHABET = 47
#: Long texts advance in stretches of this many letters, many at once.
STRETCH = 2048
UNDETERMINED = "und"

_BREAK = 1 << 30


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Does crc32 of the id, as text, leave this remainder? A null id counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus)) == remainder


def labelled_sample(docs: DataFrame, usable: Column, per_language: int = SAMPLE_DOCUMENTS, letters: int = SAMPLE_LETTERS) -> dict[str, str]:
    """language -> whole texts of its first documents in hash order, up to so many documents and characters together.

    Texts longer than ``letters`` come last: one is taken only if the language has no other, and then
    the sample ends within it. Ranking sees ids, labels and lengths only and keeps the first few of each
    partition before they are shuffled; only the chosen documents' texts reach the driver, one for an id.
    """
    named = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    long_ = F.length("text") > letters
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id")
    chosen = (
        named.select("doc_id", "lang", long_.alias("long"))
        .distinct()
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= per_language)
        .collect()
    )
    ids = sorted({row.doc_id for row in chosen})
    places = {(row.lang, row.doc_id, row.long): row.place for row in chosen}
    picked = named.where(F.col("doc_id").isin(ids)).groupBy("lang", "doc_id", long_.alias("long")).agg(F.min("text").alias("text")) if ids else None
    found = [(row.lang, places[key], row.text) for row in (picked.collect() if ids else []) if (key := (row.lang, row.doc_id, row.long)) in places]
    texts: dict[str, str] = {}
    for lang, _, text in sorted(found):
        before = texts.get(lang, "")
        if not before:
            texts[lang] = text[:letters]
        elif len(before) + 1 + len(text) <= letters:
            texts[lang] = f"{before} {text}"
    return texts


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-case text, with one space for everything that isn't a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(_is_letter()[points], points, 32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep]


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    import unicodedata

    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


class SuffixAutomaton:
    """Accepts exactly the substrings of a sequence of small numbers."""

    def __init__(self, sequence: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for symbol in sequence:
            state = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = state
                at = link[at]
            if at >= 0:
                target = self.next[at][symbol]
                if length[target] == length[at] + 1:
                    link[state] = target
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[target]))
                    link.append(link[target])
                    length.append(length[at] + 1)
                    while at >= 0 and self.next[at].get(symbol) == target:
                        self.next[at][symbol] = copy
                        at = link[at]
                    link[target] = link[state] = copy
            last = state


class CrossParser:
    """Counts of longest-match phrases of texts against every language's labelled text."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        parts = {lang: _letters(samples[lang]) for lang in self.languages}
        common = Counter(x for part in parts.values() for x in part.tolist())
        self.size = len(common) + 1
        self.code = np.zeros(0x110000, np.min_scalar_type(self.size))
        for n, (point, _) in enumerate(sorted(common.items(), key=lambda x: (-x[1], x[0]))):
            self.code[point] = n + 1
        width = ALPHABET + 1
        self.roots, self.bits, tables, base = [], [], [], 0
        keys, values, self.rare_first = [], [], np.zeros((len(self.languages), max(0, self.size - width)), np.int32)
        for k, lang in enumerate(self.languages):
            coded = self.code[parts[lang]].tolist()
            automaton = SuffixAutomaton(coded)
            dead = len(automaton.next)  # behind an unknown letter, and before the first one: any letter opens a phrase
            table = np.full((dead + 1, width), -1, np.int32)
            for state, moves in enumerate(automaton.next):
                for symbol, target in moves.items():
                    if symbol < width:
                        table[state, symbol] = target
                    else:
                        keys.append((base + state) * self.size + symbol)
                        values.append(base + target)
            # where nothing goes on, a phrase ends and the letter opens the next one
            table[:, 0] = -1
            first = np.where(table[0] < 0, dead, table[0]) + base
            tables.append(np.where(table < 0, first | _BREAK, table + base).astype(np.int32))
            opening = [automaton.next[0].get(symbol, dead) for symbol in range(width, self.size)]
            self.rare_first[k] = (np.array(opening, np.int64) + base) | _BREAK
            self.roots.append(base + dead)
            self.bits.append(math.log2(max(2, len(coded))))
            base += dead + 1
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]

    def _rare_moves(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Moves from states (languages x places) by letters that have no column."""
        key = (state & (_BREAK - 1)).astype(np.int64) * self.size + symbols
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.rare_first[:, symbols.astype(np.int64) - ALPHABET - 1])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(letters of each text, phrases of each text and language).

        All stretches of a text advance at once, as if each opened with a phrase of its own. Those
        that a phrase from the stretch before goes on into are parsed again from there, until
        every stretch has begun as the one before it has ended.
        """
        coded = [self.code[_letters(text)] for text in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        letters = np.concatenate([*coded, np.zeros(1, self.code.dtype)])
        counts = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.repeat(np.cumsum(sizes) - sizes, counts) + nth * STRETCH
        length = np.minimum(STRETCH, np.repeat(sizes, counts) - nth * STRETCH)
        roots = np.array(self.roots, np.int32)[:, None]
        enter = np.repeat(roots, len(owner), 1)
        leave, total = np.zeros_like(enter), np.zeros_like(enter)
        todo = np.arange(len(owner))
        while len(todo):
            leave[:, todo], total[:, todo] = self._parse(letters, start[todo], length[todo], enter[:, todo])
            true = np.where(nth > 0, np.roll(leave, 1, 1), roots)
            todo = np.flatnonzero((true != enter).any(axis=0))
            enter = true
        out = np.zeros((len(texts), len(self.roots)), np.int64)
        for k in range(len(self.roots)):
            out[:, k] = np.bincount(owner, weights=total[k], minlength=len(texts))
        return sizes, out

    def _parse(self, letters: np.ndarray, start: np.ndarray, length: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state behind, phrases opened) of stretches, by language, from the states before them."""
        order = np.argsort(-length, kind="stable")
        start, length, state = start[order], length[order], enter[:, order]
        total = np.zeros_like(state)
        width, any_rare = ALPHABET + 1, bool(len(self.roots)) and int(letters.max()) > ALPHABET
        active = np.searchsorted(-length, -np.arange(int(length[0])), "left")
        for step, n in enumerate(active.tolist()):
            symbols = letters[start[:n] + step]
            rare = np.flatnonzero(symbols >= width) if any_rare else ()
            moved = self.table[(state[:, :n] & (_BREAK - 1)) * width + (np.minimum(symbols, ALPHABET) if len(rare) else symbols)]
            if len(rare):
                moved[:, rare] = self._rare_moves(state[:, rare], symbols[rare])
            total[:, :n] += moved >> 30
            state[:, :n] = moved
        back = np.argsort(order)
        return (state & (_BREAK - 1))[:, back], total[:, back]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        sizes, phrases = self.phrases(texts)
        bits = phrases * np.array(self.bits) / np.maximum(sizes, 1)[:, None]
        out = []
        for text, row in zip(texts, bits, strict=True):
            if not len(row) or not has_letter(text):
                out.append((UNDETERMINED, 0.0))
                continue
            best = int(row.argmin())
            rest = np.delete(row, best)
            out.append((self.languages[best], float(rest.min() / (rest.min() + row[best])) if len(rest) else 1.0))
        return out


def _parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return held(("languages", samples), lambda: CrossParser(dict(samples)))


def predict_column(df: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred and score for a frame of doc_id and text."""
    given = tuple(sorted(samples.items()))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _parser(given).predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return df.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Predict the language of every whole text.

    Learns from text and non-null lang of documents that aren't held out (crc32 of the id, as
    text, modulo ``modulus`` is ``remainder``). Returns doc_id, held_out, lang_pred (a learned
    label; ``und`` for a null text, one without letters, or if nothing could be learned)
    and score: 0.5 where the two best languages tie, towards 1 the clearer the lead, 0 for
    ``und``. Equal entropies go to the smaller label. Rows are independent.
    """
    rest = held_out(F.col("doc_id"), modulus, remainder)
    samples = labelled_sample(docs.select("doc_id", "text", "lang"), ~rest)
    return predict_column(id_and_text(docs), samples).select("doc_id", rest.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """The rows of ``docs``, with all their columns, but null texts and texts without letters.

    Where nothing could be learned, or a learned label is ``und`` itself, texts with letters stay.
    The prediction travels with the row, so the texts are not shuffled.
    """
    samples = labelled_sample(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id"), modulus, remainder))
    given, names = tuple(sorted(samples.items())), docs.columns
    place = names.index("text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column(place).to_pylist()]
            found = _parser(given).predict(texts)
            kept = [lang != UNDETERMINED or has_letter(text) for text, (lang, _) in zip(texts, found, strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

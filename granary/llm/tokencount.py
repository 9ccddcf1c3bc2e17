"""Token counts by a linear longest-match automaton.

Greedy longest-match tokenisation of a word takes, again and again, the longest
vocabulary entry that starts the rest of the word. Restarting the search costs time
proportional to word times token length. Here a trie of the vocabulary gets a failure
link per node: when no child continues a node, the greedy tokens that its string
starts with are popped and the automaton moves to the node of what is left. Links are
followed without reading a byte again, so a word is counted in time proportional
to its length. Only the *number* of popped tokens is stored, never the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm.bpe import Cutter, read_ranks
from granary.llm.common import held, id_and_text, tidied, utf8

ROOT = 0
NONE = -1


class LongestMatchCounter:
    """Trie with failure links over byte strings; every single byte must be an entry."""

    def __init__(self, entries):
        self.children: list[dict[int, int]] = [{}]
        depth, ends = [0], [False]
        for entry in entries:
            node = ROOT
            for byte in entry:
                child = self.children[node].get(byte)
                if child is None:
                    child = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    depth.append(depth[node] + 1)
                    ends.append(False)
                node = child
            ends[node] = True
        missing = [b for b in range(256) if not (b in self.children[ROOT] and ends[self.children[ROOT][b]])]
        if missing:
            raise ValueError(f"{len(missing)} single bytes are not in the vocabulary")
        self.link = [NONE] * len(depth)
        self.popped = [0] * len(depth)
        queue = [ROOT]
        for parent in queue:
            for byte, node in self.children[parent].items():
                queue.append(node)
                if ends[node]:
                    # the whole string is an entry: pop it, nothing is left
                    self.link[node], self.popped[node] = ROOT, 1
                    continue
                # pop what the parent would pop, then try to go on with this byte
                at, count = self.link[parent], self.popped[parent]
                while at != NONE and byte not in self.children[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at != NONE:
                    self.link[node], self.popped[node] = self.children[at][byte], count

    def count(self, word: bytes) -> int:
        """Greedy longest-match tokens of one word."""
        children, link, popped = self.children, self.link, self.popped
        node = total = 0
        for byte in word:
            while (child := children[node].get(byte)) is None:
                total += popped[node]
                node = link[node]
            node = child
        while node != ROOT:
            total += popped[node]
            node = link[node]
        return total


class TextCounter:
    """Tokens and pieces of whole texts, cut by a split pattern."""

    def __init__(self, entries, pattern: str):
        count = LongestMatchCounter(entries).count
        # tokens in the upper bits, pieces in the lower ones: one sum adds up both
        self._sums = Cutter(pattern, lambda pieces: [count(utf8(piece)) << 32 | 1 for piece in pieces], sum)

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, pieces) of each text."""
        return [(total >> 32, total & 0xFFFFFFFF) for total in self._sums(texts)]


def text_counter(path: str, pattern: str) -> TextCounter:
    return held(("counts", path, pattern), lambda: TextCounter(read_ranks(path), pattern))


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Greedy longest-match token counts of every whole text.

    Returns doc_id, n_bytes (UTF-8), n_pieces (matches of the split pattern) and
    n_tokens. A null or empty text has zero of each. Rows are independent.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = text_counter(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens, pieces = zip(*counter.count(texts), strict=True) if texts else ((), ())
            columns = [[len(utf8(text)) for text in texts], pieces, tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_bytes", "n_pieces", "n_tokens"]
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, n_tokens long")

"""Links between two tokenizers' tokens against brute force."""

import hashlib
import json
import random
from collections import Counter

import pytest
import sentencepiece
import tokenizers

from granary.llm import alignment, queries

A = tokenizers.Tokenizer.from_file(queries.BYTE_LEVEL)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
EDGES = [
    "", None, " ", "  two  spaces ", "\n\n tabs\tand\r\nlines \x0b", "<|endoftext|> <s> </s> <unk> <0x41>", "the mark ▁ itself", "日本語 text é ñ ü", "🙂 emoji 👩‍👩‍👧 families",
    "a" * 3000, " " * 500, "x y " * 4000, "\x00\x01 control", "é decomposed", "don't can't I'll 12345 3.14 --- !!!", " no break　spaces", "ends with space ",
]


def token_bytes():
    vocabulary = json.load(open(queries.BYTE_LEVEL))["model"]["vocab"]
    decoder = tokenizers.decoders.ByteLevel()
    a = {i: None for i in vocabulary.values()}

    def of_a(i):  # the library's own decoder is lossy for parts of characters: go by letters there
        if a[i] is None:
            letters = alignment.byte_letters()
            a[i] = bytes(letters[c] for c in A.id_to_token(i))
            if b"\xef" not in a[i] and "�" not in decoder.decode([A.id_to_token(i)]):
                assert decoder.decode([A.id_to_token(i)]).encode() == a[i]
        return a[i]

    def of_b(i):
        piece = B.id_to_piece(i)
        return bytes.fromhex(piece[3:5]) if B.is_byte(i) else piece.replace("▁", " ").encode()

    return of_a, of_b


def brute(texts):
    of_a, of_b = token_bytes()
    found, counts = [], Counter()
    for text in texts:
        a = A.encode(" " + text, add_special_tokens=False).ids if text else []
        b = B.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(map(of_a, a)) != want or b"".join(map(of_b, b)) != want:
            found.append(None)
            continue
        ends = []
        for ids, of in ((a, of_a), (b, of_b)):
            at, places = 0, []
            for i in ids:
                at += len(of(i))
                places.append(at)
            ends.append(places)
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            m, n = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            links.append((a[m - 1], b[n - 1]))
            i, j = m, n
        counts.update(links)
        found.append((len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (0, 0, 0, 0, 0, 0, "")
        if x is None
        else (x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest())
        for x in found
    ]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    some = ["".join(chr(r.choice((32, 32, 10, 97, 98, 0xE9, 0x4E00, 0x1F600, r.randrange(33, 0x250)))) for _ in range(r.randint(1, 80))) for _ in range(120)]
    words = ["the", "of", "and", "tion", "Haus", "señor", "l'eau", "x1", "(see", "etc.)"]
    return [*EDGES, *some, *[" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(60)]]


def test_by_brute_force(spark, texts):
    rows = [*enumerate(texts), (3, texts[3]), (None, "no id of its own")]
    docs = spark.createDataFrame([(*x, 0, "x") for x in rows], "doc_id long, text string, n_a int, links string").repartition(3)
    got = {}
    for row in alignment.align_documents(docs, queries.BYTE_LEVEL, queries.PIECES, queries.PATTERN).collect():
        got.setdefault(row.doc_id, []).append(tuple(row)[1:])
    want = brute([t for _, t in rows])
    assert sum(x[0] > 0 for x in want) > 150 and sum(x[0] == 0 for x in want) >= 3
    for (i, text), values in zip(rows, want, strict=True):
        assert set(got[i]) == {values}, text
    assert len(got[3]) == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(docs, queries.BYTE_LEVEL, queries.PIECES, queries.PATTERN).collect() == []


def test_windows_are_remembered_by_their_ids(monkeypatch):
    tool = alignment.Aligner(queries.BYTE_LEVEL, queries.PIECES, queries.PATTERN)
    asked, align = [], tool._align
    monkeypatch.setattr(tool, "_align", lambda windows: asked.append(len(windows)) or align(windows))
    texts = ["the same words, the same words", "the same words"]
    first = tool.align(texts)
    assert tool.align(texts) == first and 0 < asked[0] < 8 and asked[1:] == []
    monkeypatch.setattr(alignment, "KNOWN_WINDOWS", 2)
    assert tool.align([*texts, "others"])[:2] == first == tool.align(texts)  # forgets, and works them out again


def test_ids_are_those_of_the_library():
    tool = alignment.Aligner(queries.BYTE_LEVEL, queries.PIECES, queries.PATTERN)
    points = [chr(c) for c in [*range(0x3100), *range(0xA000, 0xA100), *range(0xF900, 0x10100), *range(0x1F300, 0x1F700)]]
    texts = [f"a{c}b {c}{c} 1{c}2 .{c} {c}\n" for c in points]
    got = [tool._a.encode_to_numpy(f" {t}", allowed_special=set(), disallowed_special=()).tolist() for t in texts]
    assert got == [x.ids for x in A.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]


def test_pairs_are_bounded_by_the_vocabularies(spark, texts):
    tool = alignment.Aligner(queries.BYTE_LEVEL, queries.PIECES, queries.PATTERN)
    bound = alignment.pair_bound(tool.tokens_a, tool.tokens_b)
    assert bound < 400_000 and len(tool.tokens_a) * tool.factor < 1 << 32
    for text in texts:
        for link in [int.from_bytes(x, "little") for x in map(bytes, zip(*[iter(tool.align([text or ""])[0][3])] * 4))]:
            a, b = tool.tokens_a[link // tool.factor], tool.tokens_b[link % tool.factor]
            assert a.endswith(b) or b.endswith(a)


def test_units_are_encoded_once_and_give_what_whole_texts_give(texts, monkeypatch):
    r, odd = random.Random(9), " \n\t 　\x1c\x85\x00ab'1.▁一\U0001f600"
    some = [*(t or "" for t in texts), *("".join(r.choice(odd) for _ in range(r.randint(0, 40))) for _ in range(300)), "x" * 3000, " a ", "a  b \n c", "▁ a"]
    tool = alignment.Aligner(queries.BYTE_LEVEL, queries.PIECES, queries.PATTERN)
    whole = alignment.Aligner(queries.BYTE_LEVEL, queries.PIECES, queries.PATTERN)._align_whole(some)
    assert tool.align(some) == whole == tool.align(some)
    assert sum(x[0] == 0 for x in whole) > 20 and sum(x[0] > 0 for x in whole) > 200
    asked, encode = [], tool.encode
    monkeypatch.setattr(tool, "encode", lambda parts: asked.extend(parts) or encode(parts))
    tool.align(["a few new words: qqq zzz"])
    asked.clear()
    assert tool.align(["new words: a few zzz qqq", "a few a few words:"])[1][0] > 4
    assert asked == []

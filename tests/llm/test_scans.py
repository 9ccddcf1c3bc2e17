"""Licences, media, languages and quality: rules and held-out accuracy."""

import hashlib
import io
import math
import random
import re
import struct
import time
import zipfile
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from granary.llm import licenses, media
from granary.llm.common import ascii_lower_words
from granary.llm.langid import CrossParser, SuffixAutomaton, _letters, identify, labelled_sample
from granary.llm.quality import score_documents, train

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_words_follow_the_pattern():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("aB1é\x85  -_\n\x00~`日.") for _ in range(30))
        lower = "".join(c.lower() if c.isascii() else c for c in text)
        assert [w.decode() for w in ascii_lower_words(text)] == WORD.findall(lower)


def _base(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text))
    places = [i for i in range(len(words)) for p in licenses.BASE_PHRASES if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min(places, default=None), max(places, default=None)


@pytest.mark.parametrize(
    "text",
    ["", "MIT License", "the mit license mit license CC-BY-NC 4.0, Apache License!", "gnu general public license gnu general public", "mit licenses", "cc by cc by"],
)
def test_license_places_by_brute_force(text):
    assert licenses.scan(text)[:4] == _base(text)


def test_license_scan_by_brute_force():
    r = random.Random(8)
    phrases = {**licenses.NOTICE_PHRASES, **licenses.BASE_PHRASES}
    words = sorted({w for p in phrases for w in p.split()}) + ["x"]
    for _ in range(400):
        picked = [r.choice([*phrases, *words]) for _ in range(r.randint(0, 12))]
        text = "".join(w.upper() + r.choice((" ", "-", "\n")) for p in picked for w in p.split())
        found = WORD.findall(text.lower())
        joined = f" {' '.join(found)} "
        labels = {label for phrase, label in phrases.items() if f" {phrase} " in joined}
        base = {label for phrase, label in licenses.BASE_PHRASES.items() if f" {phrase} " in joined}
        score = min((licenses.PERMISSIVENESS[x] for x in labels), default=0.0)
        assert licenses.scan(text) == (*_base(text), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def test_many_hits_take_linear_time():
    began = time.process_time()
    assert licenses.scan("mit license cc by " * 60_000)[1] == 120_000
    assert media.carve(b"%PDF-1 PK\x03\x04 GIF89a1234567,12345678 \xff\xd8\xff\xe0\x00\x02\xff\xda\x00\x02" * 40_000) == []
    pages = b"OggS\0\0" + bytes(20) + b"\x01\x00"  # pages without a last one
    assert media.carve(pages * 40_000) == []
    inside = b"\xff\xe0\x00\x08\xff\xd8\xff\xe0\x00\x02"  # segments that hold the mark of a beginning
    assert media.carve(b"\xff\xd8" + inside * 40_000) == []
    whole = pages[:5] + b"\x04" + pages[6:]
    assert media.carve(b"x" + pages * 3 + whole + b"y" + whole) == [(1, 4 * len(pages), "audio/ogg"), (2 + 4 * len(pages), len(whole), "audio/ogg")]
    assert time.process_time() - began < 8


def test_expressions():
    assert licenses.to_postfix("mit or (apache-2.0 and gpl-3.0 with classpath-exception)") == ["mit", "apache-2.0", "gpl-3.0", "classpath-exception", "with", "and", "or"]
    assert licenses.to_postfix("mit or") is None and licenses.to_postfix("(mit") is None and licenses.to_postfix("") is None
    score, ids = licenses.evaluate(licenses.to_postfix("gpl-3.0 or mit"))
    assert (score, ids) == (1.0, {"gpl-3.0", "mit"})
    assert licenses.evaluate(licenses.to_postfix("gpl-3.0 and mit"))[0] == 0.3
    assert licenses.evaluate(licenses.to_postfix("gpl-2.0 with classpath-exception"))[0] == pytest.approx(0.5)
    n, base, *_, labels, score = licenses.scan("// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\ncode")
    assert labels == "gpl-2.0-only,mit" and score == 1.0 and base == 0


def _zip() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


WAV = b"RIFF" + (36 + 4).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + bytes(16) + b"data" + (4).to_bytes(4, "little") + b"abcd"
GIF = b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
SAMPLES = {
    "image/png": media.to_png(b"\x07" * 576, 24), "image/gif": GIF, "audio/wav": WAV, "application/zip": _zip(), "application/gzip": zlib.compress(b"x" * 50, wbits=31),
    "application/pdf": b"%PDF-1.4 startxref 0 %%EOF", "image/jpeg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02xyz\xff\xd9",
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_sniff_correct_and_carve(kind):
    data = SAMPLES[kind]
    assert media.sniff(data, "text/plain") == (kind, True, [])
    assert media.sniff(data, kind)[1] is False
    assert media.carve(b"junk " + data + b" tail") == [(5, len(data), kind)]


def test_nested_archives_and_saved_pdfs():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("inner.zip", _zip())
        z.comment = b"with a comment"
    data = out.getvalue()
    assert media.carve(data + b" tail") == [(0, len(data), "application/zip")]
    saved = b"%PDF-1.4 one startxref 0 %%EOF two startxref 9 %%EOF"
    assert media.carve(saved + b" \n " + saved) == [(0, len(saved), "application/pdf"), (len(saved) + 3, len(saved), "application/pdf")]
    big = zlib.compress(random.Random(1).randbytes(300_000), wbits=31)
    assert media.carve(b"z" + big + b"rest") == [(1, len(big), "application/gzip")]


def test_stored_texts_by_brute_force(spark):
    texts = ["", None, "abc", "é" * 400, "x" * 576, "y" * 577, "日本" * 5000, "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in media.store_texts(docs).collect():
        data = (texts[row.doc_id] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        lines = b"".join(b"\0" + payload[i : i + 576] for i in range(0, len(payload), 576))
        header = struct.pack(">IIBBBBB", 576, len(payload) // 576, 8, 0, 0, 0, 0)
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")
        digest = lambda x: hashlib.sha256(x).hexdigest()
        assert tuple(row)[1:7] == (len(data), len(payload), digest(payload), zlib.crc32(payload[-32:]), len(png), digest(png))
        assert row.feature.startswith(f"image/png 576x{len(payload) // 576} embedded=0[] mean={sum(payload) / len(payload):.4f} entropy=")


def test_broken_media_are_not_media():
    assert media.carve(SAMPLES["image/png"][:-3]) == [] and media.carve(b"BM just text") == [] and media.sniff(None, "a/b") == ("a/b", False, [])


def test_payload_round_trip():
    for text in ("", "abc", "é" * 400, "x" * 576, "y" * 577):
        payload = media.text_payload(text)
        assert len(payload) % 576 == 0 and len(payload) >= 576 and payload.startswith(text.encode())
        assert media.from_png(media.to_png(payload, 576))[0] == payload


def test_suffix_automaton_and_phrases_by_brute_force():
    r = random.Random(2)
    for _ in range(60):
        sample = "".join(r.choice("abc ") for _ in range(40))
        automaton = SuffixAutomaton([ord(c) for c in sample])
        for _ in range(20):
            probe = "".join(r.choice("abc") for _ in range(r.randint(1, 6)))
            state = 0
            for c in probe:
                state = automaton.next[state].get(ord(c)) if state is not None else None
            assert (state is not None) == (probe in sample)
        parser = CrossParser({"x": sample})
        text = " ".join("".join(r.choice("abcd") for _ in range(4)) for _ in range(10))
        clean, phrases, at = re.sub(" +", " ", sample), 0, 0
        while at < len(text):
            n = 1
            while at + n < len(text) and text[at : at + n + 1] in clean:
                n += 1
            at, phrases = at + n, phrases + 1
        assert int(parser.phrases([text])[1][0, 0]) == phrases


def _scripts(r):
    """Texts of two Latin, one Cyrillic and two Han languages; the last two share their letters, not their words."""
    han = [chr(0x4E00 + 7 * i) for i in range(900)]
    letters = {"la": "abcdefghijklmnopqrstuvwxyz", "lb": "abcdefghijklmnopqrstuvwxyzäöüßéèà", "cy": [chr(c) for c in range(0x430, 0x450)], "ha": han, "hb": han}
    words = {k: ["".join(r.choice(v) for _ in range(r.randint(2, 5))) for _ in range(400)] for k, v in letters.items()}
    return lambda lang, n: (" " if lang[0] != "h" else "").join(r.choice(words[lang]) for _ in range(n)), list(letters)


def test_languages_of_several_scripts():
    r = random.Random(9)
    text, names = _scripts(r)
    parser = CrossParser({lang: text(lang, 4000) for lang in names})
    want = [lang for lang in names for _ in range(40)]
    got = [lang for lang, _ in parser.predict([text(lang, 40) for lang in want])]
    assert sum(x == y for x, y in zip(want, got, strict=True)) / len(want) > 0.98


def test_phrases_of_rare_letters_by_brute_force():
    r = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(120)] + list("abc ")
    samples = {k: "".join(r.choice(letters) for _ in range(1500)) for k in "xyz"}
    texts = ["".join(r.choice([*letters, "я"]) for _ in range(300)) + samples["y"][50:90] for _ in range(5)]
    parser = CrossParser(samples)
    known = {k: "".join(map(chr, _letters(v))) for k, v in samples.items()}
    for text, row in zip(texts, parser.phrases(texts)[1].tolist(), strict=True):
        data = "".join(map(chr, _letters(text)))
        for k, n in zip(sorted(samples), row, strict=True):
            at = count = 0
            while at < len(data):
                size = 1
                while at + size < len(data) and data[at : at + size + 1] in known[k]:
                    size += 1
                at, count = at + size, count + 1
            assert count == n


def _phrases(data, known):
    at = count = 0
    while at < len(data):
        size = 1
        while at + size < len(data) and data[at : at + size + 1] in known:
            size += 1
        at, count = at + size, count + 1
    return count


def test_phrases_of_long_texts_by_brute_force():
    """No phrase ends where a stretch does."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
    samples = {"x": " ".join(word() for _ in range(400)), "y": "a" * 700 + " ab" * 200}
    parser = CrossParser(samples)
    texts = [" ".join(word() for _ in range(2200)), "a" * 10_000, samples["x"] * 6, "ab " * 3400, "short"]
    assert all(len(t) > 10_000 - 1 for t in texts[:-1])
    for text, row in zip(texts, parser.phrases(texts)[1].tolist(), strict=True):
        assert row == [_phrases(re.sub(" +", " ", text), re.sub(" +", " ", samples[k])) for k in "xy"]


def test_sample_holds_whole_texts_once(spark):
    rows = [(1, "ab " * 10, "x")] * 50 + [(2, "c" * 90, "x"), (3, "d" * 30, "x"), (4, "e" * 200, "y"), (5, "f" * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = labelled_sample(docs, F.lit(True), letters=61)
    assert sorted(got["x"].split(" d")[0].split()) == sorted(("ab " * 10).split()) or got["x"].startswith("d")
    assert len(got["x"]) == 61 and got["y"] == "e" * 61


DATA = "/root/testdata/sf0.01"


def test_held_out_languages_and_quality(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    right = identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").selectExpr("avg(cast(lang = lang_pred as double))").first()[0]
    assert right > 0.98
    model = train(docs, labels)
    sizes = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    texts = {row.doc_id: row.text or "" for row in docs.collect()}
    for row in score_documents(docs, labels).where("doc_id % 25 = 0").collect():
        good, bad = (len(c.compress(texts[row.doc_id].encode())) for c in sizes)
        x, size = (bad - good) / (bad + good), min(good, bad) / (len(texts[row.doc_id].encode()) + 16)
        a, b, c, d = model.weights
        want = 1 / (1 + math.exp(-(a + b * 10 * x + c * size + d * size**2)))
        assert row.score == pytest.approx(want, abs=2e-2) and row.predicted == (row.score >= 0.3)
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
    scored = score_documents(docs, labels).where("held_out").join(labels, "doc_id")
    assert scored.selectExpr("avg(cast(quality = predicted as double))").first()[0] > 0.85


def test_equal_entropies_go_to_the_smaller_label():
    text = "the same words in both languages, again and again, with some others " * 8
    parser = CrossParser({"b": text, "a": text, "c": "völlig andere Wörter ganz ohne die übrigen " * 10})
    assert parser.predict([text[5:90], "w", "völlig andere"])[:1] == [("a", 0.5)] and parser.predict(["völlig andere Wörter"])[0][0] == "c"
    assert [lang for lang, _ in parser.predict([text[k : k + 30] for k in range(0, 200, 9)])] == ["a"] * 23

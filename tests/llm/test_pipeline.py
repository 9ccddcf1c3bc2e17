"""The corpus pipeline, stage by stage, against a brute-force version."""

import hashlib
import itertools
import random
import re
import unicodedata

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from granary.llm.bpe import Vocabulary
from granary.llm.common import ascii_lower_words

OTHER = tiktoken.Encoding("other", pat_str=P.PATTERN, mergeable_ranks=Vocabulary.load(P.path("byte_bpe_50k.tiktoken")).ranks, special_tokens={})


def _words(text):
    return [w.decode() for w in ascii_lower_words(text or "")]


def _identified(docs):
    return {i: t for i, t in docs.items() if any(unicodedata.category(c)[0] == "L" for c in t or "")}


def _without_near_duplicates(docs):
    sets = {}
    for i, t in docs.items():
        w = _words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in docs}
    for a, b in itertools.combinations(sorted(docs), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {i: new if x == old else x for i, x in label.items()}
    return {i: docs[i] for i in docs if label[i] == i}


def _without_repeats(docs, size=20):
    seen, out = set(), {}
    for i in sorted(docs):
        parts = re.findall(r"[ \t-\r]*[^ \t-\r]+", docs[i])
        words = [p.lstrip(" \t\n\v\f\r") for p in parts]
        gone = set()
        for j in range(len(words) - size + 1):
            key = tuple(words[j : j + size])
            if key in seen:
                gone |= set(range(j, j + size))
            seen.add(key)
        tail = docs[i][len("".join(parts)) :]
        text = "".join(p for j, p in enumerate(parts) if j not in gone) + tail
        text = text.lstrip(" \t\n\v\f\r") if gone else docs[i]
        if text or not gone:
            out[i] = text
    return out


def _without_benchmark(docs, items):
    windows = set()
    for text in items:
        w = _words(text)
        windows |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9) if w else 0)}
    holds = lambda w: any(tuple(w[j : j + n]) in windows for n in range(1, 11) for j in range(len(w) - n + 1))
    return {i: t for i, t in docs.items() if not holds(_words(t))}


def _encoded(docs):
    out = {}
    for i, text in docs.items():
        ids = OTHER.encode_ordinary(text)
        code = b"".join(x.to_bytes(4, "little") for x in ids)
        out[i] = (len(ids), hashlib.sha256(code).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    return out


def test_stages_by_brute_force(spark, tmp_path):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    text = lambda n: r.choice((" ", "  ", "\n")).join(word() for _ in range(n))
    passage, items = text(70), [text(40), "only three words", None]
    docs = {i: text(r.randint(1, 150)) for i in range(60)}
    for i in range(60, 75):  # near and exact copies
        words = docs[i - 60].split(" ")
        words[r.randrange(len(words))] = word() if i % 3 else words[0]
        docs[i] = " ".join(words)
    for i in range(75, 90):
        docs[i] = f"{text(80)} {passage} {text(60)}"
    for i in range(90, 96):
        docs[i] = f"{text(30)} {' '.join(items[0].split()[5 : 5 + r.choice((9, 10, 25))])}, {text(20)}"
    docs |= {96: None, 97: "", 98: "123 456 -- !", 99: "  é only three words  ", 100: passage, 101: f"日本 {text(5)}\n\n"}
    rows = [(i, t, "xy"[i % 2], "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    wants = [_identified(docs)]
    wants.append(_without_near_duplicates(wants[-1]))
    wants.append(_without_repeats(wants[-1]))
    wants.append(_without_benchmark(wants[-1], items))
    assert [len(docs) > len(wants[0]) > len(wants[1]), wants[2] != wants[1], len(wants[2]) > len(wants[3]) > 60] == [True] * 3
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), want in zip(corpus_pipeline.STAGES, wants, strict=False):
        frame = corpus_pipeline.stored(stage(spark, frame, str(tmp_path)))
        assert {x.doc_id: x.text for x in frame.collect()} == want, name
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == _encoded(wants[-1])

"""Many different texts without an id, or with the same one, lose nothing that is clean."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
from granary.llm import decontaminate, substring

BENCH = "ten benchmark words that stand here one behind the other now"


def _texts(n, seed, shared):
    """Different texts; every third one holds a passage of 25 words that others hold, too."""
    r = random.Random(seed)
    for k in range(n):
        words = [f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(r.randint(3, 9))]
        at = r.randrange(len(words))
        yield " ".join(words[:at] + (r.choice(shared).split() if k % 3 == 0 else []) + words[at:])


def _shared(seed):
    r = random.Random(seed)
    return [" ".join(f"s{r.randrange(10**5)}" for _ in range(25)) for _ in range(40)]


def test_substring_dedup_of_one_id(spark):
    texts = list(_texts(12_000, 1, _shared(2)))
    docs = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string").repartition(6)
    # one document: of equal windows those that start furthest left stay
    first = {}
    for t in texts:
        w = t.split()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            first[key] = min(first.get(key, i), i)
    want, kept_texts = Counter(), Counter()
    for t in texts:
        w, gone = t.split(), set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < i:
                gone |= set(range(i, i + 20))
        kept = [x for i, x in enumerate(w) if i not in gone]
        want[len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
        kept_texts[" ".join(kept)] += bool(kept)
    assert sum(n for (_, gone, _), n in want.items() if gone) > 2_000
    assert Counter((r.n_words, r.n_removed, r.kept_sha256) for r in substring.measure(docs).collect()) == want
    assert Counter(r.text for r in substring.remove_repeats(docs).collect()) == +kept_texts


def test_decontamination_by_row(spark):
    bench = spark.createDataFrame([(1, BENCH), (1, BENCH), (2, "another item of the benchmark, of many more words than just ten of them")] * 50, "item_id long, text string")
    clean = list(_texts(3_000, 3, _shared(4)))
    for doc_id in (None, 5):
        dirty = [f"{t} {BENCH}, {t}" for t in clean[:20]]
        docs = spark.createDataFrame([(doc_id, t, "x") for t in [*clean, *dirty]] + [(6, None, "x"), (None, None, "x")], "doc_id long, text string, hit_id string")
        for block in (decontaminate.BLOCK_CHARS, 60):
            got = decontaminate.remove_contaminated(docs, bench, block_chars=block).collect()
            assert Counter(r.text for r in got) == Counter([*clean, None, None])


def test_pipeline_keeps_all_clean_rows(spark, tmp_path):
    shared, rows = _shared(6), []
    for doc_id, seed in ((None, 7), (9, 8)):
        texts = list(_texts(3_000, seed, shared))
        rows += [(doc_id, t, "en", "s", len(t)) for t in [*texts, *[f"{t} {BENCH}" for t in texts[1:60:3]]]]
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    own = lambda text: re.sub(r"\bs\d+\b", "", text).split()  # noqa: E731  a text's words without shared passages
    want = Counter(" ".join(own(t)) for _, t, *_ in rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        if name == "benchmark decontamination":
            want = Counter({t: n for t, n in want.items() if BENCH not in t})
        assert Counter(" ".join(own(r.text)) for r in docs.collect()) == want, name
    _, encode = corpus_pipeline.STAGES[-1]
    assert encode(spark, docs, str(tmp_path)).count() == sum(want.values())


def test_tags_go_only_with_ids_of_several_texts(spark, monkeypatch):
    made, rows_of = [], substring._anchor_rows
    monkeypatch.setattr(substring, "_anchor_rows", lambda docs, window: made.append(rows_of(docs, window)) or made[-1])
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a), (1, a), (2, f"x {a}"), (3, b), (3, f"y z {b} {c}"), (4, c), (5, None), (None, d), (None, f"{d} u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring.measure(docs).collect())
    tags = {}
    for r in made[0].collect():
        tags.setdefault(r.id, set()).add(r.tag)
    assert len(tags[3]) == 2 and 0 not in tags[3]
    assert all(x == {0} for i, x in tags.items() if i != 3) and len(tags) == 6
    nulls = sum(n for (i, *_), n in got.items() if i is None)
    assert nulls == 2 and sum(r[2] for r in got if r[0] is None) == 30
    assert Counter({r: n for r, n in got.items() if r[0] is not None}) == Counter([(1, 30, 0)] * 2 + [(2, 31, 30), (3, 30, 0), (3, 62, 30), (4, 30, 30), (5, 0, 0)])

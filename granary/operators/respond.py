"""Whole answers without a language model: which hits count, whether they are enough, what is said, and what must not be.

All rules work within a hit or within a question's few hits. Only blocks of at most a thousand characters are grouped,
never the texts of the hits.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import config
from granary.functions.text import contains_any, fold, once, squash
from granary.operators import answers as A
from granary.operators.chatlog import advice_issues

# fixed values
LEAST_SCORE, SURE, FAIR = 0.08, 0.22, 0.12
NO_SOURCES = "Hiện chưa có đủ tài liệu trong hệ thống để kết luận."
OFF_TOPIC = f"{NO_SOURCES} Các nguồn truy xuất hiện tại chưa khớp trực tiếp với ý chính của câu hỏi."
GUARDED = (
    "Tài liệu có nhắc đến nội dung cần kiểm chứng thêm. Hệ thống không đưa ra tên thuốc, "
    "liều lượng hoặc hướng dẫn hóa chất khi chưa có xác nhận chuyên gia địa phương."
)
UNTITLED = "Nguồn chưa đặt tên"
BEFORE_HARVEST = "Trước khi thu hoạch cà phê, bà con nên lưu ý:"
AFTER_CHECKLIST = "Nên đối chiếu thêm với tình trạng thực tế của vườn trước khi quyết định thời điểm hái hoặc cách xử lý sau thu hoạch."
FROM_SOURCES = "Dựa trên tài liệu đã truy xuất, có thể tham khảo:"
AFTER_SUMMARY = (
    "Hệ thống chưa tự suy ra loại phân, liều lượng hoặc lịch bón ngoài phần tài liệu đã nêu. "
    "Nên đối chiếu với tình trạng vườn và hỏi cán bộ khuyến nông nếu cần quyết định kỹ thuật cụ thể."
)
SITE_ANSWER = (
    "Hiện chưa đủ tài liệu trong hệ thống để kết luận nên đầu tư phát triển hệ thống cà phê ở đâu.\n\n",
    " Để trả lời chính xác, hệ thống cần thêm dữ liệu theo vùng về khí hậu, đất, nước tưới, "
    "giống cà phê, hạ tầng thu mua/chế biến, chi phí vận hành, rủi ro sâu bệnh và chính sách địa phương.\n\n"
    "Với dữ liệu hiện có, chỉ nên dùng RAG để tham khảo tiêu chí kỹ thuật/canh tác, chưa dùng để ra quyết định chọn địa điểm đầu tư.",
)
NAMED_PLACES = ("Tài liệu truy xuất có nhắc tới ", ", nhưng đó chưa đủ để kết luận đây là nơi nên đầu tư.")
NO_PLACES = "Các tài liệu truy xuất chưa có dữ liệu địa điểm đủ rõ để so sánh vùng đầu tư."
BONUS = (("truoc thu hoach",), 4), (("ve sinh vuon", "ty le qua chin", "thoi tiet", "san phoi", "che bien"), 2)

_EDGE = " :-–—"
_WORD = re.compile(r"\w+")
_LOW = re.compile("|".join(f"({p})" for p in A.LOW_VALUE_LINES).replace(r"[^\p{L}\p{N}_]", r"\W"), re.IGNORECASE)
_NOISE = re.compile(rf"\b({'|'.join(A.TRAINING_NOISE)})\b")
_MENU = re.compile(r"\b(Toggle|Menu|NỘI DUNG CHÍNH|Xem thêm)\b", re.IGNORECASE)
_LABELS = re.compile(r"\bH\d+\s*:\s*", re.IGNORECASE), re.compile(r"\bHình\s+\d+\s*:\s*", re.IGNORECASE)


def compact(sentence: str) -> str:
    """A sentence or paragraph in one line, without labels of pictures and menus, cut at a word behind 217 characters."""
    sentence = _MENU.sub("", re.sub(r"\s+", " ", sentence).strip(_EDGE)).strip()
    for label in _LABELS:
        sentence = label.sub("", sentence)
    return sentence if len(sentence) <= 220 else sentence[:217].rsplit(" ", 1)[0] + "..."


def relevant_text(cleaned: str, question: str, most: int = 900, parts: int = 4) -> str:
    """The paragraphs of a cleaned text that say most about a question, as many as fit; enough at 70 %.

    Paragraphs of 30 characters or more are ranked by the question's words that they hold (important ones, then all), by
    what their topic adds or takes, and by shortness; repeats and lines without value are skipped, and one that doesn't
    fit gives way to the next. Without any the beginning of the text is returned.
    """
    words = [w for w in _WORD.findall(A.folded_word(question)) if len(w) >= 4]
    important = [w for w in words if w not in config.CHAT_STOPWORDS]

    def rank(paragraph: str) -> tuple[int, int, int, int]:
        folded = A.folded_word(paragraph)
        bonus = sum(n for terms, n in BONUS if any(t in folded for t in terms)) - 6 * bool(_NOISE.search(folded))
        return sum(w in folded for w in important), sum(w in folded for w in words), bonus, -len(paragraph)

    paragraphs = [p.strip() for p in re.split(r"\n{2,}", cleaned) if len(p.strip()) >= 30]
    chosen: list[str] = []
    size = 0
    for paragraph in sorted(paragraphs, key=rank, reverse=True):
        line = compact(paragraph)
        grown = size + len(line) + 2 * bool(chosen)
        if not line or _LOW.search(line) or line in chosen or chosen and grown > most:
            continue
        chosen.append(line)
        size = grown
        if size >= 0.7 * most or len(chosen) >= parts:
            break
    return ("\n".join(chosen) or cleaned)[:most]


def relevant_text_udf(most: int = 900):
    @F.pandas_udf(T.StringType())
    def run(cleaned: pd.Series, question: pd.Series) -> pd.Series:
        return pd.Series([relevant_text(c or "", q or "", most) for c, q in zip(cleaned, question, strict=True)])

    return run


def _compact(c: Column) -> Column:
    """``compact`` as an expression."""
    word = lambda w: rf"(?iu)(?<![\p{{L}}\p{{N}}_]){w}"
    c = F.trim(F.regexp_replace(F.btrim(squash(c), F.lit(_EDGE)), word(r"(Toggle|Menu|NỘI DUNG CHÍNH|Xem thêm)(?![\p{L}\p{N}_])"), ""))
    c = F.regexp_replace(F.regexp_replace(c, word(r"H\d+\s*:\s*"), ""), word(r"Hình\s+\d+\s*:\s*"), "")
    return F.when(F.length(c) <= 220, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, 217), " [^ ]*$", ""), F.lit("...")))


def summary_lines(context: Column, question: Column, most: int = 4) -> Column:
    """The sentences of a cleaned context with most words of the question, in their order, as list items; none without any."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}_]{4,}"), 0)), lambda w: ~w.isin(*config.CHAT_STOPWORDS))
    parts = F.transform(F.split(context, r"[.\n]"), lambda x, i: F.struct(i.alias("i"), _compact(x).alias("x")))
    kept = F.filter(parts, lambda p: F.length(p["x"]).between(35, 260) & ~F.startswith(p["x"], F.lit(",")) & ~A.is_low_line(p["x"]) & ~A.is_garbage(p["x"]))

    def choose(x: Column) -> Column:
        found = lambda s: F.size(F.filter(x["w"], lambda w: F.contains(F.lower(s), w)))
        ranked = F.array_sort(F.transform(x["k"], lambda p: F.struct((-found(p["x"])).alias("k"), p["i"].alias("i"), p["x"].alias("x"))))
        ordered = F.array_sort(F.transform(F.slice(ranked, 1, most), lambda p: F.struct(p["i"].alias("i"), p["x"].alias("x"))))
        return F.transform(ordered, lambda p: F.concat(F.lit("- "), p["x"], F.lit(".")))

    return once(F.struct(words.alias("w"), kept.alias("k")), choose)


def _listed(items: Column) -> Column:
    return F.array_join(items, "\n")


def extractive(context: Column, question: Column) -> Column:
    """A checklist before harvest, a summary, or that there isn't enough."""

    def say(x: Column) -> Column:
        items = F.when(F.array_contains(A.question_flags(x["q"]), "pre_harvest"), A.checklist(x["c"]))
        bare = lambda line: F.rtrim(F.regexp_replace(line, "^[- ]+", ""), F.lit("."))
        whole = F.filter(summary_lines(x["c"], x["q"]), lambda line: ~bare(line).rlike(r"^[\d\s.]+$") & (F.length(bare(line)) >= 30))
        listed = F.concat(F.lit(f"{BEFORE_HARVEST}\n- "), F.array_join(items, "\n- "), F.lit(f"\n{AFTER_CHECKLIST}"))
        summed = once(whole, lambda w: F.when(F.size(w) > 0, F.concat(F.lit(f"{FROM_SOURCES}\n"), _listed(w), F.lit(f"\n{AFTER_SUMMARY}"))).otherwise(NO_SOURCES))
        return F.when(F.size(items) > 0, listed).otherwise(summed)

    return once(F.struct(A.clean_context(context).alias("c"), question.alias("q")), say)


def site_answer(places: Column) -> Column:
    note = F.when(F.size(places) > 0, F.concat(F.lit(NAMED_PLACES[0]), F.array_join(places, ", "), F.lit(NAMED_PLACES[1]))).otherwise(NO_PLACES)
    return F.concat(F.lit(SITE_ANSWER[0]), note, F.lit(SITE_ANSWER[1]))


def judged_hits(hits: DataFrame, block: int = 1100) -> DataFrame:
    """Each hit with what it says on its question: terms, whether it is good, and a block of its relevant text.

    ``hits`` has query_id, question, place, score, source_id, title, url and text.
    """
    whole = squash(fold(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("text", F.lit("")))))
    rows = hits.withColumns({"terms": A.important_terms(F.col("question")), "__x": whole, "__clean": A.clean_context(F.coalesce("text", F.lit("")))})
    rows = rows.withColumns({"matched": A.matched_terms(F.col("terms"), F.col("__x")), "__said": relevant_text_udf(block)("__clean", "question")})
    x, question = F.col("__x"), F.col("question")
    good = (F.size("terms") == 0) | ((F.size("matched") > 0) & A.is_on_topic(question, x) & ~A.is_low_value(question, x))
    name = F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED))
    place = F.coalesce(F.nullif("url", F.lit("")), F.lit("local"))
    said = F.concat(F.lit("Nguồn: "), name, F.lit("\nURL/File: "), place, F.lit("\nNội dung:\n"), F.col("__said"))
    return rows.select(
        "query_id", "place", "score", "source_id", "terms", "matched", good.alias("good"), contains_any(x, config.SEED_TERMS).alias("seeds"), said.alias("said")
    )


def _enough(terms: Column, hits: Column) -> Column:
    matched = F.array_distinct(F.flatten(F.transform(hits, lambda h: h["matched"])))
    asks = lambda vocabulary: F.arrays_overlap(terms, F.array(*[F.lit(t) for t in vocabulary]))
    least = F.when(asks(config.DISEASE_TERMS), 1).otherwise(F.least(F.lit(2), F.size(terms)))
    seeds = F.exists(hits, lambda h: h["seeds"]) & (F.size(matched) >= 1)
    return F.when(F.size(terms) == 0, True).when(asks(config.SEED_TERMS), seeds).otherwise(F.size(matched) >= least)


def decided(questions: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """query_id, question, the hits that count (relevant), the way out and the confidence; ``questions`` has query_id and question."""
    judged = judged_hits(hits)
    order = F.array_sort(F.collect_list(F.struct("place", "score", "source_id", "good", "matched", "seeds", "said")))
    rows = questions.join(judged.groupBy("query_id").agg(order.alias("hits")), "query_id", "left")
    good = F.filter("hits", lambda h: h["good"])
    rows = rows.withColumns({"relevant": once(good, lambda g: F.when(F.size(g) > 0, g).otherwise(F.slice("hits", 1, 1))), "terms": A.important_terms(F.col("question"))})
    score = F.try_element_at("hits", F.lit(1))["score"]
    none = F.coalesce(score < LEAST_SCORE, F.lit(True))
    enough = _enough(F.col("terms"), F.slice("relevant", 1, k))
    site = F.array_contains(A.question_flags(F.col("question")), "site_investment")
    rows = rows.withColumn("way", F.when(none, "no_hit").when(~enough, "off_topic").when(site, "site").otherwise("answer"))
    top = F.try_element_at("relevant", F.lit(1))["score"]
    found = F.col("way").isin("site", "answer")
    return rows.select(
        "query_id",
        "question",
        F.when(found, F.slice("relevant", 1, k)).alias("relevant"),
        "way",
        F.when(F.col("way") != "answer", "thap").when(top >= SURE, "cao").when(top >= FAIR, "trung_binh").otherwise("thap").alias("confidence"),
        F.when(found, F.array_join(F.array_distinct(F.transform("relevant", lambda h: h["source_id"])), ",")).otherwise("").alias("sources"),
        top.alias("top"),
    )


def batch_answers(questions: DataFrame, hits: DataFrame, places: tuple[str, ...], k: int = 5) -> DataFrame:
    """query_id, way, confidence, sources and answer of each question.

    Ways out: ``no_hit`` (none, or the first below 0.08), ``off_topic`` (the hits don't hold what the question is
    about), ``site`` (where to invest: places that are named, no verdict), ``guarded`` (chemicals, doses or promises),
    ``answer``. Null questions have no terms: whatever was found answers them.
    """
    rows = decided(questions.withColumn("question", F.coalesce("question", F.lit(""))), hits, k)
    rows = rows.withColumn("context", F.array_join(F.transform("relevant", lambda h: h["said"]), "\n\n"))
    low = F.lower(F.coalesce("context", F.lit("")))
    named = once(low, lambda c: F.filter(F.array(*[F.lit(p) for p in places]), lambda p: F.contains(c, F.lower(p))))
    rows = rows.withColumn("named", named)
    said = F.when(F.col("way") == "answer", A.scrub(A.without_excuse(extractive(F.col("context"), F.col("question")), F.col("top")), F.col("question")))
    rows = rows.withColumn("said", said)
    risky = F.coalesce(F.size(advice_issues(F.col("said"))) > 0, F.lit(False))
    site = F.col("way") == "site"
    return rows.select(
        "query_id",
        F.when(risky, "guarded").otherwise(F.col("way")).alias("way"),
        F.when(site & (F.size("named") > 0), "trung_binh").otherwise(F.col("confidence")).alias("confidence"),
        "sources",
        F.when(F.col("way") == "no_hit", NO_SOURCES)
        .when(F.col("way") == "off_topic", OFF_TOPIC)
        .when(site, site_answer(F.col("named")))
        .when(risky, f"{GUARDED}\n\n{A.DISCLAIMER}")
        .otherwise(F.col("said"))
        .alias("answer"),
    )

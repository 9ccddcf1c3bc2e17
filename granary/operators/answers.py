"""Parts of answers: rules on context, questions and candidates, scrubbing. Whole answers are in ``respond``."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary import config
from granary.functions.text import contains_any, flags, fold, folded_tokens, lines, once, squash
from granary.operators.chatlog import advice_issues

# fixed values
DISCLAIMER = "Thông tin chỉ mang tính hỗ trợ, không thay thế chuyên gia nông nghiệp."
FILTERED = "[đã lọc]"
NO_ADVICE = "Theo dõi triệu chứng, cải thiện vệ sinh vườn và hỏi chuyên gia khi bệnh lan nhanh."
INSTRUCTIONS = (
    r"(ignore|disregard|forget)\s+(previous|all|system|above|prior)\s+(instructions?|rules?|prompt)",
    r"(you are now|act as|pretend to be|switch to|new role)\b",
    r"(bỏ qua|phớt lờ|quên)\s+(hướng dẫn|quy tắc|system|prompt)",
    r"(repeat|translate|reveal|show|print)\s+(the|your|system|above)\s+(prompt|instructions?|text)",
    r"```\s*(system|prompt|instruction)",
)
TRAINING_NOISE = (
    "đào tạo", "bài giảng", "giảng viên", "học viên", "kế hoạch bài giảng", "phương pháp giảng", "thảo luận nhóm", "mục tiêu học tập", "ffs",
    "tot", "tập huấn",
)
OFF_TOPIC = (
    "remote jobs", "freelance jobs", "từ vựng tiếng anh", "vocabulary", "tranh chấp môi trường", "luật môi trường", "chứng khoán", "solidworks",
    "mặt trận tổ quốc", "kỹ thuật xây dựng",
)
ANCHORS = ("cà phê", "ca phe", "coffee", "trs1", "tr4", "robusta", "arabica", "eakmat", "tây nguyên", "tay nguyen")
OTHER_SCRIPT = "[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af]"
PRODUCTS = r"(^|[^\p{L}\p{N}_])(nucafe|sa\s+kali|kali\s+sun)($|[^\p{L}\p{N}_])"
#: Words of other languages in answers, and what they mean.
ARTEFACTS = (("atau", "hoặc"), ("dan", "và"))
# starts and parts of lines that carry nothing
LOW_VALUE_LINES = (
    r"^\s*h\d+\s*:", r"^\s*hình\s+\d+", r"^\s*bài\s+\d+", r"^\s*kế hoạch bài giảng", r"^\s*\(?phút\)?\s*$", r"^\s*stt($|[^\p{L}\p{N}_])",
    r"^\s*toggle($|[^\p{L}\p{N}_])", r"^\s*menu($|[^\p{L}\p{N}_])", r"\.{4,}", r"^\s*\d+\.\d+\.\d*\s", r"^\s*(ths|ts|pgs|gs|cn|ks)\.\s",
    r"^\s*\d+\s*[-–.]\s*(ths|ts|pgs|gs|cn|ks)($|[^\p{L}\p{N}_])", r"[-–]\s*(giz|wasi|ipsard|fao|undp|jica)($|[^\p{L}\p{N}_])",
    r"(viện trưởng|phó viện trưởng|nguyên phó viện trưởng)\s+(wasi|ipsard|vaas)($|[^\p{L}\p{N}_])", r"^\s*trang\s+\d+",
)
# letters of scans: old ones, upper case within words, a consonant, a space and a marked vowel
OLD_LETTERS, MIXED_CASE = "[ƣƢ]", "[a-zàáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệ][A-ZÀÁẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬÈÉẺẼẸ]{2,}"
BROKEN = "[bcdfghjklmnpqrstvwxyz] [ạảãáàắằẳẵặấầẩẫậếềểễệíìỉĩịốồổỗộớờởỡợứừửữự][bcdfghjklmnpqrstvwxyz]"
#: What an answer says that has too little to go on, and what it says instead.
EXCUSE = r"^\s*hiện chưa(?: có)? đủ tài liệu"
INSTEAD = ("Dựa trên các tài liệu đã truy xuất, ", "Dựa trên các tài liệu đã truy xuất, có thể tóm tắt như sau:\n\n")


def is_low_line(line: Column) -> Column:
    return F.lower(line).rlike("|".join(f"({p})" for p in LOW_VALUE_LINES))


def is_garbage(text: Column) -> Column:
    """Scanned text that can't be read: old letters, upper case within words, or many broken words for its length."""
    n = F.regexp_count(F.lower(text), F.lit(BROKEN))
    dense = F.when(F.length(text) < 120, n >= 1).otherwise((n >= 3) | (n / F.greatest(F.lit(1), F.length(text)) > 0.010))
    return text.rlike(OLD_LETTERS) | text.rlike(MIXED_CASE) | ((n > 0) & dense)


def clean_context(text: Column) -> Column:
    """Text of a source as it may be quoted: without labels of blocks, lines of no value and unreadable ones, with single spaces."""
    for label in (r"Nguồn:\s*[^\n]+", r"URL/File:\s*[^\n]+", "Nội dung:", r"[ \t]{2,}"):
        text = F.regexp_replace(text, label, " ")
    tidy = F.transform(lines(text), lambda x: F.btrim(squash(x), F.lit(" :-–—")))
    kept = F.filter(tidy, lambda x: (x == "") | ~(is_low_line(x) | is_garbage(x)))
    return F.btrim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), F.lit(" \n"))


def without_excuse(answer: Column, score: Column) -> Column:
    """A long answer to a good hit doesn't begin with the excuse that there are too few sources."""
    but, alone = r"(?iu)^\s*Hiện chưa(?: có)? đủ tài liệu[^\n.]*[.]\s*Tuy nhiên,\s*", r"(?iu)^\s*Hiện chưa(?: có)? đủ tài liệu[^\n]*\n+"
    said = F.when(answer.rlike(but), F.regexp_replace(answer, but, INSTEAD[0])).otherwise(F.regexp_replace(answer, alone, INSTEAD[1]))
    bad = (F.coalesce(score, F.lit(0.0)) >= 0.12) & answer.rlike(f"(?iu){EXCUSE}") & (F.length(answer) >= 250)
    return F.when(bad, said).otherwise(answer)


def folded_word(word: str) -> str:
    marks = unicodedata.normalize("NFD", word.lower())
    return "".join(c for c in marks if unicodedata.category(c) != "Mn").replace("đ", "d")


def sanitize(text: Column) -> Column:
    """Instruction-like phrases of crawled text become a marker."""
    for pattern in INSTRUCTIONS:
        text = F.regexp_replace(text, f"(?iu){pattern}", FILTERED)
    return text


def question_flags(question: Column) -> Column:
    """Names of the routes that a question takes."""

    def rule(f: Column) -> Column:
        before = F.contains(f, F.lit("truoc thu hoach"))
        care = F.contains(f, F.lit("thu hoach")) & contains_any(f, ("luu y", "cham soc", "chuan bi"))
        invest = contains_any(f, ("dau tu", "phat trien he thong", "mo trang trai"))
        where = contains_any(f, ("o dau", "vung nao", "khu vuc nao", "dia phuong nao", "tinh nao", "noi nao"))
        crop = contains_any(f, ("ca phe", "coffee", "nong nghiep", "vuon", "trang trai"))
        return flags([("pre_harvest", before | care), ("site_investment", invest & where & crop), ("exact_topic", F.contains(f, F.lit("thu hoach")))])

    return once(squash(fold(question)), rule)


def is_low_value(question: Column, text: Column) -> Column:
    """Training material, unless a question before harvest finds what it asks for. Patterns keep their accents on folded text."""
    borders = "|".join(TRAINING_NOISE)
    noise = lambda f: f.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({borders})($|[^\p{{L}}\p{{N}}_])")
    asked = F.array_contains(question_flags(question), "pre_harvest")
    return once(squash(fold(text)), lambda f: noise(f) & ~(asked & contains_any(f, ("truoc thu hoach", "qua chin"))))


def candidate_is_relevant(hay: Column, query_terms: Column, penalty: Column, score: Column) -> Column:
    hits = F.size(F.filter(query_terms, lambda t: F.contains(hay, t)))
    return ~contains_any(hay, OFF_TOPIC) & contains_any(hay, ANCHORS) & ~((penalty >= 0.45) & (score < 3.0)) & ~((score < 1.2) & (hits < 1))


def important_terms(question: Column) -> Column:
    """Different folded words of a question that may say something about its topic."""
    words = F.array_distinct(folded_tokens(fold(question)))
    stop = [*dict.fromkeys(folded_word(w) for w in config.CHAT_STOPWORDS), *config.FOLDED_STOPWORDS]
    return F.array_except(words, F.array(*[F.lit(w) for w in stop]))


def matched_terms(terms: Column, folded: Column) -> Column:
    """Terms that a folded text holds; one of three letters must be a word of its own."""
    words = folded_tokens(folded, 1)
    return once(F.struct(terms.alias("t"), folded.alias("f"), words.alias("w")), lambda x: F.filter(
        x["t"], lambda t: F.when(F.length(t) <= 3, F.array_contains(x["w"], t)).otherwise(F.contains(x["f"], t))
    ))


def is_enough(terms: Column, matched: Column, context: Column) -> Column:
    """Do the first hits cover a question: a term for varieties, if the context speaks of them, and for diseases; two, or all, for others."""
    has = lambda vocabulary: F.arrays_overlap(terms, F.array(*[F.lit(t) for t in vocabulary]))
    seeds = contains_any(context, config.SEED_TERMS) & (F.size(matched) >= 1)
    least = F.when(has(config.DISEASE_TERMS), 1).otherwise(F.least(F.lit(2), F.size(terms)))
    return F.when(F.size(terms) == 0, True).when(has(config.SEED_TERMS), seeds).otherwise(F.size(matched) >= least)


def is_on_topic(question: Column, folded: Column) -> Column:
    """What questions on harvest, and before harvest, ask of a text."""
    asked = fold(question)
    return F.when(F.contains(asked, F.lit("truoc thu hoach")), contains_any(folded, config.BEFORE_HARVEST_TERMS)).when(
        F.contains(asked, F.lit("thu hoach")), contains_any(folded, config.HARVEST_TERMS)
    ).otherwise(True)


def recommendations(context: Column) -> Column:
    """The first four sentences of a context that give no risky advice; a general one if there is none."""
    parts = F.transform(F.split(F.replace(context, F.lit("\n"), F.lit(" ")), r"\."), lambda x: F.trim(x))
    safe = F.filter(parts, lambda x: F.length(x).between(45, 220) & (F.size(advice_issues(x)) == 0))
    return once(F.slice(safe, 1, 4), lambda x: F.when(F.size(x) == 0, F.array(F.lit(NO_ADVICE))).otherwise(x))


def label_query(label: Column, symptoms: Column) -> Column:
    """The retrieval query of a label and what was seen."""
    return F.concat_ws(" ", label, symptoms, F.lit("cà phê triệu chứng nguyên nhân xử lý"))


def checklist(context: Column) -> Column:
    """Items of the checklist before harvest that a context calls for."""
    return once(fold(context), lambda f: F.array_compact(F.array(*[F.when(contains_any(f, triggers), item) for triggers, item in config.HARVEST_CHECKLIST])))


def scrub(answer: Column, question: Column) -> Column:
    """An answer without words of other languages, lines on another crop or on products, and with one disclaimer at its end."""

    def clean(x: Column) -> Column:
        said = x["a"]
        for word, meaning in ARTEFACTS:
            said = F.regexp_replace(said, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])", meaning)
        said = F.regexp_replace(said, r"(?iu)\s+hoặc\s+NUCAFE(?![\p{L}\p{N}_])", "")
        about = F.contains(x["q"], F.lit("ca phe"))
        off = lambda f: about & F.contains(f, F.lit("ho tieu")) & ~F.contains(f, F.lit("ca phe"))
        kept = F.filter(F.split(said, "\n"), lambda line: ~off(fold(line)) & ~F.lower(line).rlike(PRODUCTS))
        bare = F.regexp_replace(F.array_join(kept, "\n"), f"(?iu){DISCLAIMER.replace('.', '[.]')}", "")
        body = F.btrim(F.regexp_replace(bare, r"\n{3,}", "\n\n"), F.lit(" \n\t"))
        return F.when(body == "", DISCLAIMER).otherwise(F.concat(body, F.lit(f"\n\n{DISCLAIMER}")))

    return once(F.struct(answer.alias("a"), squash(fold(question)).alias("q")), clean)


def has_other_script(answer: Column) -> Column:
    return answer.rlike(OTHER_SCRIPT)

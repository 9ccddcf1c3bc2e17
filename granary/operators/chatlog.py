"""Chat-log labelling: guard, intent rules, follow-ups, rewriting with context. Rules are lexicons on folded text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import contains_any, first_true, flags, fold, once, squash

# fixed values: rule lexicons, without accents
CROP = (
    "ca phe", "cafe", "coffee", "cf", "lua", "rau", "che", "ho tieu", "tieu", "dieu", "sau rieng", "bo", "ca cao", "cacao", "mit",
    "vuon", "ray", "ruong", "trang trai", "nong nghiep", "cay trong", "cay", "giong", "phan bon", "sau benh", "benh cay", "thu hoach",
    "canh tac", "tuoi", "nang suat", "dat",
)
AGRI_VERBS = (
    "trong", "tia", "ghep", "ban", "u", "tuoi", "bon", "phun", "ngua", "ngat", "diet", "phong tru", "phong", "kiem soat", "cham soc",
    "cai tao", "tai canh", "thu hoach", "thu hai", "che bien", "phoi", "say", "san phoi", "bao quan", "uom", "gieo", "san xuat", "chua",
    "tri", "khac phuc", "nhan biet", "nhan dien", "phat hien", "ngua benh", "kiem tra",
)
AGRI_TOPICS = (
    "benh", "sau benh", "nam", "rep", "ri sat", "vi rut", "vi khuan", "dom mat cua", "than thu", "tuyen trung", "rep sap", "trieu chung",
    "vang la", "rung la", "rung qua", "phan bon", "phan", "npk", "kali", "ure", "thuoc bvtv", "thuoc tru sau", "thuoc tru nam", "giong",
    "tai canh", "hat giong", "cay con", "qua chin", "qua xanh", "hoa", "trai", "re", "than", "la", "vuon", "ray", "ruong",
)
SOCIAL_VERBS = (
    "di", "ra", "qua", "ru", "len", "ghe", "uong", "lam", "kieu", "kieu mot", "kieu mot ly", "kieu ly", "ly", "coc", "tach", "lam vai",
    "lam mot", "hen", "gap", "an", "nhau", "choi", "moi", "tu",
)
SOCIAL_PHRASES = (
    "hen ho", "di choi", "di an", "di nhau", "lam vai ly", "ru di", "ru anh", "ru em", "moi em", "moi anh", "toi nay", "chieu nay",
    "sang nay", "trua nay", "ranh khong", "ranh ko", "co ranh",
)
OUT_OF_SCOPE = (
    "chung khoan", "co phieu", "crypto", "coin", "forex", "bat dong san", "vu khi", "mat khau", "hack", "benh nguoi", "bac si", "luat su",
    "bong da", "the thao", "chinh tri", "thoi su",
)
GREETING = ("hi", "hello", "helo", "hey", "chao", "xin chao", "chao ban", "chao ai")
GREETING_MORE = ("chao em", "chao anh")
THANKS = ("cam on", "thanks", "thank you", "ok cam on", "oke cam on")
GOODBYE = ("tam biet", "bye", "goodbye")
CAPABILITY = ("ban lam duoc gi", "co the lam gi", "huong dan su dung", "hoi gi duoc", "ban la ai")  # add the name of one's own assistant
TECHNIQUE = (
    "lam sao", "the nao", "ra sao", "tai sao", "vi sao", "khi nao", "bao nhieu", "bao lau", "bao gio", "lieu luong", "trieu chung",
    "nguyen nhan", "cach",
)
FOLLOWUP = (
    "vay con", "vay thi", "the con", "the nao", "ra sao", "roi sao", "roi thi sao", "con cai do", "con loai do", "loai do", "cai do",
    "no thi sao", "vay no", "tiep theo", "ke tiep", "tiep tuc", "duoc chua", "xong chua", "ok chua", "oke chua", "dung khong",
    "phai khong", "co dung khong", "co phai khong", "hieu chua", "ro chua", "ro chuwa", "nam ro chua", "on chua", "chien chua",
    "chuan chua", "kha thi",
)
SHORT_REPLIES = (
    "roi", "vay", "the", "ok", "oke", "u", "uh", "duoc", "chua", "chua a", "the a", "vay a", "the ha", "vay ha", "the sao", "vay sao",
    "sao",
)
CONCRETE = (
    "phân", "bón", "dinh dưỡng", "tưới", "nước", "giống", "tái canh", "thu hoạch", "sâu", "bệnh", "tuyến trùng", "rệp", "vàng lá", "tỉa",
    "tạo tán", "chi phí", "tiêu chuẩn",
)
INJECTION = r"bo qua (huong dan|quy tac|system)|ignore (previous|system|developer)|tiet lo prompt|system prompt"
DEICTIC, CLOSING = ("vay", "the", "no", "do"), ("chua", "khong", "ha", "a")
IDENTITY = ("benh gi", "bi gi", "la benh nao", "dang bi benh")
SYMPTOMS = ("vang", "dom", "set", "tham", "kho", "heo", "la", "than", "qua", "re", "mun", "bot", "rụng", "sau", "rep", "nam")


def compact(question: Column) -> Column:
    """Folded words with single spaces, without punctuation."""
    return squash(F.regexp_replace(fold(question), r"[^\p{L}\p{N}_\s]", " "))


def token_aware(text: Column, needles) -> Column:
    """Single words of up to three letters match whole words, everything else anywhere."""
    short = [n for n in needles if len(n) <= 3]
    long = [n for n in needles if len(n) > 3]
    found = text.rlike("(^| )(" + "|".join(map(re.escape, short)) + ")( |$)") if short else F.lit(False)
    return found | contains_any(text, long) if long else found


def is_followup(question: Column) -> Column:
    def rule(c: Column) -> Column:
        words = F.filter(F.split(c, " "), lambda w: w != "")
        deictic = F.arrays_overlap(words, F.array(*[F.lit(w) for w in DEICTIC]))
        closing = F.coalesce(F.try_element_at(words, F.lit(-1)).isin(*CLOSING), F.lit(False))
        return contains_any(c, FOLLOWUP) | c.isin(*SHORT_REPLIES) | ((F.size(words) <= 3) & (deictic | closing))

    return once(compact(question), rule)


def intent(question: Column) -> Column:
    """struct(label, confidence) by the first rule that holds; the order of rules decides."""

    def rule(c: Column) -> Column:
        crop, social = token_aware(c, CROP), token_aware(c, SOCIAL_VERBS)
        agri = token_aware(c, AGRI_VERBS) | token_aware(c, AGRI_TOPICS)
        technique, phrase = contains_any(c, TECHNIQUE), contains_any(c, SOCIAL_PHRASES)
        greeting = c.isin(*GREETING, *GREETING_MORE, *THANKS, *GOODBYE) | contains_any(c, CAPABILITY)
        answer = lambda label, confidence: F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))
        return first_true(
            [
                (greeting, answer("greeting", 0.95)),
                (contains_any(c, OUT_OF_SCOPE), answer("out_of_scope", 0.95)),
                (crop & agri, answer("agri_question", 0.95)),
                (crop & technique & ~social, answer("agri_question", 0.9)),
                (crop & (social | phrase) & technique, answer("agri_question", 0.0)),
                (crop & (social | phrase), answer("social_chitchat", 0.9)),
                (phrase & ~crop, answer("social_chitchat", 0.9)),
                (crop & ~social, answer("agri_question", 0.6)),
            ],
            answer("agri_question", 0.0),
        )

    return once(compact(question), rule)


def cascade(question: Column, with_history: Column, accept: float = 0.7) -> Column:
    """struct(label, confidence, source): sure rules are taken, the rest falls back; follow-ups with history always do."""
    first = intent(question)

    def decide(i: Column) -> Column:
        sure = (i["confidence"] >= accept) & ~(with_history & is_followup(question))
        return F.struct(
            F.when(F.trim(question) == "", "greeting").when(sure, i["label"]).otherwise("agri_question").alias("label"),
            F.when(F.trim(question) == "", 1.0).when(sure, i["confidence"]).otherwise(0.0).alias("confidence"),
            F.when(F.trim(question) == "", "empty").when(sure, "l1_deterministic").otherwise("l2_fallback").alias("source"),
        )

    return once(first, decide)


def basic_kind(question: Column) -> Column:
    def rule(c: Column) -> Column:
        return (
            F.when(c.isin(*GREETING), "greeting").when(c.isin(*THANKS), "thanks").when(c.isin(*GOODBYE), "goodbye").when(contains_any(c, CAPABILITY), "capability")
        )

    return once(compact(question), rule)


def is_vague(question: Column) -> Column:
    return once(squash(fold(question)), lambda f: contains_any(f, IDENTITY) & ~contains_any(f, SYMPTOMS))


def advice_issues(text: Column) -> Column:
    """Issues in order; an issue can stand several times."""
    low = F.lower(text)
    chemical = r"(^|[^\p{L}\p{N}_])(carbendazim|mancozeb|glyphosate|chlorpyrifos|copper oxychloride)($|[^\p{L}\p{N}_])"
    dose = r"(liều|pha|phun)\s+\d+.*(thuốc|hoạt chất|trừ|diệt|nấm|sâu|cỏ)"
    quantity = r"(^|[^\p{L}\p{N}_])\d+([,.]\d+)?\s?(ml|g|kg|l|lit|lít|gram)($|[^\p{L}\p{N}_])"
    context = r"(thuốc|hoạt chất|trừ sâu|trừ nấm|diệt cỏ|bảo vệ thực vật|bv tv)"
    claims = ("chắc chắn khỏi", "đảm bảo khỏi", "không có rủi ro")
    return flags(
        [("chemical", low.rlike(chemical)), ("chemical", low.rlike(dose)), ("dose", low.rlike(quantity) & low.rlike(context))]
        + [("over_claim", F.contains(low, F.lit(c))) for c in claims]
    )


def effective_questions(turns: DataFrame) -> DataFrame:
    """User turns with the question that retrieval should see: a follow-up takes the last user turn of the eight before it
    (else the last assistant turn) along."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-8, -1)
    clean = F.substring(squash(F.col("text")), 1, 1200)
    last = lambda role: F.last(F.when((F.col("role") == role) & (clean != ""), clean), ignorenulls=True).over(before)
    marked = turns.withColumns({"context": F.coalesce(last("user"), last("assistant")), "current": squash(F.col("text"))})
    asked = marked.where(F.col("role") == "user")
    rewrite = is_followup(F.col("current")) & F.col("context").isNotNull()
    tag = F.when(contains_any(F.lower("current"), CONCRETE), "\n(thuộc chủ đề cây cà phê)").otherwise("")
    text = F.concat("current", F.lit("\nNgữ cảnh hội thoại trước đó: "), "context", tag)
    return asked.withColumn("effective", F.when(rewrite, text).otherwise(F.col("current")))

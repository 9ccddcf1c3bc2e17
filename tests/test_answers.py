"""Whole answers by hand: every way out, context rules, selection under a budget."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import answers as A
from granary.operators import respond as R

PLACES = ("Gia Lai", "Lâm Đồng")
RUST = "Bệnh gỉ sắt lá cà phê lây lan nhanh trong mùa mưa. Cần tỉa cành cho vườn thông thoáng để giảm độ ẩm."
HARVEST = "Trước thu hoạch cần kiểm tra vườn cây, theo dõi thời tiết và chuẩn bị sân phơi cho kịp."


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def said(spark):
    asked = [
        (1, "Bệnh gỉ sắt lá xử lý ra sao?"), (2, "Bệnh gỉ sắt lá xử lý ra sao?"), (3, "Bệnh gỉ sắt lá xử lý ra sao?"), (4, "Bệnh gỉ sắt lá xử lý ra sao?"),
        (5, "Nên đầu tư trồng cà phê ở tỉnh nào?"), (6, "Nên đầu tư trồng cà phê ở tỉnh nào?"), (7, "Lưu ý gì trước khi thu hoạch cà phê?"), (8, "Bệnh gỉ sắt lá xử lý ra sao?"),
        (9, None), (10, "Bệnh gỉ sắt lá xử lý ra sao?"),
    ]
    long = "Nấm gỉ sắt hại lá."
    hits = [
        (1, 1, 0.3, "a", "Gỉ sắt", "http://a.vn", RUST), (1, 2, 0.2, "b", "", None, "Món phở bò ngon ở phố cổ có từ lâu đời, ai cũng biết."), (1, 3, 0.1, "a", "Gỉ sắt", "http://a.vn", RUST),
        (2, 1, 0.07, "a", "Gỉ sắt", "http://a.vn", RUST),
        (4, 1, 0.3, "c", "Phở", "http://c.vn", "Món phở bò ngon ở phố cổ."),
        (5, 1, 0.3, "d", "Vùng trồng", "http://d.vn", "Đầu tư trồng cà phê tại Gia Lai và Lâm Đồng đang được nhiều tỉnh quan tâm."),
        (6, 1, 0.3, "d", "Vùng trồng", "http://d.vn", "Đầu tư trồng cà phê cần nhiều vốn, tỉnh nào cũng vậy thôi."),
        (7, 1, 0.15, "e", "Thu hoạch", "http://e.vn", HARVEST),
        (8, 1, 0.3, "f", "Gỉ sắt", "http://f.vn", "Bệnh gỉ sắt lá: phun 20 ml thuốc trừ nấm cho mỗi gốc cây trong vườn nhà."),
        (9, 1, 0.1, "g", "Gỉ sắt", "http://g.vn", RUST),
        (10, 1, 0.3, "h", "Gỉ sắt", "http://h.vn", long),
    ]
    asked = spark.createDataFrame(asked, "query_id long, question string")
    hits = spark.createDataFrame(hits, "query_id long, place long, score double, source_id string, title string, url string, text string").join(asked, "query_id")
    return {r.query_id: r for r in R.batch_answers(asked, hits.repartition(3), PLACES).collect()}


def test_an_answer_cites_what_is_relevant(said):
    want = "\n".join([R.FROM_SOURCES, "- Bệnh gỉ sắt lá cà phê lây lan nhanh trong mùa mưa.", "- Cần tỉa cành cho vườn thông thoáng để giảm độ ẩm.", *["- Bệnh gỉ sắt lá cà phê lây lan nhanh trong mùa mưa.", "- Cần tỉa cành cho vườn thông thoáng để giảm độ ẩm."], R.AFTER_SUMMARY])
    assert tuple(said[1]) == (1, "answer", "cao", "a", f"{want}\n\n{A.DISCLAIMER}")


def test_ways_out(said):
    assert tuple(said[2])[1:] == ("no_hit", "thap", "", R.NO_SOURCES)  # a weak hit
    assert tuple(said[3])[1:] == ("no_hit", "thap", "", R.NO_SOURCES)  # none
    assert tuple(said[4])[1:] == ("off_topic", "thap", "", R.OFF_TOPIC)
    assert tuple(said[8])[1:] == ("guarded", "cao", "f", f"{R.GUARDED}\n\n{A.DISCLAIMER}")
    assert said[9].way == "answer" and said[9].confidence == "thap"  # a question without words
    # what was found has no sentence that is long enough
    assert tuple(said[10])[1:] == ("answer", "cao", "h", f"{R.NO_SOURCES}\n\n{A.DISCLAIMER}")


def test_where_to_invest_is_not_answered(said):
    assert tuple(said[5])[1:4] == ("site", "trung_binh", "d") and "nhắc tới Gia Lai, Lâm Đồng, nhưng" in said[5].answer
    assert tuple(said[6])[1:4] == ("site", "thap", "d") and R.NO_PLACES in said[6].answer and A.DISCLAIMER not in said[6].answer


def test_before_harvest_there_is_a_checklist(said):
    lines = said[7].answer.split("\n")
    assert said[7].confidence == "trung_binh" and lines[0] == R.BEFORE_HARVEST and lines[-3:] == [R.AFTER_CHECKLIST, "", A.DISCLAIMER]
    assert [line[:12] for line in lines[1:-3]] == ["- Kiểm tra v", "- Theo dõi t", "- Chuẩn bị s"]


def test_answers_do_not_depend_on_empty_tables(spark, said):
    asked = spark.createDataFrame([(1, "Bệnh gì?")], "query_id long, question string")
    hits = spark.createDataFrame([], "query_id long, place long, score double, source_id string, title string, url string, text string, question string")
    assert [r.way for r in R.batch_answers(asked, hits, PLACES).collect()] == ["no_hit"]
    assert R.batch_answers(asked.limit(0), hits, PLACES).collect() == []


def test_context_is_cleaned(spark):
    clean = lambda text: one(spark, A.clean_context(F.col("t")), t=text)
    assert clean("Nguồn: web\nURL/File: x\nNội dung:\n - Lá  vàng\tvà  rụng :\n\n\n\nHết –") == "Lá vàng và rụng\n\nHết"
    for line in ("H2: x", "Hình 3", "Bài 4", "STT tên", "Toggle menu", "(phút)", "Chương 1.....15", "1.4.1 Yêu cầu", "ThS. Hoàng", "4 - TS", "báo cáo - FAO", "Viện trưởng WASI", "Trang 15", "kỹ thuật cHUẩn", "nhƣ thế", "l ực lượng"):
        assert clean(f"trước\n{line}\nsau") == "trước\nsau", line
    assert clean("Trang trại\nstthoai\nmenuet") == "Trang trại\nstthoai\nmenuet"
    long = "l ực " + "câu dài đọc được vẫn giữ lại " * 12
    assert clean(long) == long.strip() and clean("") == ""


def test_excuses_and_scrubbing(spark):
    tail = "Phần còn lại của câu trả lời rất dài. " * 8
    without = lambda a, s: one(spark, A.without_excuse(F.col("a"), F.col("s").cast("double")), a=a, s=s)
    but = f"Hiện chưa có đủ tài liệu để nói. Tuy nhiên, {tail}"
    assert without(but, "0.2") == f"{A.INSTEAD[0]}{tail}" and without(but, "0.1") == but and without(but, None) == but
    assert without(f"HIỆN CHƯA ĐỦ tài liệu.\n\n{tail}", "0.2") == f"{A.INSTEAD[1]}{tail}" and without("Hiện chưa có đủ tài liệu.", "0.9") == "Hiện chưa có đủ tài liệu."
    scrubbed = one(spark, A.scrub(F.col("a"), F.col("q")), a=f"Bón atau tưới DAN tỉa, danh mục\nmua Sa Kali\nphân hoặc nucafe, vôi\nhồ tiêu\n{A.DISCLAIMER}\n{A.DISCLAIMER.upper()}", q="Cà phê?")
    assert scrubbed == f"Bón hoặc tưới và tỉa, danh mục\nphân, vôi\n\n{A.DISCLAIMER}"
    assert one(spark, A.scrub(F.col("a"), F.col("q")), a="hồ tiêu", q="Cà phê?") == A.DISCLAIMER
    assert one(spark, A.has_other_script(F.col("a")), a="có 茶") and not one(spark, A.has_other_script(F.col("a")), a="trà")


def test_paragraphs_are_chosen_under_a_budget():
    text = "\n\n".join(["Không liên quan gì đến điều được hỏi ở đây.", "Bệnh gỉ sắt lá lây lan khi trời mưa nhiều.", "Bệnh gỉ sắt lá lây lan khi trời mưa nhiều.", "ngắn", "Trang 15 bệnh gỉ sắt lá và các bệnh khác nữa", "Bài giảng tập huấn về bệnh gỉ sắt lá cho học viên TOT", "Bệnh trên lá thường gặp ở vườn rậm rạp, ẩm thấp."])
    got = R.relevant_text(text, "bệnh gỉ sắt lá lây lan").split("\n")
    # one word of the question counts; training material comes last but for what says nothing on it; repeats and page numbers go
    assert [x[:10] for x in got] == ["Bệnh gỉ sắ", "Bệnh trên ", "Bài giảng ", "Không liên"]
    assert R.relevant_text("ngắn", "x") == "ngắn" and R.relevant_text("", "x") == "" and len(R.relevant_text("a" * 2000, "x", 100)) == 100


def test_selection_by_brute_force():
    """All paragraphs in the order of their rank; each is taken if it fits, until there is enough."""
    r = random.Random(3)
    words = ["benh", "vuon", "canh", "tuoi", "nuoc", "dat", "cay", "gion"]
    for _ in range(200):
        paragraphs = [" ".join(r.choice(words) for _ in range(r.randint(6, 30))) for _ in range(r.randint(1, 9))]
        question, most = " ".join(r.sample(words, 3)), r.choice((60, 150, 400))
        asked = [w for w in question.split() if len(w) >= 4]
        order = sorted(range(len(paragraphs)), key=lambda i: (-sum(w in paragraphs[i] for w in asked), len(paragraphs[i]), i))
        fits, size = [], 0
        for i in (i for i in order if len(paragraphs[i]) >= 30):
            line = R.compact(paragraphs[i])
            if line not in fits and (not fits or size + len(line) + 2 <= most):
                size += len(line) + 2 * bool(fits)
                fits.append(line)
                if size >= 0.7 * most or len(fits) == 4:
                    break
        assert R.relevant_text("\n\n".join(paragraphs), question, most) == ("\n".join(fits) or "\n\n".join(paragraphs))[:most]


def test_compact_is_the_same_as_an_expression(spark):
    cases = ["", "  - a  b : ", "Toggle nav H2: x", "Menu", "xem thêm H12 : Hình 3: y", "NỘI DUNG CHÍNH – z", "từ " * 90, "x" * 230, "menuet H2x Hình: 3", "toggle" + " w" * 120]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", R._compact(F.col("c")).alias("x")).collect()
    assert {r.i: r.x for r in rows} == dict(enumerate(map(R.compact, cases)))
    assert all(len(x) <= 220 for x in itertools.chain([r.x for r in rows]))

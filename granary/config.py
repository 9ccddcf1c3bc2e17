"""Lexicons, patterns and policies. All of them are parameters; these are the defaults of the farming domain.

Patterns work on lower-case text and spell word borders out, so that they mean the same in every
regular-expression dialect: a border is the start, the end, or a character that is no
letter, digit or underscore.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WORD = r"[\p{L}\p{N}_]"


def any_of(terms, borders: bool = False) -> str:
    """A pattern that finds any of the terms, as whole words if asked for."""
    body = "|".join(re.escape(t) for t in terms)
    return rf"(^|[^\p{{L}}\p{{N}}_])({body})($|[^\p{{L}}\p{{N}}_])" if borders else f"({body})"


# fixed values: categories with their terms, in order of precedence
CATEGORIES = {
    "dieu_kien_san_xuat": ("Điều kiện sản xuất", ("đất", "nước", "khí hậu", "địa hình", "vùng trồng", "độ cao", "thổ nhưỡng")),
    "thiet_lap_vuon": ("Thiết lập vườn trồng", ("vườn ươm", "làm đất", "mật độ", "trồng mới", "che bóng", "khoảng cách", "thiết lập vườn")),
    "cham_soc_dinh_duong": ("Chăm sóc & dinh dưỡng", ("bón phân", "phân bón", "bổ sung dinh dưỡng", "dinh dưỡng", "tưới", "tỉa cành", "tạo tán", "quản lý cỏ", "cải tạo đất", "thiếu đạm", "thiếu lân", "thiếu kali")),
    "bao_ve_cay_trong": ("Bảo vệ cây trồng", ("bệnh", "sâu", "nấm", "tuyến trùng", "rệp", "mọt", "vàng lá", "héo", "rụng lá", "phòng ngừa", "xử lý")),
    "giong_tai_canh": ("Giống & tái canh", ("giống", "chọn giống", "cây giống", "tr4", "trs1", "ghép", "tái canh", "vườn già", "cải tạo")),
    "thu_hoach_sau_thu_hoach": ("Thu hoạch & sau thu hoạch", ("thu hoạch", "trái chín", "sơ chế", "phơi", "sấy", "bảo quản", "phân loại", "lỗi hạt")),
    "quan_tri_kinh_te_tieu_chuan": ("Quản trị, kinh tế & tiêu chuẩn", ("chi phí", "kinh tế", "năng suất", "sop", "dữ liệu", "tiêu chuẩn", "vietgap", "4c", "bao tiêu", "xuất khẩu")),
    "khac_lien_quan": ("Khác liên quan", ("khác", "vấn đề khác", "tổng quan", "kinh nghiệm", "khuyến nghị", "rủi ro", "tư vấn", "câu hỏi chung")),
    "giao_tiep_nguoi_dung": ("Giao tiếp", ("chào", "cảm ơn", "tạm biệt", "bạn là ai", "hướng dẫn", "hỗ trợ", "không liên quan", "ngoài phạm vi")),
}
FALLBACK_CATEGORY = "khac_lien_quan"

# fixed values: topics and regions of the coverage reports
TOPICS = {
    "production_conditions": ("đất", "nước", "khí hậu", "địa hình", "vùng trồng", "độ cao", "thổ nhưỡng"),
    "garden_setup": ("vườn ươm", "làm đất", "mật độ", "trồng mới", "che bóng", "khoảng cách"),
    "nutrition": ("bón phân", "phân bón", "dinh dưỡng", "tưới", "tỉa cành", "tạo tán", "cải tạo đất"),
    "plant_protection": ("bệnh", "sâu", "nấm", "tuyến trùng", "rệp", "mọt", "vàng lá", "phòng ngừa"),
    "varieties": ("giống", "chọn giống", "cây giống", "ghép", "tái canh", "vườn già", "cải tạo"),
    "post_harvest": ("thu hoạch", "trái chín", "sơ chế", "phơi", "sấy", "bảo quản", "phân loại"),
    "standards": ("chi phí", "kinh tế", "năng suất", "tiêu chuẩn", "vietgap", "4c", "bao tiêu", "xuất khẩu"),
}
REGIONS = {
    "Tây Nguyên": ("tây nguyên", "đắk lắk", "dak lak", "đắk nông", "dak nong", "gia lai", "lâm đồng", "lam dong", "kon tum"),
    "Tây Bắc": ("tây bắc", "son la", "sơn la", "điện biên", "dien bien", "lai châu", "lai chau"),
    "Đông Nam Bộ": ("đông nam bộ", "dong nam bo", "bình phước", "binh phuoc", "đồng nai", "dong nai"),
}

# fixed values: letters with Vietnamese accents, and lines of little value
VIETNAMESE = "[ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]"
NOISE_LINE = "|".join(
    any_of(x, True)
    for x in (
        ("hotline", "email", "địa chỉ", "website", "zalo", "facebook"),
        ("đặt hàng", "mua ngay", "giỏ hàng", "sản phẩm liên quan"),
        ("copyright", "all rights reserved"),
    )
)
BAD_ENCODING = "(Ã|Æ|áº|á»|Ä|Â)"
COMMERCIAL = "|".join(
    any_of(x, True)
    for x in (
        ("công ty", "tnhh", "chemical", "hóa chất", "thuốc bvtv", "mua ngay", "đặt hàng", "sản phẩm", "hotline", "zalo"),
        ("thuốc trừ", "đại lý", "bảng giá", "giá bán", "khuyến mãi", "liên hệ mua", "tư vấn sản phẩm"),
    )
)

# fixed values of the domain phrases that lift a hit
DOMAIN_PHRASES = {
    "bon phan": 0.55, "tuoi nuoc": 0.45, "tao tan": 0.45, "tia canh": 0.45, "thu hoach": 0.45, "chon giong": 0.45, "tai canh": 0.45,
}
SEARCH_STOPWORDS = (
    "cách", "cho", "cây", "như", "thế", "nào", "với", "theo", "của", "trong", "ngoài", "phần", "giúp", "tăng", "rõ", "rệt",
    "nghi", "nên", "nen", "khi",
)
# fixed values: words of a question that say nothing about its topic, as written and folded
CHAT_STOPWORDS = (
    "cách", "bón", "phân", "cho", "cây", "như", "thế", "nào", "theo", "trong", "cà", "phê", "coffee", "thông", "tin", "dựa", "trên", "tài",
    "liệu", "truy", "xuất", "điều", "kiện",
)
FOLDED_STOPWORDS = ("mot", "cac", "nhung", "neu", "nen", "duoc", "khong", "hien", "he", "thong", "ket", "luan", "tham", "khao")
# fixed values: what questions on varieties and on diseases hold, and what a text on harvest must hold
SEED_TERMS = ("giong", "lua", "chon", "tr4", "trs1", "cay con", "tai canh", "ghep")
DISEASE_TERMS = ("than", "thu", "gi", "sat", "dom", "mat", "cua", "sau", "benh", "nam", "tuyen", "trung")
BEFORE_HARVEST_TERMS = ("truoc thu hoach", "ve sinh vuon", "ty le qua chin", "san phoi", "thu hai")
HARVEST_TERMS = ("thu hoach", "qua chin", "che bien", "bao quan", "san phoi")
# fixed values: triggers in a folded context, and the item that they put on the checklist before harvest
HARVEST_CHECKLIST = (
    (("ve sinh dong ruong", "ve sinh vuon cay", "kiem tra vuon cay"), "Kiểm tra vườn cây và vệ sinh đồng ruộng trước khi vào đợt hái."),
    (("ty le qua chin", "qua chin", "thu hai"), "Quan sát tỷ lệ quả chín để lên kế hoạch thu hái đúng thời điểm."),
    (("tinh hinh thoi tiet", "thoi tiet"), "Theo dõi thời tiết để bố trí ngày hái và tránh ảnh hưởng đến chất lượng quả."),
    (("san phoi", "che bien", "phoi qua"), "Chuẩn bị sân phơi, khu vực chế biến và điều kiện làm khô quả ngay sau thu hoạch."),
    (("canh la", "tap chat", "qua xanh"), "Lượm sạch cành lá, quả xanh và tạp chất lẫn trong quả sau khi thu hái."),
)
RELIABILITY_BOOST = {"official": 0.45, "semi_official": 0.22, "manual": 0.12}


@dataclass(frozen=True)
class Policy:
    """What makes a source trustworthy, and what may be indexed (fixed default values)."""

    official: tuple[str, ...] = (
        "khuyennongvn.gov.vn", "khuyennongdaklak.com.vn", "wasi.org.vn", "wasiv.org.vn", "vaas.vn", "vista.gov.vn",
        "mard.gov.vn", "tieuchuan.vsqi.gov.vn", "moit.gov.vn", "fao.org", "ico.org", "worldcoffeeresearch.org", "cgiar.org",
    )
    semi_official: tuple[str, ...] = (
        "vov.vn", "vov1.vov.vn", "tapchicongthuong.vn", "nongnghiep.vn", "coffee.org.vn", "sca.coffee",
        "rainforest-alliance.org", "4c-services.org",
    )
    low_trust: tuple[str, ...] = (
        "shopee.vn", "lazada.vn", "tiki.vn", "facebook.com", "youtube.com", "youtu.be", "tiktok.com",
    )
    official_tokens: tuple[str, ...] = ("gov.vn", "mard.gov", "khuyennong", "vaas.vn", "wasiv", "vista.gov.vn", "ispae.vn")
    semi_official_tokens: tuple[str, ...] = (
        ".edu", ".edu.vn", ".org", "tapchi", "researchgate", "vusta", "vov.vn", "vov1.vov.vn",
    )
    low_trust_tokens: tuple[str, ...] = (
        "qatarchemical", "qatar-chemical", "tuongnguyen", "sahari", "phanboncanada", "phanbonmiennam", "abachemical",
        "mekongagri", "kvf.vn", "vietcropchem", "hoachat", "shopee", "lazada", "tiki.vn",
    )
    social_tokens: tuple[str, ...] = ("facebook.com", "youtube.com", "youtu.be", "tiktok.com")
    critical: tuple[str, ...] = (
        "possible_vietnamese_encoding_error", "low_trust_commercial_domain", "commercial_or_vendor_content",
        "too_much_text_removed", "possible_boilerplate_or_marketing_noise", "high_duplicate_lines",
        "social_source_too_short_for_rag", "cleaned_text_too_short",
    )
    high_risk: tuple[str, ...] = (
        "possible_vietnamese_encoding_error", "low_trust_commercial_domain", "commercial_or_vendor_content",
        "too_much_text_removed", "possible_boilerplate_or_marketing_noise", "high_duplicate_lines",
    )
    min_quality: float = 0.65
    penalties: dict[str, float] = field(
        default_factory=lambda: {
            "low_trust_commercial_domain": 0.45,
            "commercial_or_vendor_content": 0.32,
            "possible_vietnamese_encoding_error": 0.22,
            "social_source_too_short_for_rag": 0.2,
        }
    )
    reliability_penalty: dict[str, float] = field(
        default_factory=lambda: {"official": 0.0, "semi_official": 0.08, "manual": 0.05, "internet": 0.22}
    )


POLICY = Policy()

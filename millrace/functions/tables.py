"""Word lists and patterns of the questions and brochures that the rules read, as plain data; operators take other tables the same way."""

from __future__ import annotations

# What a question is about, by the words in it; an empty tuple means every category.
TOPIC_CATEGORIES = (
    ("sạc", ("battery",)), ("pin", ("battery",)), ("charge", ("battery",)), ("kwh", ("battery",)), ("range", ("battery",)), ("phạm vi", ("battery",)), ("đi được", ("battery",)), ("quãng đường", ("battery",)),
    ("công suất", ("powertrain",)), ("power", ("powertrain",)), ("torque", ("powertrain",)), ("mô-men", ("powertrain",)), ("xoắn", ("powertrain",)), ("tốc độ", ("powertrain",)), ("tăng tốc", ("powertrain",)), ("acceleration", ("powertrain",)), ("drivetrain", ("powertrain",)),
    ("kích thước", ("dimension",)), ("chiều dài", ("dimension",)), ("chiều rộng", ("dimension",)), ("chiều cao", ("dimension",)), ("trọng lượng", ("dimension",)), ("wheelbase", ("dimension",)),
    ("túi khí", ("safety",)), ("airbag", ("safety",)), ("phanh", ("safety",)), ("abs", ("safety",)), ("esc", ("safety",)), ("an toàn", ("safety",)),
    ("adas", ("adas",)), ("cruise", ("adas",)), ("lane", ("adas",)), ("collision", ("adas",)), ("aeb", ("adas",)), ("blind spot", ("adas",)), ("parking", ("adas",)),
    ("nội thất", ("interior",)), ("ghế", ("interior",)), ("chỗ ngồi", ("interior",)), ("số chỗ", ("interior",)), ("màn hình", ("interior",)), ("loa", ("interior",)), ("điều hòa", ("interior",)), ("hud", ("interior",)), ("display", ("interior",)), ("cửa sổ trời", ("interior",)), ("kính trần", ("interior",)), ("sunroof", ("interior",)), ("panoramic", ("interior",)),
    ("ngoại thất", ("exterior",)), ("đèn", ("exterior",)), ("mâm", ("exterior",)), ("wheel", ("exterior",)), ("la-zăng", ("exterior",)), ("headlight", ("exterior",)),
    ("giá", ("price",)), ("price", ("price",)),
    ("phiên bản", ()), ("version", ()), ("so sánh", ()), ("compare", ()),
    ("tính năng", ("adas", "interior", "exterior", "safety", "infotainment")), ("trang bị", ("adas", "interior", "exterior", "safety", "infotainment")),
)

# The specification that a question asks for, in the order of trial.
SPEC_KEYS = (
    ("sunroof_type", r"cửa\s*sổ\s*trời|kính\s*trần|\bsunroof\b|\bpanoramic\b"),
    ("airbags", r"túi\s*khí|\bairbag\b"),
    ("power_kw", r"công\s*suất|mã\s*lực"),
    ("torque_nm", r"mô[\s-]*men|\btorque\b"),
    ("range_km", r"quãng\s*đường|đi\s*được|phạm\s*vi|\brange\b|tầm\s*di\s*chuyển"),
    ("battery_kwh", r"dung\s*lượng\s*pin|pin"),
    ("fast_charge_min", r"sạc\s*nhanh|thời\s*gian\s*sạc|sạc\s*chậm|sạc\s*đầy"),
    ("acceleration_0_100_s", r"tăng\s*tốc|0\s*[-–]\s*100"),
    ("top_speed_kmh", r"tốc\s*độ\s*tối\s*đa|vận\s*tốc"),
    ("drivetrain", r"dẫn\s*động|\bawd\b|\bfwd\b|\brwd\b|cầu\s*trước|cầu\s*sau"),
    ("length_mm", r"chiều\s*dài|dài\s*bao\s*nhiêu"),
    ("width_mm", r"chiều\s*rộng|rộng\s*bao\s*nhiêu"),
    ("height_mm", r"chiều\s*cao|cao\s*bao\s*nhiêu"),
    ("wheelbase_mm", r"trục\s*cơ\s*sở|\bwheelbase\b"),
    ("ground_clearance_mm", r"khoảng\s*sáng\s*gầm"),
    ("curb_weight_kg", r"trọng\s*lượng|cân\s*nặng"),
    ("seats", r"số\s*chỗ|chỗ\s*ngồi|mấy\s*chỗ|bao\s*nhiêu\s*chỗ|5\s*chỗ|7\s*chỗ"),
    ("head_up_display", r"\bhud\b"),
    ("surround_view_camera", r"camera\s*360|camera\s*toàn\s*cảnh"),
    ("leatherette_seats", r"ghế\s*da"),
    ("speakers", r"\bloa\b|số\s*loa|dàn\s*loa"),
    ("display_inch", r"màn\s*hình"),
    ("ac_type", r"điều\s*hòa"),
    ("trunk_capacity", r"dung\s*tích\s*cốp|cốp"),
    ("wheel_size_inch", r"mâm|la[\s-]*zăng"),
)

# Words that don't make a citation relevant.
COMMON_WORDS = ("xe", "của", "và", "là", "cho", "tôi", "bạn")

# Phrases of brochure disclaimers, without accents.
DISCLAIMERS = (
    "mot so tinh nang se chua co san",
    "chua duoc kich hoat tai thoi diem giao xe",
    "se duoc cap nhat phan mem tu xa",
    "quang duong di chuyen duoc tinh toan dua tren",
    "quang duong di chuyen thuc te co the giam",
    "phu thuoc vao toc do lai xe, nhiet do, dia hinh",
    "de dam bao an toan, toi uu tuoi tho",
    "khuyen cao nguoi su dung cac dong xe dien",
    "chi nen su dung pin chinh hang",
    "hinh anh mang tinh chat minh hoa",
    "khac so voi xe thuc te",
)
# Two phrases that make a disclaimer together, headings that a table leaves behind, and the last page number.
DISCLAIMER_PAIR = ("thong so ky thuat", "co the thay doi")
TABLE_HEADINGS = r"^(thông số kỹ thuật|kích thước|màn hình và kết nối|tính năng điều khiển thông minh)"
FOOTNOTES = r"^\*{1,2}\s*Phiên bản|^\(\*\)"
LAST_PAGE = 60

# Letters of other scripts that scanned text has for Latin ones.
LOOKALIKES = ("ОоАаНнСсЕеРрТтХхМмВвКкІіЅѕУуДдИиПпГгЛлЁё", "OoAaHhCcEePpTtXxMmBbKkIiSsYyDdNnPnrrJjEe")
LIGATURES = (("Æ", "AE"), ("æ", "ae"))

# Other names of specification keys.
KEY_ALIASES = (
    ("head_up_display", ("hud", "head-up")),
    ("surround_view_camera", ("camera 360", "camera360")),
    ("adaptive_cruise_control", ("acc",)),
    ("anti_lock_braking_system", ("abs",)),
    ("electronic_stability_control", ("esc",)),
    ("traction_control", ("tcs",)),
    ("hill_start_assist", ("hsa",)),
    ("autonomous_emergency_braking", ("aeb",)),
)

# The group of specifications that a question is about, in the order of trial; no group means all of them.
SPEC_GROUPS = (
    ("battery", r"thời\s*gian\s*sạc|sạc\s*nhanh|sạc\s*chậm|sạc\s*đầy|nạp\s*pin|dung\s*lượng\s*pin|dung\s*lượng|quãng\s*đường|đi\s*được|phạm\s*vi|tầm\s*di\s*chuyển|tầm\s*hoạt\s*động|\brange\b|pin|\bkwh\b|\bsạc\b|10\s*[-–]\s*70|10\s*%\s*[-–]\s*70"),
    ("powertrain", r"công\s*suất|mã\s*lực|mô[\s-]*men|\btorque\b|tăng\s*tốc|0\s*[-–]\s*100|tốc\s*độ\s*tối\s*đa|vận\s*tốc|dẫn\s*động|\bawd\b|\bfwd\b|\brwd\b|động\s*cơ|\bmotor\b|\bhp\b|\bkw\b|cầu\s*trước|cầu\s*sau|2\s*cầu"),
    ("dimension", r"kích\s*thước|chiều\s*dài|chiều\s*rộng|chiều\s*cao|khoảng\s*sáng\s*gầm|trục\s*cơ\s*sở|\bwheelbase\b|trọng\s*lượng|cân\s*nặng|dung\s*tích\s*cốp|thể\s*tích\s*cốp|khoang\s*hành\s*lý"),
    ("safety", r"túi\s*khí|\bairbag\b|phanh|\babs\b|\besc\b|an\s*toàn|cảnh\s*báo|camera\s*360|camera\s*lùi|kiểm\s*soát\s*lực\s*kéo|\btraction\b"),
    ("interior", r"cửa\s*sổ\s*trời|kính\s*trần|\bsunroof\b|\bpanoramic\b|nội\s*thất|ghế|số\s*chỗ|chỗ\s*ngồi|mấy\s*chỗ|bao\s*nhiêu\s*chỗ|5\s*chỗ|7\s*chỗ|màn\s*hình|\bloa\b|âm\s*thanh|điều\s*hòa|vô\s*lăng|\bhud\b|sạc\s*không\s*dây|cửa\s*gió|thông\s*gió|sưởi"),
    ("exterior", r"ngoại\s*thất|đèn|mâm|la[\s-]*zăng|gương|kiểu\s*dáng|màu\s*sơn|cốp|cửa\s*hít|cửa\s*hút"),
    ("adas", r"\badas\b|\bcruise\b|ga\s*tự\s*động|giữ\s*làn|\blane\b|va\s*chạm|\bcollision\b|\baeb\b|điểm\s*mù|blind\s*spot|đỗ\s*xe|\bparking\b|cao\s*tốc|tắc\s*đường|biển\s*báo|hỗ\s*trợ\s*lái"),
    ("security", r"chống\s*trộm|\bimmobilizer\b|khóa\s*điện\s*tử|định\s*vị\s*xe"),
    ("chassis", r"hệ\s*thống\s*treo|khung\s*gầm|chassis|đánh\s*lái|trợ\s*lực\s*lái"),
    (None, r"tiện\s*nghi|giải\s*trí|kết\s*nối|trợ\s*lý\s*ảo|\bapp\b|điều\s*khiển\s*từ\s*xa|gọi\s*thoại|cập\s*nhật\s*phần\s*mềm|có\s*những\s*tính\s*năng|tính\s*năng\s*nổi\s*bật|trang\s*bị"),
)

# What a question wants, in the order of trial; greetings and thanks only where nothing else is said.
QUESTION_INTENTS = (
    ("greeting", r"^(xin\s*chào|chào\s*buổi\s*(sáng|trưa|chiều|tối)|chào|hello|hi|helo|alo|hế\s*lô)(\s*(bạn|em|ad|admin|mình|nhé|nha))?[\s!.,?~😊👋❤️]*$"),
    ("thanks", r"^(cảm\s*ơn|cám\s*ơn|cam\s*on|thank\s*you|thanks|tks|tạm\s*biệt|bye|bai\s*bai)(\s*(bạn|em|ad|admin|mình|so\s*much|a\s*lot))?(\s*(nhé|nha|ạ|nhiều|rất\s*nhiều))?[\s!.,?~😊👋❤️]*$"),
    ("identity", r"bạn\s*là\s*ai|bạn\s*tên\s*gì|bạn\s*giúp\s*được\s*gì|chức\s*năng\s*(của\s*bạn|gì)|giới\s*thiệu\s*bản\s*thân|em\s*là\s*ai"),
    ("utility", r"showroom|trạm\s*sạc|đại\s*lý|cửa\s*hàng|chi\s*nhánh|lái\s*thử|test\s*drive|đăng\s*ký\s*lái|đặt\s*lịch|booking|lịch\s*hẹn|trả\s*góp|vay|thẩm\s*định|lăn\s*bánh|đăng\s*ký\s*xe|khuyến\s*mãi|ưu\s*đãi|voucher|hotline|liên\s*hệ|gặp\s*sales|lịch\s*bảo\s*dưỡng"),
    ("price", r"giá|bao\s*nhiêu\s*tiền|hết\s*bao\s*nhiêu|mua.*bao\s*nhiêu|đắt\s*không|rẻ\s*không|chi\s*phí.*mua"),
    ("compare", r"so\s*sánh|so\s*sanh|\bvs\b|versus|hơn\s*kém|khác\s*gì|tốt\s*hơn|hay\s*hơn|đáng\s*mua|nên\s*mua|giữa\s*.*và"),
    ("cross_model_feature", r"xe\s*nào\s*có|những\s*xe.*có|model\s*nào\s*có|dòng\s*nào\s*có|có\s*trên\s*những\s*xe|có\s*trên\s*xe\s*nào"),
    ("feature_presence", r"có\s+[^?]{1,80}\s+(không|ko|hả|nhỉ)\s*\??|liệu\s+[^?]{1,60}\s+có\s+.*\?|[^?]{1,60}\s+có\s+(không|ko)\s*\??"),
    ("models_list", r"những\s*xe|danh\s*sách\s*xe|các\s*mẫu\s*xe|mấy\s*loại\s*xe|đang\s*bán\s*những|có\s*những\s*xe\s*nào"),
    ("versions_list", r"có\s+mấy\s+phiên\s+bản|những\s+phiên\s+bản|phiên\s+bản\s+nào|mấy\s+bản|edition|có\s+những\s+bản"),
    ("colors", r"màu\s*sắc|màu\s*ngoại\s*thất|màu\s*nội\s*thất|màu\s*gì|có\s*những\s*màu|màu\s*sơn"),
    ("policy", r"bảo\s*hành|bảo\s*dưỡng|chính\s*sách|điều\s*khoản|sửa\s*chữa|cứu\s*hộ|dịch\s*vụ\s*sau\s*bán|pháp\s*lý|hỗ\s*trợ\s*kỹ\s*thuật|đặt\s*cọc|đặt\s*coc"),
)
OUT_OF_SCOPE = r"thời\s*tiết|chứng\s*khoán|bóng\s*đá|chính\s*trị|tập\s*làm\s*thơ|kể\s*chuyện\s*cười|viết\s*code|viết\s*cho\s*tôi\s*.*code|code\s*python|thuật\s*toán|quicksort|dijkstra|nấu\s*món|công\s*thức\s*nấu|phở\s*bò|tổng\s*thống|hack\s*|bẻ\s*khóa|mật\s*khẩu\s*wifi"

# What an answer must not do: (words of the rule, of which each group needs one), (pattern that the answer must have), (one that it must lack), whether only an answer without evidence breaks it.
ANSWER_RULES = (
    ("default_choice", (("chọn",), ("mặc định", "default")), r"eco|plus", r"phiên bản|bản", False),
    ("mixed_cycles", (("trộn",), ("nedc", "wltp")), r"nedc.*wltp|wltp.*nedc", None, False),
    ("background", (("kiến thức nền", "kiến thức sẵn"),), None, None, True),
    ("guessed", (("không đoán",),), None, None, True),
    ("compared", (("không so sánh", "không lập bảng"),), r"so sánh|bảng|khác nhau|versus|\bvs\b", None, False),
    ("advised", (("không khuyên",),), r"nên mua|khuyên|gợi ý|chọn", None, False),
    ("made_up", (("không bịa",),), None, None, True),
    ("repair", (("chẩn đoán", "hướng dẫn sửa"),), r"bạn nên|cách sửa|thao tác|kiểm tra|thay thế", None, False),
)

# Sections and texts of pages that say nothing of a product, without accents; items of menus; and labels of specification tables.
JUNK_SECTIONS = ("dang ky thanh cong", "kiem tra email", "kiem tra email de kich hoat tai khoan", "doi mat khau thanh cong", "nhan bao gia uu dai moi nhat", "dich vu khach hang", "speak-up hotline", "speak up hotline", "tien ich", "mua sam", "theo doi")
JUNK_TEXT = r"icon-popup-success|se lien he tu van|mk\s*[0-9]+\s+hero banner|^\s*-\s*cong ty\s*-\s*o to dien\s*-\s*xe may dien\s*$|dang nhap\s*/\s*dang ky truoc khi mua hang|gia ban tu dat coc dang ky lai thu|cam on quy khach da quan tam|tra cuu tai lieu huong dan|checkbox label label\s+consent leg\.interest|dat lich sua chua\s+dat lich sua chua|doi mat khau thanh cong|thay doi thanh cong mat khau|tim showroom\s*&\s*tram sac.*cau hoi thuong gap|san pham dang cap, gia tot, chinh sach hau mai vuot troi"
MENU_ITEM = r"^-\s*(gia ban|gioi thieu|ngoai that|noi that|thong so|tinh nang|tong quan|thiet ke|van hanh|an toan|uu dai|cac phien ban)\s*$"
SPEC_LABELS = ("cong suat", "mo men", "mo-men", "dung luong pin", "loai pin", "quang duong", "tai trong", "trong luong", "chieu dai co so", "chieu dai", "chieu rong", "chieu cao", "khoang sang", "co so", "toc do toi da", "tang toc", "so cho ngoi", "cho ngoi", "dan dong", "he thong treo", "treo truoc", "treo sau", "thoi gian nap", "sac day", "sac nhanh", "khoang chua hanh ly")

# Names of editions and what they are listed as.
EDITIONS = (
    ("eco", "Eco"), ("bản eco", "Eco"), ("ban eco", "Eco"), ("plus", "Plus"), ("bản plus", "Plus"), ("ban plus", "Plus"), ("tiêu chuẩn", "TieuChuan"), ("tieuchuan", "TieuChuan"), ("tiêu_chuẩn", "TieuChuan"), ("nâng cao", "NangCao"), ("nangcao", "NangCao"), ("cao cấp", "CaoCap"), ("caocap", "CaoCap"),
    ("pluscaptain", "PlusCaptain"), ("plus captain", "PlusCaptain"), ("the all new", "The All New"), ("all new", "The All New"), ("thenew", "The All New"), ("the new", "The All New"), ("new", "The All New"), ("thế hệ mới", "The All New"), ("the he moi", "The All New"), ("plus awd", "Plus AWD"), ("plusawd", "Plus AWD"),
)

# The link that a practical question wants, in the order of trial.
UTILITIES = (
    ("get_onroad_cost_link", r"lăn\s*bánh|onroad|đăng\s*ký\s*xe"),
    ("get_loan_estimate_link", r"trả\s*góp|vay|thẩm\s*định"),
    ("get_showroom_charging_link", r"showroom|trạm\s*sạc|đại\s*lý|chi\s*nhánh"),
    ("get_booking_link", r"đặt\s*lịch|booking|lịch\s*hẹn|test\s*drive|lái\s*thử"),
    ("get_maintenance_link", r"link\s*bảo\s*dưỡng|lịch\s*bảo\s*dưỡng"),
    ("get_active_promotions", r"khuyến\s*mãi|ưu\s*đãi|voucher"),
    ("get_showroom_charging_link", r"hotline|liên\s*hệ|gặp\s*sales"),
)

# The topic of a question, in the order of trial.
TOPICS = (
    ("pin_và_sạc", r"sạc\s*nhanh|sạc\s*chậm|sạc\s*đầy|thời\s*gian\s*sạc|trạm\s*sạc|charger|charging|ổ\s*điện|pin\s*(lithium|lipo|lfp)|dung\s*lượng\s*pin|sạc|nạp\s*pin|phút.*10.*70|10.*70.*phút"),
    ("phạm_vi_di_chuyển", r"đi\s*được\s*bao\s*xa|di\s*chuyển|range|phạm\s*vi|đi\s*được\s*bao\s*nhiêu\s*km|quãng\s*đường"),
    ("an_toàn", r"túi\s*khí|airbag|adas|phanh|abs|ebd|esc|collision|cảnh\s*báo|camera\s*lùi|camera\s*360|an\s*toàn|an\s*toàn\s*không|có\s*an\s*toàn"),
    ("nội_thất", r"nội\s*thất|ghế|số\s*chỗ|chỗ\s*ngồi|mấy\s*chỗ|5\s*chỗ|7\s*chỗ|màn\s*hình|loa|âm\s*thanh|điều\s*hòa|khoang\s*xe|vô\s*lăng|hud|leatherette|speaker|display"),
    ("ngoại_thất", r"ngoại\s*thất|đèn|màu\s*xe|mâm|la-zăng|gương|body|design|kiểu\s*dáng|headlight|tail\s*light|drl"),
    ("tính_năng_nổi_bật", r"tính\s*năng|trang\s*bị|công\s*nghệ|thông\s*minh|tiện\s*nghi|ota|navigation|bluetooth|apple\s*carplay|android\s*auto|gaming"),
    ("phiên_bản", r"phiên\s*bản|version|bản\s*nào|có\s*mấy\s*bản|danh\s*sách|khác\s*nhau\s*giữa"),
    ("kích_thước", r"kích\s*thước|chiều\s*dài|chiều\s*rộng|chiều\s*cao|trọng\s*lượng|wheelbase|không\s*gian|ốp\s*lưng|boot|cốp"),
    # "pin" counts where no "sạc" follows; texts with that word have had their topic before.
    ("thông_số_kỹ_thuật", r"công\s*suất|mô[\s-]*men|xoắn|tốc\s*độ|tốc\s*tối\s*đa|battery|kwh|pin|trọng\s*lượng|wheelbase|ground\s*clearance|power|torque|speed|km/h|nm|kw|thông\s*số|specs|spec|trọng\s*tải|tăng\s*tốc|gia\s*tốc|tốc\s*độ\s*tối\s*đa"),
    ("giá", r"giá\s*bao\s*nhiêu|giá\s*bán|giá\s*niêm\s*yết|bao\s*nhiêu\s*tiền|chi\s*phí|ưu\s*đãi|giá\s*(xe|mk)|price"),
)
# The tools that a topic allows; a topic that isn't here allows all.
TOPIC_TOOLS = (
    ("thông_số_kỹ_thuật", ("ask_clarification", "get_specs")), ("pin_và_sạc", ("ask_clarification", "get_specs")), ("phạm_vi_di_chuyển", ("ask_clarification", "get_specs")), ("an_toàn", ("ask_clarification", "get_specs")), ("nội_thất", ("ask_clarification", "get_specs")), ("ngoại_thất", ("ask_clarification", "get_specs")),
    ("tính_năng_nổi_bật", ("ask_clarification", "get_specs")), ("phiên_bản", ("ask_clarification", "get_specs", "list_available_models")), ("kích_thước", ("ask_clarification", "get_specs")), ("giá", ("ask_clarification", "get_price")),
)
# Words that point at a product without its name; intents that need no product; those that look at specifications, and at one of them.
POINTING = r"xe\s*này|mẫu\s*này|chiếc\s*này|em\s*này"
WITHOUT_MODEL = ("greeting", "thanks", "identity", "cross_model_feature", "models_list", "policy", "general", "utility", "out_of_scope")
WITH_GROUP, WITH_KEY = ("spec_query", "feature_presence", "cross_model_feature", "compare"), ("feature_presence", "cross_model_feature")
# How a question names an edition; the first place in the text counts, and there the first of these.
EDITION_NAMES = r"eco|plus|pluscaptain|plus\s*awd|ti[êe]u\s*chuẩ?n|tieuchuan|nâng\s*cao|nangcao|cao\s*cấ?p|caocap|thế\s*hệ\s*mới|the\s*he\s*moi|the\s*all\s*new|all\s*new|the\s*new|\bnew\b"

# Words and keys that belong together when a question is compared with a specification.
SPEC_WORDS = (
    ("công_suất", ("power_kw", "power", "công suất", "mã lực", "hp", "công suât")),
    ("mômen_xoắn", ("torque_nm", "torque", "mô-men", "mô men", "xoắn", "mo men")),
    ("tốc_độ", ("top_speed", "speed", "tốc độ", "tối đa", "tốc do")),
    ("pin", ("battery_kwh", "battery", "battery_heater", "pin", "dung lượng", "dung luong", "kwh", "gia nhiệt")),
    ("quãng_đường", ("range_km", "range", "quãng đường", "phạm vi", "di chuyển", "đi được", "bao xa", "bao nhiêu km", "sạc đầy", "một lần sạc", "autonomy")),
    ("sạc", ("charge", "sạc", "charging", "charger", "charge_management", "charger_map", "nạp pin", "thời gian sạc", "sạc nhanh", "sạc chậm", "phút", "10%", "70%", "quản lý sạc", "trạm sạc", "bản đồ sạc")),
    ("kích_thước", ("length_mm", "width_mm", "height_mm", "wheelbase_mm", "ground_clearance_mm", "length", "width", "height", "wheelbase", "ground_clearance", "kích thước", "chiều dài", "chiều rộng", "chiều cao", "khoảng sáng gầm", "dài", "rộng", "cao")),
    ("trọng_lượng", ("curb_weight_kg", "curb_weight", "trọng lượng", "nặng", "kg")),
    ("an_toàn", ("airbag", "abs", "ebd", "esc", "tcs", "hsa", "aeb", "collision", "túi khí", "an toàn", "phanh", "camera 360", "surround_view", "rearview", "parking", "blind_spot", "lane_keep", "lane_departure", "forward_collision", "emergency", "brake", "tpms", "rollover_mitigation", "isofix", "ảnh suất lốp", "chống lật", "ghế trẻ em")),
    ("nội_thất", ("seat", "ghế", "leatherette", "speaker", "loa", "màn hình", "display", "nội thất", "hud", "head-up", "khoang xe", "vô lăng", "điều hòa", "seats", "trunk_capacity", "trunk", "steering", "subwoofer", "cốp", "cabin_air_filter", "lọc không khí", "lọc bụi", "rear_ac_vents", "cửa gió", "loa trầm")),
    ("ngoại_thất", ("headlight", "đèn", "wheel", "la-zăng", "mâm", "mirror", "gương", "ngoại thất", "màu", "body", "design", "drl", "tail_light", "wheel_size_inch", "adaptive_headlights", "windshield", "kính chắn gió", "frunk_capacity", "privacy_glass", "kính tối màu", "cốp trước")),
    ("giá", ("price", "giá", "giá niêm yết", "ưu đãi", "giá bán")),
    ("adas", ("adas", "cruise", "lane", "blind_spot", "parking", "camera", "adasi", "highway", "traffic_jam", "lane_centering", "auto_lane_change", "hỗ trợ lái", "tự lái", "cấp")),
    ("phiên_bản", ("edition", "version", "phiên bản", "bản", "eco", "plus")),
    ("tính_năng", ("tính năng", "trang bị", "công nghệ", "thông minh", "tiện nghi", "ota", "navigation", "bluetooth", "carplay", "android", "gaming", "voice", "phone_app", "web_browser", "smartphone", "smart_key", "chìa khóa", "usb", "cổng sạc")),
    ("điều_hòa", ("ac_type", "điều hòa", "climate", "nhiệt độ", "lạnh", "máy lạnh")),
)

# What counts as a feature in an answer or its evidence, a negative claim, and talk of prices.
FEATURES = r"hud|head.?up|adas|aeb|acc|adaptive.?cruise|lane.?keep|lane.?depart|blind.?spot|collision|parking|camera|túi.?khí|airbag|abs|ebd|esc|tcs|hsa|cruise.?control|auto.?brake|emergency|surround|monitoring|điều.?hòa|ghế|màn.?hình|loa|đèn|cửa.?sổ|gương|vô.?lăng|pin|sạc|phạm.?vi|tốc.?độ|công.?suất|mô.?men|xoắn|quãng.?đường|nội.?thất|ngoại.?thất|an.?toàn|tiện.?nghi|thông.?minh|navigation|gaming|ota|browser|phone.?app|diagnosis|leatherette|speaker|drivetrain|suspension|brake|immobilizer|alarm|theft|massage|tự.?lái|lội.?nước|bán kính|quay.?vòng"
NEGATIVE = r"không\s*(có|được\s*trang\s*bị|hỗ\s*trợ|trang\s*bị)|chưa\s*(có|trang\s*bị)"
PRICE_TALK = r"gi[aá]|price|ni[eê]m\s+y[eế]t|[uư]u\s+[đd][ãa]i|vn[dđ]|tri[eệ]u|t[yỷ]|l[aă]n\s+b[aá]nh|tr[aả]\s+g[oó]p"
# Numbers that claim nothing: addresses, ranges, years in brackets, the series' own, cameras, degrees, shares.
NO_CLAIM = (r"https?://\S+", r"[0-9]+[-–][0-9]+", r"\([0-9]{4}\)", r"\bmk\s*[0-9]+\b", r"camera\s*[0-9]+", r"[0-9]+\s*độ", r"[0-9]+\s*%")

# Lines of pages and brochures that say nothing, matched from their beginning; letters of any case. A brand's own name after "Tìm xe" doesn't matter.
NOISE_LINES = (
    r"^Đăng nhập\s*/\s*Đăng ký$",
    r"^Banner top bar$",
    r"^Google tag \(gtag\.js\)$",
    r"^End Navigation$",
    r"^END BREADCRUMB$",
    r"^1\.\s*TRANG CHỦ\s*$",
    r"^\s*[0-9]+\.\s*(?:TRANG CHỦ|Trang chủ|Tin tức|Cộng đồng)\s*$",
    r"^Tìm xe ",
    r"^Nhập ít nhất 2 ký tự",
    r"^Chọn địa chỉ nhận hàng$",
    r"^Chọn Tỉnh/Thành",
    r"^Thay đổi địa chỉ khác$",
    r"^Hotline\s*[0-9]",
    r"^Quên mật khẩu\?$",
    r"^Share$",
    r"^\s*star \| Đã bán [0-9]+$",
    r"^\s*\* \* \*\s*$",
    r"^\s*---\s*$",
    r"^\s*#+$",
    r"^\s*\[.*\]\(.*\)\s*$",
    r"^\s*!\[.*\]\(.*\)\s*$",
    r"^\s*Đặt lịch\s*$",
    r"^\s*Đăng ký\s*$",
    r"^\s*\[if\s+[^\]]*\]\s*$",
    r"^\s*<!\[endif\]",
    r"^\s*\[endif\]\s*$",
    r"^\s*end\s+[\p{L}\p{N}_]+\s+category\s*$",
    r"^\s*end\s+title\s*$",
    r"^\s*Banner\s+top\s+bar\s*$",
    r"^\s*not found\s*$",
    r"^\s*Không tìm thấy kết quả phù hợp\s*$",
    r"^\s*Hãy thử lại với từ khoá khác\s*$",
    r"^\s*Chọn\s+[\p{L}\p{N}_]+\s*$",
    r"^[0-9.\s]{9,}$",
    r"^[0-9]{1,2}\s+[0-9]{2}-[0-9]{4}$",
    r"^\s*[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\s*$",
    r"^\s*Xin hãy gọi ngay.*$",
)
# A menu item that a text begins a line with, and what a table's heading leaves in prose; without accents the first, in lower case the second.
LEADING_ITEM = r"(^|\n)-\s*(gia ban|gioi thieu|ngoai that|noi that|thong so)\s*\n"
HEADING_RESIDUE = r"^(kích thước|tính năng|điều khiển thông minh)\s+mk\s+[0-9]+\s+(eco|plus)"
SPEC_SECTION = "thong so ky thuat"

# Specifications with their category, unit and the least and the greatest value that can be; and the drivetrains.
SPEC_RANGES = (
    ("length_mm", "dimension", "mm", 2000, 6000), ("width_mm", "dimension", "mm", 1000, 2500), ("height_mm", "dimension", "mm", 1000, 2200), ("wheelbase_mm", "dimension", "mm", 1500, 3500), ("ground_clearance_mm", "dimension", "mm", 100, 300),
    ("power_kw", "powertrain", "kW", 10, 600), ("torque_nm", "powertrain", "Nm", 30, 800), ("battery_kwh", "battery", "kWh", 10, 200), ("range_km", "battery", "km", 50, 1000), ("dc_charge_kw", "battery", "kW", 3, 350), ("seats", "interior", "", 2, 9),
)
DRIVETRAINS = ("FWD", "RWD", "AWD")

# Labels of specification keys in a context.
KEY_LABELS = (
    ("power_kw", "Công suất tối đa"), ("torque_nm", "Mô-men xoắn cực đại"), ("range_km", "Quãng đường di chuyển"), ("battery_kwh", "Dung lượng pin"), ("fast_charge_min", "Thời gian sạc nhanh (10%-70%)"), ("acceleration_0_100_s", "Tăng tốc 0-100 km/h"), ("top_speed_kmh", "Tốc độ tối đa"), ("drivetrain", "Dẫn động"),
    ("seats", "Số chỗ ngồi"), ("airbags", "Túi khí"), ("length_mm", "Dài"), ("width_mm", "Rộng"), ("height_mm", "Cao"), ("wheelbase_mm", "Chiều dài cơ sở"), ("ground_clearance_mm", "Khoảng sáng gầm"), ("curb_weight_kg", "Trọng lượng không tải"), ("wheel_size_inch", "Kích thước mâm"), ("trunk_capacity", "Dung tích cốp"),
    ("head_up_display", "Màn hình HUD"), ("surround_view_camera", "Camera 360"), ("leatherette_seats", "Ghế bọc da"), ("speakers", "Số loa"), ("display_inch", "Màn hình cảm ứng"), ("sunroof_type", "Cửa sổ trời"), ("wireless_charging", "Sạc không dây điện thoại"), ("ac_type", "Điều hòa"), ("cabin_air_filter", "Lọc không khí cabin"),
    ("rear_ac_vents", "Cửa gió điều hòa hàng ghế sau"), ("smart_key", "Chìa khóa thông minh"), ("subwoofer", "Loa trầm"), ("tpms", "Cảnh báo áp suất lốp"), ("usb_port_type_a", "Cổng USB-A"), ("usb_port_type_c", "Cổng USB-C"), ("isofix", "Móc ghế trẻ em ISOFIX"), ("windshield_type", "Kính chắn gió"),
    ("rollover_mitigation", "Hệ thống chống lật"), ("frunk_capacity_l", "Dung tích cốp trước"), ("privacy_glass", "Kính tối màu"), ("battery_heater", "Gia nhiệt pin"), ("charge_management", "Quản lý sạc"), ("charger_map", "Bản đồ trạm sạc"),
)

# Amounts with their units in brochures, and lines that hold nothing but one or the words around one; and how a question asks for a price.
AMOUNT, UNIT, STARS = r"(?:\d{1,3}(?:[.,]\d{3})+(?:\d{2})?|\d{6,})", r"(?:triệu|tr\b|tỷ|nghìn|đồng|VNĐ|VND|\bđ\b)", r"(?:\\?\*+)?"
PRICE_LEAD = r"(?:giá\s+(?:bán|niêm\s*yết|ưu\s*đãi|x)|đặt\s*cọc|lăn\s*bánh)\s*(?:từ|cho|và)?[^a-zà-ỹ]*"
PRICE_ASKED = r"giá|bao\s*nhiêu\s*tiền"

# Where a raw file goes, in the order of trial: (of an official host, of this kind, of a named product; what its address, its name or either has; collection, category, confidence, what it is). None: any.
RAW_ROUTES = (
    (True, None, None, "url", "dat-coc", "product_info", "thong_tin_san_pham", 1.0, "dat-coc"),
    (True, None, None, "url", "dich-vu-bao-duong", "maintenance", "dat_lich_bao_duong", 1.0, "service"),
    (True, None, None, "url", "dich-vu-pin|dich-vu-sua-chua|chinh-sach-bao-hanh|thong-tin-cuu-ho|ve-chung-toi|chinh-sach", "policy", "chinh_sach_dich_vu", 1.0, "policy"),
    (True, None, None, None, None, "product_info", "thong_tin_san_pham", 0.9, "other"),
    (None, "pdf", True, "either", "brochure", "product_info", "thong_tin_san_pham", 0.9, "brochure"),
    (None, "pdf", None, None, None, "policy", "chinh_sach_dich_vu", 0.9, "pdf-manual"),
    (None, None, None, "name", "so-sanh|bang-doi-chieu", "product_info", "thong_so_ky_thuat", 0.8, "comparison"),
    (None, None, None, "name", "thong-so-", "product_info", "thong_so_ky_thuat", 0.8, "specs-article"),
    (None, None, None, None, None, "product_info", "thong_tin_san_pham", 0.7, "article"),
)

# What follows a product's number when it is the renewed one.
RENEWED = r"(?:(?:the\s+)?(?:all\s+)?new|thế\s*hệ\s*mới|the\s*he\s*moi)"

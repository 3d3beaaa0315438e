"""Values written out by hand, so that a wrong pattern can't pass on both sides."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import decisions as D
from millrace.functions import questions as Q
from millrace.functions import rules
from millrace.functions import tables as T
from millrace.operators import evidence as E
from millrace.streaming import folds


def each(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, q string")
    return [r.x for r in rows.select("i", column(F.col("q")).alias("x")).orderBy("i").collect()]


CATEGORIES = {
    "battery": ["Thời gian sạc đầy pin là bao lâu?", "MK 8 sạc nhanh từ 10-70 mất bao nhiêu phút?", "Quãng đường đi được của xe là bao xa?", "Tầm di chuyển một lần nạp pin"],
    "powertrain": ["Công suất động cơ MK 8 là bao nhiêu mã lực?", "Mô men xoắn cực đại của xe?", "Thời gian tăng tốc 0-100 km/h mất mấy giây?", "Xe này dẫn động cầu trước hay AWD?"],
    "dimension": ["Kích thước dài rộng cao của MK 6?", "Khoảng sáng gầm xe là bao nhiêu mm?", "Dung tích cốp xe bao nhiêu lít?", "Trọng lượng xe MK 3"],
    "safety": ["Xe có mấy túi khí an toàn?", "Hệ thống phanh ABS và cân bằng điện tử ESC", "Xe có camera 360 độ không?"],
    "interior": ["MK 8 có cửa sổ trời toàn cảnh không?", "Xe có mấy chỗ ngồi?", "Màn hình giải trí bao nhiêu inch?", "Xe có hiển thị HUD trên kính lái không?"],
    "exterior": ["Hệ thống đèn LED phía trước", "Mâm xe la-zăng bao nhiêu inch?", "Gương chiếu hậu chỉnh điện"],
    "adas": ["Hệ thống hỗ trợ lái ADAS cấp độ mấy?", "Tính năng hỗ trợ giữ làn và điểm mù"],
    "security": ["Hệ thống chống trộm và định vị xe", "Khóa điện tử thông minh"],
    "chassis": ["Hệ thống treo trước và khung gầm", "Hệ thống trợ lực lái"],
    None: ["Các tính năng tiện nghi nổi bật", "Ứng dụng điều khiển từ xa qua app"],
}
SPECS = {
    "sunroof_type": "MK 8 có cửa sổ trời không?", "airbags": "Xe có bao nhiêu túi khí?", "power_kw": "Công suất động cơ bao nhiêu mã lực?", "torque_nm": "Mô men xoắn của xe là bao nhiêu?", "range_km": "Tầm di chuyển được bao nhiêu km?",
    "battery_kwh": "Dung lượng pin là bao nhiêu?", "fast_charge_min": "Thời gian sạc nhanh bao lâu?", "acceleration_0_100_s": "Khả năng tăng tốc 0-100 giây?", "top_speed_kmh": "Vận tốc tối đa của xe?", "drivetrain": "Xe dẫn động 2 cầu AWD hay FWD?",
    "length_mm": "Chiều dài xe bao nhiêu mm?", "width_mm": "Chiều rộng xe?", "height_mm": "Chiều cao của MK 6?", "wheelbase_mm": "Trục cơ sở xe?", "ground_clearance_mm": "Khoảng sáng gầm xe?", "curb_weight_kg": "Cân nặng trọng lượng xe?", "seats": "Xe có mấy chỗ ngồi?",
    "head_up_display": "Xe có HUD hiển thị kính lái không?", "surround_view_camera": "Có camera 360 toàn cảnh không?", "leatherette_seats": "Xe có ghế da không?", "speakers": "Hệ thống có mấy loa?", "display_inch": "Màn hình trung tâm bao nhiêu inch?", "ac_type": "Hệ thống điều hòa mấy vùng?",
    "trunk_capacity": "Dung tích cốp xe?", "wheel_size_inch": "Kích thước mâm xe la-zăng?", None: "Câu hỏi chung chung không có spec key",
}
INTENTS = {
    "greeting": ["Xin chào", "chào bạn", "Hi", "Chào buổi sáng!", "hello 😊"],
    "thanks": ["Cảm ơn bạn nhé", "Thank you", "Tạm biệt", "bye", "cảm ơn nhiều ❤️"],
    "identity": ["Bạn là ai?", "Giới thiệu bản thân", "Bạn có chức năng gì?"],
    "price": ["MK 8 giá bao nhiêu?", "Giá niêm yết của xe MK 3", "Mua xe hết bao nhiêu tiền?"],
    "compare": ["So sánh MK 6 và MK 7", "MK 8 vs MK 9 khác gì nhau?", "Nên mua MK 3 hay MK 5?"],
    "cross_model_feature": ["Xe nào có camera 360?", "Những xe nào có cửa sổ trời?"],
    "feature_presence": ["MK 8 có túi khí không?", "MK 6 có sạc không dây ko?"],
    "models_list": ["Danh sách các mẫu xe", "đang bán những xe nào?"],
    "versions_list": ["MK 8 có mấy phiên bản?", "MK 7 có những bản nào?"],
    "colors": ["MK 3 có những màu sơn nào?", "Màu sắc ngoại thất MK 8"],
    "utility": ["Tìm showroom gần nhất", "Đặt lịch bảo dưỡng xe", "Đăng ký lái thử MK 8", "Dự toán trả góp xe"],
    "policy": ["Chính sách bảo hành pin xe điện", "Quy định dịch vụ cứu hộ", "Điều khoản đặt cọc xe"],
    "out_of_scope": ["Thời tiết hôm nay thế nào?", "Viết code Python quicksort", "Cách nấu phở bò ngon", "Tin tức chứng khoán"],
    "general": ["tôi muốn tìm hiểu một vài điều"],
}


def test_groups_keys_and_intents(spark):
    pairs = [(k, q) for k, qs in CATEGORIES.items() for q in qs]
    assert each(spark, [q for _, q in pairs], lambda q: rules.first_match(q, T.SPEC_GROUPS, None)) == [k for k, _ in pairs]
    assert each(spark, list(SPECS.values()), lambda q: rules.first_match(q, T.SPEC_KEYS, None)) == list(SPECS)
    pairs = [(k, q) for k, qs in INTENTS.items() for q in qs]
    assert each(spark, [q for _, q in pairs], lambda q: Q.question_intent(q, F.lit("general"))) == [k for k, _ in pairs]
    assert each(spark, ["kích thước thế nào"], lambda q: Q.question_intent(q, F.lit("kích_thước"))) == ["spec_query"]


def test_models_and_editions(spark):
    names = {"mk3": "MK 3", "giá MK  8?": "MK 8", "mk e34": "MK E34", "MKE34": "MK E34", "mk8 all new": "MK 8 All New", "MK 8 New": "MK 8 All New", "MK 8 The New": "MK 8 All New", "mk 8 the he moi": "MK 8 All New", "mk8 thế hệ mới": "MK 8 All New", "mk mpv 7": "MK MPV 7", "mkmpv7": "MK MPV 7", "Xe nào có camera 360?": None}
    assert each(spark, list(names), D.model_named) == list(names.values())
    editions = {"MK 8 Plus pin bao nhiêu": "Plus", "bản ECO": "Eco", "tiêu chuẩn": "TieuChuan", "tieuchuan": "TieuChuan", "Nâng cao": "NangCao", "cao cấp": "CaoCap", "the all new": "The All New", "mk8 new": "The All New", "thế hệ mới": "The All New", "newer": None, "unknown_ver": None, "": None}
    assert each(spark, list(editions), D.edition_first) == list(editions.values())


def test_topics(spark):
    topics = {"sạc nhanh không": "pin_và_sạc", "pin bao nhiêu": "thông_số_kỹ_thuật", "đi được bao xa": "phạm_vi_di_chuyển", "túi khí": "an_toàn", "7 chỗ": "nội_thất", "màu xe": "ngoại_thất", "OTA": "tính_năng_nổi_bật", "có mấy bản": "phiên_bản", "cốp": "kích_thước", "giá bán": "giá", "hôm nay": "general"}
    assert each(spark, list(topics), D.topic) == list(topics.values())


TURNS = [
    (1, 1, "Xin chào", None, "greeting", "respond", "greeting"),
    (1, 3, "MK 6 bản Eco thì sao", "MK 6", "general", "answer", "sufficient_direct_evidence"),
    (1, 5, "công suất bao nhiêu", "MK 6", "spec_query", "answer", "sufficient_direct_evidence"),
    (1, 7, "còn xe này giá bao nhiêu", "MK 6", "price", "answer", "sufficient_direct_evidence"),
    (1, 9, "mk8 the all new thì sao", "MK 8 All New", "spec_query", "answer", "sufficient_direct_evidence"),
    (1, 11, "thời tiết", "MK 8 All New", "spec_query", "answer", "sufficient_direct_evidence"),
    (2, 1, "xe này giá bao nhiêu", None, "price", "clarify", "ambiguous_context"),
    (2, 3, "giá bao nhiêu", None, "price", "clarify", "missing_model"),
    (2, 5, "bảo hành mấy năm", None, "policy", "answer", "sufficient_direct_evidence"),
    (3, 1, "thời tiết hôm nay", None, "out_of_scope", "out_of_scope", "out_of_scope"),
    (3, 3, "treo trước thế nào, hệ thống treo", None, "spec_query", "clarify", "missing_model"),
]


def test_decisions_inherit_in_the_order_of_turns(spark):
    rows = spark.createDataFrame([t[:3] for t in TURNS], "conv_id long, event_id long, q string").withColumn("at_ms", F.col("event_id"))
    own = rows.select("conv_id", "event_id", "at_ms", *[c.alias(n) for n, c in D.named(F.col("q")).items()])
    known = folds.batch(own, "conv_id", folds.carried, folds.CARRIED_OUT).join(rows.drop("at_ms"), ["conv_id", "event_id"])
    made = known.select("conv_id", "event_id", "q", "model", "edition", *[c.alias(n) for n, c in D.decided(F.col("q"), F.col("model"), F.col("topic")).items()])
    got = {(r.conv_id, r.event_id): r for r in made.collect()}
    assert [(c, t, q, got[c, t].model, got[c, t].intent, got[c, t].decision, got[c, t].reason) for c, t, q, *_ in TURNS] == TURNS
    assert got[1, 7].edition == "Eco" and got[1, 5].spec_group == "powertrain" and got[1, 3].fallback and not got[1, 5].fallback
    assert list(got[1, 5].tools) == ["ask_clarification", "get_specs"] and list(got[2, 5].tools) == ["ask_clarification", "get_price"] and got[1, 3].tools is None


def test_carrying_in_parts():
    rows = pd.DataFrame({"conv_id": [1] * 4, "event_id": range(4), "at_ms": range(4), "model": ["A", None, None, "B"], "edition": [None, "x", None, None], "topic": [None] * 4})
    state, out = folds.carried(None, rows)
    assert out["model"].tolist() == ["A", "A", "A", "B"] and out["edition"].tolist() == [None, "x", "x", "x"] and out["topic"].tolist() == [None] * 4 and state == ("B", "x", None)
    first, a = folds.carried(None, rows[:2])
    _, b = folds.carried(first, rows[2:])
    assert pd.concat([a, b])["model"].tolist() == out["model"].tolist()


def test_relevance_meets_on_groups(spark):
    groups = E.word_groups(spark, (("power", ("power_kw", "công suất")), ("range", ("range_km", "quãng đường"))))
    questions = spark.createDataFrame([("m", 1, "công suất MK 8"), ("m", 2, "đi được bao xa"), ("m", 3, "range_km 400"), ("n", 4, "công suất"), ("m", 5, None)], "model string, question int, text string")
    specs = spark.createDataFrame([("m", 10, "power_kw", "300"), ("m", 11, "range_km", "400"), ("m", 12, None, "xa"), ("k", 13, "power_kw", "1")], "model string, spec int, key string, value string")
    got = E.relevance(questions, specs, groups, ["model"])
    assert sorted((r.question, r.spec, r.score) for r in got.collect()) == [(1, 10, 0.9), (2, 12, 0.7), (3, 11, 0.9)]
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_relevance_shuffles_classes_of_words_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 4)
    groups = E.word_groups(spark, (("power", ("power_kw", "công suất")),))
    questions = [("m", i, "công suất MK 8") for i in range(30)] + [("m", None, "xa 5"), ("m", 7, "xa"), ("m", 7, "gần"), (None, 50, "xa"), ("k", 51, "xa")]
    specs = [("m", 100 + i, "power_kw", "300") for i in range(20)] + [("m", None, "x", "xa"), ("m", 200, "a", "8"), ("m", 200, "a", "xa"), (None, 300, "a", "xa")]
    questions = spark.createDataFrame(questions, "model string, question int, text string")
    got = E.relevance(questions, spark.createDataFrame(specs, "model string, spec int, key string, value string"), groups, ["model"])
    want = {(q, s): 0.9 for q in range(30) for s in range(100, 120)} | {(q, 200): 0.7 for q in range(30)} | {(None, None): 0.7, (None, 200): 0.7, (7, None): 0.7}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.question, r.spec): r.score for r in rows} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Repartition") and "Aggregate" not in plan[: plan.index("Repartition")]


CASES = [
    ("no features, no numbers", "Vâng ạ", "", [("get_specs", "power_kw", "300 kW")], True),
    ("no evidence", "Có HUD", "", [], False),
    ("known feature", "Có HUD và ghế", "", [("get_specs", "head_up_display", "có"), ("search_knowledge_base", "", "ghế da")], True),
    ("half unknown", "Có HUD và massage", "", [("get_specs", "head_up_display", "có")], False),
    ("a third unknown", "Có HUD, đèn và massage", "", [("get_specs", "head_up_display", "đèn")], True),
    ("words of the key's group", "công suất tốt", "", [("get_specs", "power_kw", "x")], True),
    ("negative of what was asked", "Xe không có HUD", "có HUD không", [("search_knowledge_base", "", "ghế da")], False),
    ("negative in the text", "Xe không có HUD", "có HUD không", [("search_knowledge_base", "", "không có HUD")], True),
    ("number of the evidence", "Mạnh 300 mã lực", "", [("get_specs", "x", "300")], True),
    ("another number", "Mạnh 310 mã lực", "", [("get_specs", "x", "300")], False),
    ("number of the question, small ones", "Với 310 thì có 5", "hỏi 310", [("get_specs", "x", "300")], True),
    ("numbers that claim nothing", "MK 8 có 10-70 (2024) camera 360 90% https://a.b/77", "", [("get_specs", "surround_view_camera", "có")], True),
    ("price with separators", "Giá 1.090.000.000 VNĐ", "", [("get_price", "Eco", "1090000000"), ("get_specs", "x", "5")], True),
    ("a price that is none", "Giá 300 triệu", "", [("get_price", "Eco", "1090000000"), ("get_specs", "x", "300")], False),
    ("near a large specification", "Giá xe, dài 4750", "", [("get_price", "Eco", "1090000000"), ("get_specs", "x", "4750 4760")], True),
    ("prices alone aren't counted", "Giá 12 triệu", "", [("get_price", "Eco", "1090000000")], True),
]


@pytest.mark.parametrize("partitions", [1, 3])
def test_grounding(spark, partitions):
    answers = spark.createDataFrame([(i, c[1], c[2]) for i, c in enumerate(CASES)], "i int, text string, question string").repartition(partitions)
    found = spark.createDataFrame([(i, *e) for i, c in enumerate(CASES) for e in c[3]], "i int, tool string, key string, value string")
    got = {r.i: r.grounded for r in E.grounded(answers, found, ["i"]).collect()}
    assert {c[0]: got[i] for i, c in enumerate(CASES)} == {c[0]: c[4] for c in CASES}

"""Values written out by hand."""

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import questions as Q
from millrace.functions import render as R
from millrace.functions import tables as T
from millrace.functions import text as X


def each(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_noise_lines(spark):
    noise = ["ĐĂNG NHẬP/Đăng ký", "banner top bar", "Google tag (gtag.js)", "end navigation", "END BREADCRUMB", "1. trang chủ", "3. Cộng đồng", "Tìm xe mới", "nhập ít nhất 2 ký tự", "Chọn địa chỉ nhận hàng", "Chọn Tỉnh/Thành phố", "Thay đổi địa chỉ khác", "Hotline 1900", "Quên mật khẩu?", "share", "star | Đã bán 5", "* * *", "---", "##", "[x](y)", "![](z)", "Đặt lịch", "Đăng ký", "[if mso 9]", "[endif]", "end main category", "End title", "Not found", "Không tìm thấy kết quả phù hợp", "Hãy thử lại với từ khoá khác", "Chọn màu", "0912.345.678", "12 05-2024", "a@b.vn", "Xin hãy gọi ngay!"]
    kept = {"Đăng ký lái thử": "Đăng ký lái thử", "share this": "share this", "chọn màu xe": "chọn màu xe", "12 05-24": "12 05-24", "![Ảnh](u) <b>đậm</b>&nbsp;&amp;\ue001 x": "Ảnh đậm & x", "0912": "0912"}
    assert each(spark, [*noise, *kept], lambda t: X.read_line(t, T.NOISE_LINES)) == [""] * len(noise) + list(kept.values())


def test_each_form_of_a_line_is_made_once(spark):
    assert str(Q.brochure_prose(F.col("t"), ("MK 6",))).count("translate(") == 1
    assert str(X.is_noise(X.plain_line(F.col("t")), T.NOISE_LINES)).count("nbsp") == 1
    lines = ["plain text", " a  b ", "a\tb", "![x](y) z", "<b>k</b>", "a&amp;b", "a&nbsp;b", "a \ue123 b", "<![endif] x", "a\u00a0b", "", None, "!x [y] > ;"]
    assert each(spark, lines, X.plain_line) == each(spark, lines, lambda t: F.btrim(_read(t)))


def _read(t):
    for pattern, to in X.READ:
        t = F.regexp_replace(t, pattern, to)
    return t


@given(st.text("ab .;", max_size=200), st.integers(20, 60), st.integers(0, 15))
def test_long_lines_lose_nothing(line, most, overlap):
    pieces = X.cut_line(line, most, overlap)
    assert all(p and p == p.strip() and len(p) <= most for p in pieces)
    at = 0
    for p in pieces:  # every piece stands in the line, and what lies between two of them is blank
        found = line.find(p, max(0, at - most))
        assert found >= 0 and not line[at:found].strip()
        at = max(at, found + len(p))
    assert not line[at:].strip()


def test_long_lines_by_hand(spark):
    assert X.cut_line("one two. three four; five six seven", 20, 4) == ["one two. three", "four; five six seven"]
    assert X.cut_line("abcdefghij" * 3, 10, 0) == ["abcdefghij"] * 3 and X.cut_line("", 5) == [] and X.cut_line("short", 80) == ["short"]
    assert each(spark, [None, "a b", ""], lambda t: X.cut_lines(t, 80)) == [None, ["a b"], []]


def test_specifications_that_can_be(spark):
    cases = [("length_mm", "4.750", "4750"), ("length_mm", "400", None), ("power_kw", "150", "150"), ("power_kw", "601", None), ("battery_kwh", "87,7", "87.7"), ("seats", "5", "5"), ("seats", "five", None), ("drivetrain", " awd", "AWD"), ("drivetrain", "4x4", None), ("color", "5", None), ("range_km", "", None), (None, "5", None), ("torque_nm", None, None)]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, k string, v string")
    assert [r.x for r in rows.select("i", Q.valid_spec(F.col("k"), F.col("v")).alias("x")).orderBy("i").collect()] == [c[2] for c in cases]


def test_junk_and_spec_sections(spark):
    rows = [("-  Nội thất \nthêm", True), ("x\n- Giá bán\ny", True), ("- Giá bán xe\ny", False), ("mk 6 Hero Banner", True), ("Chúng tôi sẽ liên hệ tư vấn", True), (" - Công ty - Ô tô điện - Xe máy điện ", True), ("một bài viết", False)]
    assert each(spark, [t for t, _ in rows], lambda t: Q.is_page_junk(F.array(F.lit("a")), t)) == [j for _, j in rows]
    assert each(spark, ["-  Nội thất \nthêm"], lambda t: Q.is_page_junk(F.array(F.lit("a"), F.lit("b")), t)) == [False]
    assert each(spark, ["x"], lambda t: Q.is_spec_table(t, F.array(F.lit("THÔNG SỐ KỸ THUẬT ")))) == [True]


def test_comparisons_look_up_every_product_named(spark):
    plan = lambda t: F.transform(Q.tool_plan(F.lit("compare"), t, F.lit("MK 9"), ()), lambda c: F.concat_ws(":", c.tool, c.model))
    assert each(spark, ["so sánh mk6 và MK 8 new", "giá mk 3 với mk 9"], plan) == [["get_specs:MK 6", "get_specs:MK 8 All New", "get_specs:MK 9"], ["get_specs:MK 3", "get_specs:MK 9", "get_price:MK 3", "get_price:MK 9"]]


def test_sections_of_a_context(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    sql = F.expr
    none = sql("CAST(NULL AS STRING)")
    price = R.prices(F.lit("MK 6"), sql("array(named_struct('version', 'Eco', 'price', 1090000000L, 'promo', 0L))"), sql("array(named_struct('model', 'MK 7', 'version', 'Plus', 'price', 5L))"), F.lit("n"))
    assert one(price) == "Giá xe MK 6:\n  - Eco: Giá niêm yết 1,090,000,000 VNĐ | Giá ưu đãi N/A\n\n  Model liên quan:\n    - MK 7 (Plus): từ 5 VNĐ\n\n  Lưu ý: n"
    specs = sql("array(named_struct('category', 'battery', 'version', 'ALL', 'key', 'range_km', 'value', '400', 'unit', 'km', 'page', '3'), named_struct('category', 'safety', 'version', 'Eco', 'key', 'x', 'value', '1', 'unit', '', 'page', CAST(NULL AS STRING)), named_struct('category', 'battery', 'version', 'Eco', 'key', 'seats', 'value', '5', 'unit', '', 'page', CAST(NULL AS STRING)))")
    assert one(R.specs(F.lit("MK 6"), specs, sql("array('battery')"), sql("CAST(array() AS array<string>)"), none)) == "Thông số kỹ thuật MK 6:\n\n  [BATTERY]\n    range_km (Quãng đường di chuyển): 400 km [trang 3]\n    Eco — seats (Số chỗ ngồi): 5"
    assert one(R.specs(F.lit("M"), specs, sql("CAST(NULL AS array<string>)"), sql("array('MK 9')"), none)).count("\n\n  [") == 3
    colors = R.colors(F.lit("M"), sql("array('red')"), sql("CAST(array() AS array<string>)"), sql("array(named_struct('color', 'red', 'kind', '', 'interior', 'i', 'fee', 12000L), named_struct('color', 'red', 'kind', 'k', 'interior', 'i', 'fee', 0L))"))
    assert one(colors) == "Màu sắc M:\n  Màu ngoại thất (1): red\n\n  Chi tiết màu:\n    - red / Nội thất: i (+12,000 VNĐ)"
    found = R.search_results(F.lit("q"), sql("array(named_struct('source_type', 's', 'score', '0.5', 'text', 'see https://a.b/c now'))"))
    assert one(found) == 'Kết quả tìm kiếm cho: "q":\n\n  [1] (s, score=0.5)\n      see  now'
    assert one(R.models(sql("array(named_struct('model', 'M', 'versions', array('a', 'b')))"))) == "Danh sách xe:\n  - M — Phiên bản: a, b"
    assert one(R.promotions(F.lit("u"), none, F.lit("n"))) == "Khuyến mãi: u\nn" and one(R.promotions(F.lit(""), none, none)) == "Hiện tại không có thông tin khuyến mãi."
    assert one(R.link("đặt lịch", F.lit("u"), none)) == "Link đặt lịch: đặt lịch\n  URL: u" and one(R.link("đặt lịch", none, none)) == "Không tìm thấy link đặt lịch."
    assert one(R.links("bảo dưỡng", sql("array(named_struct('label', '2024', 'url', 'u'))"), "Năm ")) == "Link bảo dưỡng:\n  - Năm 2024: u"

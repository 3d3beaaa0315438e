"""Queries with the full tables of noise and sanity, long lines, and the text of what was looked up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions import render
from ..functions import tables as T
from ..functions import text as X
from .base import query, table
from .questions import sql_list

#: Lines of pages, some noise, some not.
LINES = (
    "Đăng nhập / Đăng ký", "banner TOP bar", "Google tag (gtag.js)", "End Navigation", "1. Trang chủ", "12. Tin tức", "Tìm xe nào đó", "Nhập ít nhất 2 ký tự để tìm", "Chọn Tỉnh/Thành phố", "hotline 1900", "Quên mật khẩu?", "Share", "share this", "star | Đã bán 12", "* * *", "---", "###",
    "[a](b)", "![](x.png)", "![ảnh xe](x.png)", " Đặt lịch ", "đặt lịch hẹn", "[if mso]", "<![endif]", "end main category", "not found", "Chọn màu", "Chọn màu xe", "0912 345 678", "12 05-2024", "12 05-24", "a.b@c.vn", "Xin hãy gọi ngay 1", "<b>Đăng ký</b>&nbsp;", "một dòng &amp; hai", "END   title",
)
ADDED = " || chr(10) || ".join(f"({sql_list(LINES)})[(doc_id * {m} + {i}) % {len(LINES)} + 1]" for i, m in enumerate((1, 3, 5, 7)))
READ = "x"
for _pattern, _to in X.READ:
    READ = f"regexp_replace({READ}, '{_pattern}', '{_to}', 'g')".replace("$1", "\\1")
READ = f"trim({READ})"
NOISE = "|".join(T.NOISE_LINES)


@query(
    "txt_noise_table",
    f"""WITH l AS (SELECT doc_id, list_transform(string_split(text || chr(10) || {ADDED}, chr(10)), lambda x: {READ}) AS l FROM documents),
k AS (SELECT doc_id, l, list_filter(l, lambda x: x <> '' AND NOT regexp_matches(x, '(?i){NOISE}')) AS kept FROM l)
SELECT doc_id, len(list_filter(l, lambda x: x <> '')) AS n_lines, len(kept) AS kept, md5(array_to_string(kept, chr(10))) AS digest FROM k""",
)
def txt_noise_table(spark, sf):
    """Every text, with four lines of pages after it, less what the noise table knows."""
    added = [F.element_at(F.array(*map(F.lit, LINES)), ((F.col("doc_id") * m + i) % len(LINES) + 1).cast("int")) for i, m in enumerate((1, 3, 5, 7))]
    lines = F.split(F.concat_ws("\n", "text", *added), "\n")
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.filter(F.transform(lines, X.plain_line), lambda x: x != "").alias("read"))
    rows = rows.select("doc_id", F.size("read").cast("long").alias("n_lines"), F.filter("read", lambda x: ~X.is_noise(x, T.NOISE_LINES)).alias("kept"))
    return rows.select("doc_id", "n_lines", F.size("kept").cast("long").alias("kept"), F.md5(F.array_join("kept", "\n")).alias("digest"))


KEYS = (*(k for k, *_ in T.SPEC_RANGES), "drivetrain", "color", "drivetrain")
RAW = ("(p_size * 100)::VARCHAR", "(p_size % 9 + 1)::VARCHAR || '.' || lpad((p_size * 7)::VARCHAR, 3, '0')", "p_size || ',5'", "'awd'", "'4x4'", "''", "p_size::VARCHAR", "'n/a'", "' Fwd '")
LIMITS = " ".join(f"WHEN '{k}' THEN v BETWEEN {lo} AND {hi}" for k, _, _, lo, hi in T.SPEC_RANGES)


SPEC_ROWS = f"""r AS (SELECT p_partkey, p_brand, p_type, ({sql_list(KEYS)})[p_partkey % {len(KEYS)} + 1] AS key, trim(CASE p_partkey % {len(RAW)} {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(RAW))} END) AS raw FROM part),
n AS (SELECT *, CASE WHEN regexp_full_match(raw, '[0-9]{{1,3}}([.,][0-9]{{3}})+') THEN try_cast(regexp_replace(raw, '[.,]', '', 'g') AS DOUBLE) ELSE try_cast(replace(raw, ',', '.') AS DOUBLE) END AS v FROM r),
k AS (SELECT p_partkey, p_brand, p_type, key, CASE key {" ".join(f"WHEN '{k}' THEN '{c}'" for k, c, *_ in T.SPEC_RANGES)} ELSE 'powertrain' END AS category, CASE WHEN key = 'drivetrain' THEN upper(raw) WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END AS value FROM n
WHERE CASE WHEN key = 'drivetrain' THEN upper(raw) IN {T.DRIVETRAINS} ELSE coalesce(CASE key {LIMITS} END, false) END)"""


def spec_table(spark, sf):
    n, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    raw = (text(size * 100), F.concat(text(size % 9 + 1), F.lit("."), F.lpad(text(size * 7), 3, "0")), F.concat(text(size), F.lit(",5")), F.lit("awd"), F.lit("4x4"), F.lit(""), text(size), F.lit("n/a"), F.lit(" Fwd "))
    key = F.element_at(F.array(*map(F.lit, KEYS)), (n % len(KEYS) + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", key.alias("key"), F.element_at(F.array(*raw), (n % len(raw) + 1).cast("int")).alias("raw"))
    return rows.withColumns({"category": Q.spec_category(F.col("key")), "value": Q.valid_spec(F.col("key"), F.col("raw"))}).where("value IS NOT NULL")


@query("cat_spec_table", f"WITH {SPEC_ROWS} SELECT p_partkey, key, category, value FROM k")
def cat_spec_table(spark, sf):
    """Extracted specifications that can be: known keys, numbers in their ranges, drivetrains of the list."""
    return spec_table(spark, sf).select("p_partkey", "key", "category", "value")


@query("cat_spec_first", f"WITH {SPEC_ROWS} SELECT p_brand, p_type, key, arg_min(value, p_partkey) AS value, count(*) AS found FROM k GROUP BY ALL")
def cat_spec_first(spark, sf):
    """Of the valid values of a product's edition the first of each key."""
    return spec_table(spark, sf).groupBy("p_brand", "p_type", "key").agg(F.min_by("value", "p_partkey").alias("value"), F.count("*").alias("found"))


MOST, OVERLAP = 300, 80
LAST = lambda mark: f"CASE WHEN strpos(reverse(w), reverse('{mark}')) > 0 THEN start + length(w) - strpos(reverse(w), reverse('{mark}')) - {len(mark)} + 1 ELSE -1 END"


@query(
    "txt_cut_lines",
    f"""WITH RECURSIVE d AS (SELECT doc_id, replace(text, chr(10), ' ') AS s, length(text) AS n FROM documents WHERE text <> ''),
r AS (SELECT doc_id, s, n, 0::BIGINT AS piece, 0::BIGINT AS start, 0::BIGINT AS stop, '' AS p FROM d
  UNION ALL SELECT doc_id, s, n, piece + 1, CASE WHEN e = n THEN n ELSE greatest(CASE WHEN strpos(substr(s, (e - {OVERLAP} + 1)::BIGINT), ' ') > 0 THEN e - {OVERLAP} + strpos(substr(s, (e - {OVERLAP} + 1)::BIGINT), ' ') ELSE e - {OVERLAP} END, start + 1) END, e, trim(substr(s, start + 1, e - start))
  FROM (SELECT *, CASE WHEN full_ = n THEN n WHEN a > half THEN a + 2 WHEN b > half THEN b + 2 WHEN c > half THEN c + 1 ELSE full_ END AS e FROM
    (SELECT *, {LAST('. ')} AS a, {LAST('; ')} AS b, {LAST(' ')} AS c, start + {MOST // 2} AS half FROM
      (SELECT *, least(start + {MOST}, n) AS full_, substr(s, start + 1, least(start + {MOST}, n) - start) AS w FROM r WHERE start < n))))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1)::INT AS piece, md5(p) AS digest FROM r WHERE piece > 0 AND p <> ''""",
)
def txt_cut_lines(spark, sf):
    """Every text as one long line, in pieces that overlap."""
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    return table(spark, sf, "documents").where("text <> ''").select("doc_id", F.posexplode(X.cut_lines(line, MOST, OVERLAP)).alias("piece", "p")).select("doc_id", "piece", F.md5("p").alias("digest"))


RENDERED = """SELECT p_partkey, tool, md5(text) AS digest FROM (
SELECT p_partkey, 'get_price' AS tool, 'Giá xe ' || p_brand || ':' || chr(10) || '  - Eco: Giá niêm yết ' || format('{:,}', price) || ' VNĐ | Giá ưu đãi ' || CASE WHEN p_size % 2 = 0 THEN 'N/A' ELSE format('{:,}', price - 1000) || ' VNĐ' END || chr(10) || '  - Plus: Giá niêm yết N/A | Giá ưu đãi N/A'
  || CASE WHEN p_size % 3 = 0 THEN chr(10) || chr(10) || '  Model liên quan:' || chr(10) || '    - MK 9 (): từ ' || format('{:,}', price * 2) || ' VNĐ' ELSE '' END || CASE WHEN p_size % 4 = 0 THEN chr(10) || chr(10) || '  Lưu ý: ' || p_name ELSE '' END AS text FROM p
UNION ALL SELECT p_partkey, 'get_specs', 'Thông số kỹ thuật ' || p_brand || ':' || CASE WHEN p_size % 5 = 1 THEN '' ELSE chr(10) || chr(10) || '  [BATTERY]' || chr(10) || '    range_km (Quãng đường di chuyển): ' || p_size || ' km' || chr(10) || '    Eco — other: x [trang 3]' END
  || CASE WHEN p_size % 5 = 2 THEN '' ELSE chr(10) || chr(10) || '  [INTERIOR]' || chr(10) || '    seats (Số chỗ ngồi): ' || (p_size % 7) END || CASE WHEN p_size % 3 = 0 THEN chr(10) || chr(10) || '  Model liên quan:' || chr(10) || '    - MK 9' ELSE '' END FROM p
UNION ALL SELECT p_partkey, 'search_knowledge_base', 'Kết quả tìm kiếm cho: "' || p_name || '":' || chr(10) || chr(10) || '  [1] (manual, score=0.5)' || chr(10) || '      see  for ' || p_type || chr(10) || chr(10) || '  [2] (policy, score=0.25)' || chr(10) || '      ' || p_name FROM p
UNION ALL SELECT p_partkey, 'get_colors', 'Màu sắc ' || p_brand || ':' || chr(10) || '  Màu ngoại thất (2): red, blue' || CASE WHEN p_size % 2 = 0 THEN chr(10) || '  Màu nội thất (1): ' || p_type ELSE '' END || chr(10) || chr(10) || '  Chi tiết màu:' || chr(10) || '    - red [matte] / Nội thất: ' || p_type || ' (+' || format('{:,}', p_size * 1000) || ' VNĐ)' || chr(10) || '    - blue / Nội thất: ' || p_type FROM p
UNION ALL SELECT p_partkey, 'list_available_models', 'Danh sách xe:' || chr(10) || '  - ' || p_brand || ' — Phiên bản: Eco, Plus' || chr(10) || '  - MK 9 — Phiên bản: ' || p_type FROM p
UNION ALL SELECT p_partkey, 'get_active_promotions', CASE p_size % 3 WHEN 0 THEN 'Hiện tại không có thông tin khuyến mãi.' WHEN 1 THEN 'Khuyến mãi: https://x/' || p_partkey ELSE 'Sale: https://x/' || p_partkey || chr(10) || p_name END FROM p
UNION ALL SELECT p_partkey, t, CASE WHEN p_size % 2 = 0 THEN 'Không tìm thấy link ' || w || '.' ELSE 'Link ' || w || ': ' || CASE WHEN p_size % 3 = 0 THEN w ELSE p_name END || chr(10) || '  URL: https://y/' || p_partkey END FROM p, (VALUES ('get_onroad_cost_link', 'chi phí lăn bánh'), ('get_showroom_charging_link', 'showroom/trạm sạc'), ('get_booking_link', 'đặt lịch')) x(t, w)
UNION ALL SELECT p_partkey, 'get_loan_estimate_link', CASE WHEN p_size % 2 = 0 THEN 'Không tìm thấy link trả góp/thẩm định vay.' ELSE 'Link trả góp/thẩm định vay:' || chr(10) || '  - ' || p_name || ': https://z' END FROM p
UNION ALL SELECT p_partkey, 'get_maintenance_link', CASE WHEN p_size % 2 = 0 THEN 'Không tìm thấy link bảo dưỡng.' ELSE 'Link bảo dưỡng:' || chr(10) || '  - Năm 2023: https://m' || chr(10) || '  - Năm ' || (2000 + p_size % 24) || ': https://n' END FROM p)"""


@query("qry_context_sections", "WITH p AS (SELECT *, floor(p_retailprice)::BIGINT * 1000 AS price FROM part) " + RENDERED)
def qry_context_sections(spark, sf):
    """The section of every kind of lookup, for every part."""
    p = table(spark, sf, "part").withColumn("price", F.floor("p_retailprice").cast("long") * 1000)
    brand, name, size, price, key = F.col("p_brand"), F.col("p_name"), F.col("p_size"), F.col("price"), F.col("p_partkey").cast("string")
    none = F.lit(None)
    text = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    row = lambda **kw: F.struct(*[(F.lit(v) if not isinstance(v, Column) else v).alias(k) for k, v in kw.items()])
    some = lambda when, items: F.when(when, items).otherwise(F.slice(items, 1, 0))
    note = F.when(size % 4 == 0, name)
    long_none = none.cast("long")
    spec = lambda c, v, k, x, u, g: row(category=c, version=v, key=k, value=text(x), unit=u, page=g)
    sections = {
        "get_price": render.prices(brand, F.array(row(version="Eco", price=price, promo=F.when(size % 2 != 0, price - 1000)), row(version="Plus", price=long_none, promo=long_none)), some(size % 3 == 0, F.array(row(model="MK 9", version=none.cast("string"), price=price * 2))), note),
        "get_specs": render.specs(
            brand,
            F.array(spec("battery", "ALL", "range_km", size, "km", none.cast("string")), spec("battery", "Eco", "other", "x", "", F.lit("3")), spec("interior", "ALL", "seats", size % 7, "", none.cast("string"))),
            F.when(size % 5 == 1, F.array(F.lit("interior"))).when(size % 5 == 2, F.array(F.lit("battery"))), some(size % 3 == 0, F.array(F.lit("MK 9"))), none.cast("string"),
        ),
        "search_knowledge_base": render.search_results(name, F.array(row(source_type="manual", score="0.5", text=F.concat(F.lit("see https://a.b/c?d for "), "p_type")), row(source_type="policy", score="0.25", text=name))),
        "get_colors": render.colors(brand, F.array(F.lit("red"), F.lit("blue")), some(size % 2 == 0, F.array("p_type")), F.array(row(color="red", kind="matte", interior=F.col("p_type"), fee=size * 1000), row(color="blue", kind="", interior=F.col("p_type"), fee=F.lit(0)), row(color="red", kind="", interior=F.col("p_type"), fee=F.lit(5)))),
        "list_available_models": render.models(F.array(row(model=brand, versions=F.array(F.lit("Eco"), F.lit("Plus"))), row(model="MK 9", versions=F.array("p_type")))),
        "get_active_promotions": render.promotions(F.when(size % 3 != 0, F.concat(F.lit("https://x/"), key)), F.when(size % 3 == 2, "Sale"), F.when(size % 3 == 2, name)),
        "get_loan_estimate_link": render.links(render.LINKS["get_loan_estimate_link"], some(size % 2 != 0, F.array(row(label=name, url="https://z")))),
        "get_maintenance_link": render.links(render.LINKS["get_maintenance_link"], some(size % 2 != 0, F.array(row(label="2023", url="https://m"), row(label=text(2000 + size % 24), url="https://n"))), "Năm "),
    }
    for tool in ("get_onroad_cost_link", "get_showroom_charging_link", "get_booking_link"):
        sections[tool] = render.link(render.LINKS[tool], F.when(size % 2 != 0, F.concat(F.lit("https://y/"), key)), F.when(size % 3 != 0, name))
    made = F.array(*[F.struct(F.lit(t).alias("tool"), F.md5(c).alias("digest")) for t, c in sections.items()])
    return p.select("p_partkey", F.inline(made))

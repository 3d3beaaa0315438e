"""Specification sheets as rows; a brand's parts stand for the lines of its sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sheets as S
from .base import query, table
from .corpus import STRIP

LINES = (("PHIÊN BẢN", "MK 6 - Eco"), ("1. Động cơ", ""), ("Công suất tối đa (kW):", "{n}"), ("Kích thước (DxRxC)", "4.{t} x 1.834 x 1.{t} mm"), ("Phiên bản", "MK 8 Plus AWD"), ("Nội thất", ""), ("Số chỗ ngồi", "{n}\nchỗ"), ("Màn hình – HUD & loa", "Có {n}"), ("Nhãn lạ {n}", "x"), ("Version", "MK 9"), ("An toàn", None), ("Công suất", "{t}"))
LABELS = (("cong suat", "power_kw", "kW", "powertrain"), ("cong suat toi da", "max_power_kw", "kW", "powertrain"), ("kich thuoc", "dimension_triple", "", "dimension"), ("so cho", "seats", "", "interior"))
FEATURES = (("man hinh hud loa", "hud_speakers", "infotainment"), ("man hinh", "display", "infotainment"))
SECTIONS = (("dong co", "powertrain"), ("noi that", "interior"), ("an toan", "safety"))
EDITIONS = (("Brand#3", "Plus AWD", "PlusCaptain"), ("Brand#5", "Eco", "Base"))
PARENTS = (("Brand#3", "Copy", "PlusCaptain"), ("Brand#4", "Eco", "Plus AWD"))
V = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
FILL = lambda x: f"replace(replace({x}, '{{n}}', p_size::VARCHAR), '{{t}}', lpad((p_size * 7 % 1000)::VARCHAR, 3, '0'))"
NORM = lambda x: f"trim(trim(regexp_replace({STRIP % x}, '\\s+', ' ', 'g')), ':|-–— ' || chr(9))"
STRICT = lambda x: f"trim(regexp_replace(regexp_replace({NORM(x)}, '[,:;()/&\\-–—]+', ' ', 'g'), '\\s+', ' ', 'g'))"
NUM = lambda x: f"CASE WHEN regexp_full_match({x}, '[0-9]{{1,3}}([.,][0-9]{{3}})+') THEN regexp_replace({x}, '[.,]', '', 'g') ELSE {x} END"
LAST = "OVER (PARTITION BY sheet ORDER BY row_no ROWS UNBOUNDED PRECEDING)"

SHEET = f"""l AS (SELECT p_brand AS sheet, p_partkey AS row_no, {FILL('label')} AS label, coalesce({FILL('value')}, '') AS value FROM part JOIN (SELECT i, label, value FROM (VALUES {", ".join(f"({i}, '{a}', " + ("NULL" if b is None else "'" + b.replace(chr(10), "' || chr(10) || '") + "'") + ")" for i, (a, b) in enumerate(LINES))}) x(i, label, value)) ON i = p_partkey % {len(LINES)}),
n AS (SELECT *, {NORM('label')} AS norm, {STRICT('label')} AS strict FROM l),
s AS (SELECT *, CASE WHEN norm IN ('phien ban', 'version') THEN trim(regexp_extract(value, '(?i)^mk\\s*\\d+[\\s\\-]*(.*)$', 1)) END AS said, CASE WHEN value = '' AND norm NOT IN ('phien ban', 'version') THEN (SELECT category FROM (VALUES {V(SECTIONS)}) x(t, category) WHERE t = regexp_replace(norm, '^([0-9]+|[ivx]+)[.)]\\s*', '')) END AS sec FROM n),
f AS (SELECT * REPLACE (last_value(said IGNORE NULLS) {LAST} AS said, last_value(sec IGNORE NULLS) {LAST} AS sec) FROM s),
e AS (SELECT f.* REPLACE (regexp_replace(value, '\\s*\\n\\s*', ' ', 'g') AS value), nullif(coalesce(x.edition, said), '') AS edition FROM f LEFT JOIN (VALUES {V(EDITIONS)}) x(sheet, said, edition) USING (sheet, said) WHERE value <> '' AND norm NOT IN ('phien ban', 'version')),
k AS (SELECT *, (SELECT arg_max({{'key': key, 'unit': unit, 'category': category}}, length(a)) FROM (VALUES {V(LABELS)}) x(a, key, unit, category) WHERE starts_with(norm, a)) AS known, (SELECT arg_max({{'key': key, 'category': category}}, length(a)) FROM (VALUES {V(FEATURES)}) x(a, key, category) WHERE starts_with(strict, a)) AS feature FROM e),
d AS (SELECT sheet, edition, row_no, coalesce(known.category, feature.category, sec, 'general') AS category, CASE WHEN known.key = 'dimension_triple' THEN 'mm' ELSE coalesce(known.unit, '') END AS unit,
  unnest(CASE WHEN known.key = 'dimension_triple' THEN list_transform([1, 2, 3], lambda i: {{'key': (['length_mm', 'width_mm', 'height_mm'])[i], 'value': {NUM("regexp_extract(regexp_split_to_array(value, '\\s*[x×X]\\s*')[i], '([0-9][0-9.,]*)', 1)")}}}) ELSE [{{'key': coalesce(known.key, feature.key, norm), 'value': value}}] END) AS kv FROM k),
r AS (SELECT sheet, edition, kv.key AS key, arg_min({{'category': category, 'value': kv.value, 'unit': unit}}, row_no) AS x, min(row_no) AS row_no FROM d GROUP BY ALL)"""


def sheet_rows(spark, sf):
    size = F.col("p_size")
    filled = lambda c: F.replace(F.replace(c, F.lit("{n}"), size.cast("string")), F.lit("{t}"), F.lpad((size * 7 % 1000).cast("string"), 3, "0"))
    line = spark.createDataFrame([(i, *x) for i, x in enumerate(LINES)], "i int, label string, value string")
    parts = table(spark, sf, "part").withColumn("i", (F.col("p_partkey") % len(LINES)).cast("int"))
    lines = parts.join(F.broadcast(line), "i").select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("row_no"), filled(F.col("label")).alias("label"), filled(F.col("value")).alias("value"))
    numbered = lambda rows, schema: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", ord int")
    return S.spec_rows(
        lines, numbered(LABELS, "alias string, key string, unit string, category string"), numbered(FEATURES, "alias string, key string, category string"),
        spark.createDataFrame(SECTIONS, "title string, category string"), spark.createDataFrame(EDITIONS, "sheet string, said string, edition string"), "mk",
    )


@query("cat_sheet_rows", f"WITH {SHEET} SELECT sheet, edition, x.category, key, x.value, x.unit, row_no FROM r")
def cat_sheet_rows(spark, sf):
    """The specifications of every brand's sheet."""
    return sheet_rows(spark, sf)


@query(
    "cat_sheet_editions",
    f"WITH {SHEET}, a AS (SELECT sheet, edition, key, x.value AS value FROM r), t AS (SELECT a.sheet, p.edition, key, value FROM a JOIN (VALUES {V(PARENTS)}) p(sheet, edition, parent) ON a.sheet = p.sheet AND a.edition = p.parent) SELECT sheet, edition, key, value FROM a UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.sheet = t.sheet AND a.edition = t.edition AND a.key = t.key)",
)
def cat_sheet_editions(spark, sf):
    """The same with editions that take over another one's rows."""
    parents = spark.createDataFrame(PARENTS, "sheet string, edition string, parent string")
    return S.inherited(sheet_rows(spark, sf), parents).select("sheet", "edition", "key", "value")

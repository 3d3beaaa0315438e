from millrace.operators import sheets as S

LINES = [
    ("a", 1, "PHIÊN BẢN", "MK 6 Eco"), ("a", 2, "II. ĐỘNG CƠ", None), ("a", 3, "Công suất tối đa (kW):", "150"), ("a", 4, "Kích thước (D x R x C)", "4.241 x 1.834 x n/a mm"), ("a", 5, "Công suất tối đa", "999"),
    ("a", 6, "Nhãn  riêng", "hai\n dòng"), ("a", 7, " ", "x"), ("a", 8, None, "x"), ("a", 9, "Version", "MK 6 - Plus AWD"), ("a", 10, "Công suất", "200"), ("a", 11, "Khác", ""), ("a", 12, "Số chỗ", "5"),
    ("b", 1, "Số chỗ", "7"), ("b", 2, "Version", "MK 9"), ("b", 3, "Số chỗ ngồi", "6"), ("b", 4, "Màn hình/ HUD", "có"),
]


def rows(spark, lines):
    make = spark.createDataFrame
    return S.spec_rows(
        make(lines, "sheet string, row_no long, label string, value string"),
        make([("cong suat", 0, "power_kw", "kW", "powertrain"), ("cong suat toi da", 1, "max_power_kw", "kW", "powertrain"), ("kich thuoc", 2, "dimension_triple", "", "dimension"), ("so cho", 3, "seats", "", "interior")], "alias string, ord int, key string, unit string, category string"),
        make([("man hinh", 0, "display", "infotainment"), ("man hinh hud", 1, "hud", "infotainment")], "alias string, ord int, key string, category string"),
        make([("dong co", "powertrain")], "title string, category string"),
        make([("a", "Plus AWD", "PlusCaptain")], "sheet string, said string, edition string"),
        "mk",
    )


def test_a_sheet_by_hand(spark):
    got = rows(spark, LINES)
    assert sorted(((r.sheet, r.edition, r.category, r.key, r.value, r.unit) for r in got.collect()), key=repr) == sorted([
        ("a", "Eco", "powertrain", "max_power_kw", "150", "kW"), ("a", "Eco", "dimension", "length_mm", "4241", "mm"), ("a", "Eco", "dimension", "width_mm", "1834", "mm"), ("a", "Eco", "powertrain", "nhan rieng", "hai dòng", ""),
        ("a", "PlusCaptain", "powertrain", "power_kw", "200", "kW"), ("a", "PlusCaptain", "interior", "seats", "5", ""), ("b", None, "interior", "seats", "7", ""), ("b", None, "infotainment", "hud", "có", ""),
    ], key=repr)


def test_inherited_rows_give_way_to_own_ones(spark):
    parents = spark.createDataFrame([("a", "PlusCaptain", "Eco")], "sheet string, edition string, parent string")
    got = {(r.edition, r.key): r.value for r in S.inherited(rows(spark, LINES), parents).where("sheet = 'a'").collect()}
    assert got["PlusCaptain", "max_power_kw"] == "150" and got["PlusCaptain", "power_kw"] == "200" and len(got) == 10


def test_no_lines(spark):
    assert rows(spark, []).collect() == []

"""What was looked up, as text for a context: one section per result, amounts with thousands marks, no addresses inside texts.

Every function takes columns of one result; items are arrays of structs, which are as long as a lookup returns. The wording
of headings, labels and missing results is a fixed value, as is the place of every mark around them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


def _lines(*parts: Column) -> Column:
    """Lines (texts or arrays of texts) under each other; null ones go."""
    return F.array_join(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), "\n")


def _one(line: Column) -> Column:
    return F.array_compact(F.array(line))


def _amount(x: Column, none: str = "N/A") -> Column:
    return F.when(F.coalesce(x, F.lit(0)) != 0, F.concat(F.format_number(x, 0), F.lit(" VNĐ"))).otherwise(none)


def _note(note: Column) -> Column:
    return _one(F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit("\n  Lưu ý: "), note)))


def prices(model: Column, items: Column, related: Column, note: Column) -> Column:
    """items: (version, price, promo); related: (model, version, price)."""
    line = lambda p: F.concat(F.lit("  - "), p.version, F.lit(": Giá niêm yết "), _amount(p.price), F.lit(" | Giá ưu đãi "), _amount(p.promo))
    other = lambda r: F.concat(F.lit("    - "), r.model, F.lit(" ("), F.coalesce(r.version, F.lit("")), F.lit("): từ "), _amount(r.price))
    more = F.when(F.size(related) > 0, F.concat(F.array(F.lit("\n  Model liên quan:")), F.transform(related, other))).otherwise(F.array().cast("array<string>"))
    return _lines(_one(F.concat(F.lit("Giá xe "), model, F.lit(":"))), F.transform(items, line), more, _note(note))


def specs(model: Column, items: Column, categories: Column, related: Column, note: Column) -> Column:
    """items: (category, version, key, value, unit, page), in order; categories: those to show, null for all; a category's heading stands where it changes."""
    labels = F.create_map(*[F.lit(x) for pair in T.KEY_LABELS for x in pair])
    shown = F.filter(items, lambda s: categories.isNull() | F.array_contains(categories, s.category))

    def line(s: Column, i: Column) -> Column:
        head = F.when((i == 0) | (F.get(shown, i - 1).category != s.category), F.concat(F.lit("\n  ["), F.upper(s.category), F.lit("]\n"))).otherwise("")
        label = F.coalesce(F.concat(F.lit(" ("), F.try_element_at(labels, s.key), F.lit(")")), F.lit(""))
        unit = F.when(F.coalesce(s.unit, F.lit("")) != "", F.concat(F.lit(" "), s.unit)).otherwise("")
        page = F.when(s.page.isNotNull(), F.concat(F.lit(" [trang "), s.page, F.lit("]"))).otherwise("")
        version = F.when(s.version == "ALL", "").otherwise(F.concat(s.version, F.lit(" — ")))
        return F.concat(head, F.lit("    "), version, s.key, label, F.lit(": "), s.value, unit, page)

    more = F.when(F.size(related) > 0, F.concat(F.array(F.lit("\n  Model liên quan:")), F.transform(related, lambda m: F.concat(F.lit("    - "), m)))).otherwise(F.array().cast("array<string>"))
    return _lines(_one(F.concat(F.lit("Thông số kỹ thuật "), model, F.lit(":"))), F.transform(shown, line), more, _note(note))


def search_results(query: Column, items: Column) -> Column:
    """items: (source_type, score, text)."""
    line = lambda r, i: F.concat(F.lit("\n  ["), i + 1, F.lit("] ("), r.source_type, F.lit(", score="), r.score, F.lit(")\n      "), F.regexp_replace(r.text, r"https?://\S+", ""))
    return _lines(_one(F.concat(F.lit('Kết quả tìm kiếm cho: "'), query, F.lit('":'))), F.transform(items, line))


def colors(model: Column, outside: Column, inside: Column, variants: Column) -> Column:
    """variants: (color, kind, interior, fee); of those that repeat colour and interior the first counts."""
    many = lambda label, names: _one(F.when(F.size(names) > 0, F.concat(F.lit(f"  {label} ("), F.size(names), F.lit("): "), F.array_join(names, ", "))))
    first = F.filter(variants, lambda v, i: ~F.exists(F.slice(variants, 1, i), lambda w: (w.color == v.color) & (w.interior == v.interior)))

    def line(v: Column) -> Column:
        kind = F.when(F.coalesce(v.kind, F.lit("")) != "", F.concat(F.lit(" ["), v.kind, F.lit("]"))).otherwise("")
        fee = F.when(F.coalesce(v.fee, F.lit(0)) > 0, F.concat(F.lit(" (+"), F.format_number(v.fee, 0), F.lit(" VNĐ)"))).otherwise("")
        return F.concat(F.lit("    - "), v.color, kind, F.lit(" / Nội thất: "), v.interior, fee)

    detail = F.when(F.size(variants) > 0, F.concat(F.array(F.lit("\n  Chi tiết màu:")), F.transform(first, line))).otherwise(F.array().cast("array<string>"))
    return _lines(_one(F.concat(F.lit("Màu sắc "), model, F.lit(":"))), many("Màu ngoại thất", outside), many("Màu nội thất", inside), detail)


def models(items: Column) -> Column:
    """items: (model, versions)."""
    return _lines(_one(F.lit("Danh sách xe:")), F.transform(items, lambda m: F.concat(F.lit("  - "), m.model, F.lit(" — Phiên bản: "), F.array_join(m.versions, ", "))))


def promotions(url: Column, label: Column, note: Column) -> Column:
    text = F.concat(F.coalesce(label, F.lit("Khuyến mãi")), F.lit(": "), url)
    return F.when(F.coalesce(url, F.lit("")) == "", "Hiện tại không có thông tin khuyến mãi.").when(F.coalesce(note, F.lit("")) != "", F.concat(text, F.lit("\n"), note)).otherwise(text)


def link(what: str, url: Column, label: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", f"Không tìm thấy link {what}.").otherwise(F.concat(F.lit(f"Link {what}: "), F.coalesce(label, F.lit(what)), F.lit("\n  URL: "), url))


def links(what: str, items: Column, of: str = "") -> Column:
    """items: (label, url)."""
    made = _lines(_one(F.lit(f"Link {what}:")), F.transform(items, lambda x: F.concat(F.lit(f"  - {of}"), x.label, F.lit(": "), x.url)))
    return F.when(F.size(items) > 0, made).otherwise(f"Không tìm thấy link {what}.")


#: What each kind of link is called.
LINKS = {"get_onroad_cost_link": "chi phí lăn bánh", "get_loan_estimate_link": "trả góp/thẩm định vay", "get_showroom_charging_link": "showroom/trạm sạc", "get_booking_link": "đặt lịch", "get_maintenance_link": "bảo dưỡng"}

"""Rows of a configurator's object, nested as its page has it: a VARIANT, exploded by lateral joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.js import assigned_json


def read(pages: DataFrame, name: str, html: str = "html") -> DataFrame:
    """pages with v, the object that a script assigns to the name; null where there is none that can be read."""
    return pages.withColumn("v", F.try_parse_json(assigned_json(F.col(html), name)))


def _at(v: Column, *path: Column | str) -> Column:
    """What lies under the keys, as a variant."""
    steps = [F.concat(F.lit("['"), F.replace(p, F.lit("'"), F.lit("")), F.lit("']")) if isinstance(p, Column) else F.lit(f".{p}") for p in path]
    return F.try_variant_get(v, F.concat(F.lit("$"), *steps), "variant")


def _text(v: Column, *path: Column | str) -> Column:
    return _at(v, *path).try_cast("string") if path else v.try_cast("string")


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _some(v: Column) -> Column:
    """Neither missing nor null, 0, empty or false."""
    return F.coalesce(~F.to_json(v).isin("null", "0", '""', "false"), F.lit(False))


def _amount(price: Column) -> Column:
    """The value of {value, formatted}, a number, or the digits of a text; 0 without any."""
    digits = F.regexp_replace(price.try_cast("string"), "[^0-9]", "").try_cast("long")
    plain = F.when(F.schema_of_variant(price) == "STRING", digits).otherwise(price.try_cast("long"))
    return F.coalesce(F.when(_is_object(price), _text(price, "value").try_cast("long")).otherwise(plain), F.lit(0).cast("long"))


def _shown(price: Column) -> Column:
    return F.when(_some(price), F.when(_is_object(price), F.coalesce(_text(price, "formatted"), F.lit(""))).otherwise(price.try_cast("string"))).otherwise("")


def _models(rows: DataFrame, key: str) -> DataFrame:
    """(key, model_id, model_name, data) of every listed model that has data."""
    tvf = rows.sparkSession.tvf
    each = rows.select(key, "v").lateralJoin(tvf.variant_explode(_at(F.col("v").outer(), "products", "models")))
    model = F.col("value")
    found = each.select(key, _text(model, "id").alias("model_id"), _text(model, "name").alias("model_name"), _at(F.col("v"), "products", _text(model, "id")).alias("data"))
    return found.where(_is_object(F.col("data")) & _some(_at(F.col("data"), "model")))


def variants(rows: DataFrame, key: str) -> DataFrame:
    """One row for each variant of a model: with a price, or with only a price as a combination of options.

    A variant costs what its cheapest colour does (of equally cheap ones the last listed); a combination its own price.
    """
    tvf = rows.sparkSession.tvf
    each = _models(rows, key).lateralJoin(tvf.variant_explode(F.col("data").outer())).withColumnsRenamed({"key": "variant_code", "value": "d"})
    d = F.col("d")
    each = each.where(~F.col("variant_code").isin("model", "label") & _is_object(d)).where(_some(_at(d, "price")) | _some(_at(d, "priceWithBattery")))
    option = ~_some(_at(d, "price"))
    codes = F.coalesce(_at(d, "listColor").try_cast("array<string>"), F.array().cast("array<string>"))
    each = each.withColumns({"is_option": option, "codes": F.filter(codes, lambda c: _is_object(_at(d, c)))})
    colour = lambda c: F.struct(c.alias("code"), F.coalesce(_text(d, c, "label"), F.lit("")).alias("label"), F.coalesce(_text(d, c, "code"), F.lit("")).alias("hex"), _amount(_at(d, c, "price")).alias("total"), _shown(_at(d, c, "price")).alias("shown"), _some(_at(d, c, "price")).alias("priced"))
    each = each.withColumn("colours", F.transform("codes", colour))
    priced = F.filter("colours", lambda c: c.priced)
    cheapest = F.array_min(F.transform(priced, lambda c, i: F.struct(c.total, (-i).alias("i"), c.shown))).alias("cheapest")
    own = F.when(F.col("is_option"), _amount(_at(d, "priceWithBattery"))).otherwise(_amount(_at(d, "priceValue")))
    own_shown = F.when(F.col("is_option"), _shown(_at(d, "priceWithBattery"))).otherwise(_shown(_at(d, "price")))
    each = each.select("*", F.when(~F.col("is_option"), cheapest).alias("least"))
    price = F.coalesce(F.col("least.total"), own)
    interiors = F.filter(F.coalesce(_at(d, "listInterior").try_cast("array<string>"), F.array().cast("array<string>")), lambda c: _is_object(_at(d, c)))
    return each.select(
        key, "model_id", "model_name", "variant_code", F.coalesce(_text(d, "label"), F.lit("")).alias("edition_name"), "is_option",
        F.when(F.col("is_option"), F.coalesce(F.nullif(_text(d, "imageEdition"), F.lit("")), F.substring_index("variant_code", "_", 1))).otherwise("").alias("base_edition"),
        price.alias("price"), F.coalesce(F.col("least.shown"), own_shown).alias("price_shown"), F.coalesce(_text(d, "optionsName"), F.lit("")).alias("options_name"),
        F.transform("colours", lambda c: F.struct(c.code, c.label, c.hex, c.total, F.greatest(F.lit(0), c.total - price).alias("extra"))).alias("colours"),
        F.transform(interiors, lambda c: F.struct(c.alias("code"), F.coalesce(_text(d, c, "label"), F.lit("")).alias("label"))).alias("interiors"),
    )


def options(rows: DataFrame, key: str) -> DataFrame:
    """One row for each value of a model's options, per edition; an option that an edition lists again adds nothing."""
    tvf = rows.sparkSession.tvf
    models = _models(rows, key)
    lists = models.lateralJoin(tvf.variant_explode(_at(F.col("data").outer(), "productOptions"))).select(key, "model_id", F.col("pos").alias("list_no"), F.col("value").alias("l"))
    each = lists.lateralJoin(tvf.variant_explode(_at(F.col("l").outer(), "options"))).select(key, "model_id", F.coalesce(_text(F.col("l"), "edition"), F.lit("")).alias("edition"), "list_no", "pos", F.col("value").alias("o"))
    each = each.withColumn("option_id", _text(F.col("o"), "id"))
    first = Window.partitionBy(key, "model_id", "edition", "option_id").orderBy("list_no", "pos")
    each = each.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "pos", "list_no")
    name = F.coalesce(F.nullif(_text(F.col("o"), "name"), F.lit("")), _text(F.col("o"), "label"), F.lit(""))
    values = each.lateralJoin(tvf.variant_explode(_at(F.col("o").outer(), "values")))
    value = F.col("value")
    return values.select(key, "model_id", "edition", "option_id", name.alias("option_name"), _text(value, "id").alias("value_id"), F.coalesce(_text(value, "displayValue"), F.lit("")).alias("value_name"), _amount(_at(value, "price")).alias("price_extra"))

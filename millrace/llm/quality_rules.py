"""Quality rules: base statistics of whole texts, then robust multivariate outliers.

Per language and source the minimum covariance determinant (MCD) of transformed statistics is
estimated by concentration steps from three starts: medians and quartile ranges, all rows, and the
rows near the medians. Each step takes the mean and covariance of the three quarters of the rows with
the smallest Mahalanobis distances; a start is followed until its determinant stops falling, and the
start that ends with the least determinant wins. Rows whose distance under that estimate exceeds a
chi-square cutoff are rejected.

All of it is DataFrame expressions. The statistics are rounded to integers, so sums are exact and
reruns agree; the three-quarter threshold comes from a histogram of distances, so no group meets in
one task. Groups with fewer than `MIN_ROWS` rows that pass the base rules use their language's
estimate, and languages with fewer have none (only the base rules then decide).

Defined results: a null or empty text has zeros everywhere and fails the base rules; null languages
and sources are groups of their own; repeated rows count each; an empty table gives no rows; texts of
any length count whole. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MIN_ROWS = 60
#: A step counts as a fall of the determinant if it is less than this share of the one before.
FALL = 0.999999999
#: Chi-square with 4 degrees of freedom at 0.99999, and the consistency factor of a three-quarter subset there.
CUTOFF, CONSISTENCY = 28.47, 1.485
#: Thousandths, as the statistics are held in: the least spread that a statistic is taken to have.
LEAST = (30, 100, 50, 100)
DIMS = (1, 2, 3, 4)
LOWER = [(i, j) for i in DIMS for j in range(1, i + 1)]
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# These expressions mean the same in Spark's SQL and in the oracle's.
VALUES = {
    "x1": "CAST(floor(1000 * ln(CAST(word_chars AS DOUBLE) / n_words) + 0.5) AS BIGINT)",
    "x2": "CAST(floor(1000 * sqrt(CAST(n_symbols AS DOUBLE) / n_words) + 0.5) AS BIGINT)",
    "x3": "CAST(floor(1000 * sqrt(CAST(n_dup_lines AS DOUBLE) / n_words) + 0.5) AS BIGINT)",
    "x4": "CAST(floor(1000 * sqrt(CAST(n_repeat_words AS DOUBLE) / n_words) + 0.5) AS BIGINT)",
}
FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
SUMS = {"n": "count(*)"} | {f"s{i}": f"CAST(sum(x{i}) AS DOUBLE)" for i in DIMS} | {f"s{i}{j}": f"CAST(sum(x{i} * x{j}) AS DOUBLE)" for i, j in LOWER}
_COV = {f"c{i}{j}": f"(s{i}{j} / n - m{i} * m{j}) * {CONSISTENCY}" + (f" + {LEAST[i - 1] ** 2}.0" if i == j else "") for i, j in LOWER}


def _cholesky() -> list[dict[str, str]]:
    layers = []
    for i, j in sorted(LOWER, key=lambda x: (x[1], x[0])):
        minus = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
        layers.append({f"l{i}{j}": f"sqrt(c{i}{j}{minus})" if i == j else f"(c{i}{j}{minus}) / l{j}{j}"})
    return layers


MOMENTS = [{f"m{i}": f"s{i} / n" for i in DIMS}, _COV, *_cholesky()]
START = {f"m{i}": f"CAST(q{i}50 AS DOUBLE)" for i in DIMS} | {
    f"l{i}{j}": f"sqrt((q{i}75 - q{i}25) / 1.349 * ((q{i}75 - q{i}25) / 1.349) + {LEAST[i - 1] ** 2}.0)" if i == j else "0.0E0" for i, j in LOWER
}
BOX = " AND ".join(f"abs(x{i} - q{i}50) <= greatest(1.5E0 * (q{i}75 - q{i}25), {LEAST[i - 1]}.0E0)" for i in DIMS)
PARAMETERS = [*[f"m{i}" for i in DIMS], *[f"l{i}{j}" for i, j in LOWER]]
DISTANCE = [{f"y{i}": f"(x{i} - m{i}{''.join(f' - l{i}{j} * y{j}' for j in range(1, i))}) / l{i}{i}"} for i in DIMS] + [{"d2": "y1 * y1 + y2 * y2 + y3 * y3 + y4 * y4"}]
DETERMINANT = " * ".join(f"l{i}{i} * l{i}{i}" for i in DIMS)
BUCKET = "CAST(floor(CASE WHEN d2 < 4096 THEN d2 ELSE 4096 END * 64) AS BIGINT)"


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds the base statistics of `text`; an array of the words and what comes of it live only inside a row."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(common.SPACE)) != "")
    rows = docs.withColumns(
        {
            "word_chars": F.length(F.translate(text, common.SPACE, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "_lines": lines,
            "_words": F.when(F.btrim(text, F.lit(common.SPACE)) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim(text, F.lit(common.SPACE)), common.SPACE_RE)),
        }
    ).drop("text")
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_grams": F.expr("CASE WHEN size(_words) > 2 THEN transform(slice(_words, 1, size(_words) - 2), (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2))) ELSE CAST(array() AS ARRAY<BIGINT>) END"),
        }
    ).drop("_words", "_lines")
    # Where windows repeat: sorted by hash, the places of repeated ones, in order; each covers the words up to the next, 3 at most.
    covered = F.expr(
        """CASE WHEN size(_grams) = size(array_distinct(_grams)) THEN 0L ELSE
        aggregate(
          sort_array(flatten(transform(array(sort_array(transform(_grams, (h, i) -> struct(h, i)))), s ->
            transform(filter(s, (x, k) -> (k > 0 AND get(s, k - 1).h = x.h) OR coalesce(get(s, k + 1).h = x.h, false)), x -> x.i)))),
          struct(0L AS total, -3 AS before),
          (a, i) -> struct(a.total + least(3, i - a.before) AS total, i AS before),
          a -> a.total) END"""
    )
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("_grams")


def _layered(df: DataFrame, layers: list[dict[str, str]]) -> DataFrame:
    for layer in layers:
        df = df.withColumns({k: F.expr(v) for k, v in layer.items()})
    return df


def _joined(rows: DataFrame, per_group: DataFrame, by: list[str] | str = "g") -> DataFrame:
    return rows.join(F.broadcast(per_group) if common.has_rows_within(per_group, 50_000) else per_group, by)


def _quartiles(rows: DataFrame) -> DataFrame:
    """Per group and statistic, from counts of the (boundedly many) rounded values."""
    counts = rows.select("g", F.expr(f"stack(4, {', '.join(f'{i}, x{i}' for i in DIMS)}) AS (d, x)")).groupBy("g", "d", "x").count()
    by = Window.partitionBy("g", "d")
    at = counts.withColumns({"below": F.sum("count").over(by.orderBy("x")), "n": F.sum("count").over(by)})
    wide = at.groupBy("g").agg(
        *[F.min(F.when((F.col("d") == i) & (100 * F.col("below") >= q * F.col("n")), F.col("x"))).alias(f"q{i}{q}") for i in DIMS for q in (25, 50, 75)]
    )
    return wide


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    return _layered(rows.groupBy(*by).agg(*[F.expr(v).alias(k) for k, v in SUMS.items()]), [*MOMENTS, {"det": DETERMINANT}]).select(*by, *PARAMETERS, "det")


def _starts(rows: DataFrame) -> DataFrame:
    """(g, start, location and lower Cholesky factor) of the three starts; a group without a row near its medians lacks the third."""
    quartiles = common.cut(_quartiles(rows))
    made = [_layered(quartiles, [START]), _moments(rows, "g"), _moments(_joined(rows, quartiles).where(BOX), "g")]
    made = [x.select("g", F.lit(k).alias("start"), *PARAMETERS) for k, x in enumerate(made, 1)]
    return made[0].unionByName(made[1]).unionByName(made[2])


def mcd(rows: DataFrame) -> DataFrame:
    """(g, location, lower Cholesky factor) of rows (g, x1..x4), which are read a few times."""
    fit = common.cut(_starts(rows).withColumns({"det": F.lit(float("inf")), "moving": F.lit(True)}))
    by = Window.partitionBy("g", "start")
    while not fit.where("moving").isEmpty():
        near = _layered(_joined(rows, fit.where("moving").select("g", "start", *PARAMETERS)), DISTANCE).select("g", "start", "x1", "x2", "x3", "x4", F.expr(BUCKET).alias("b"))
        counts = near.groupBy("g", "start", "b").count()
        inner = counts.withColumns({"below": F.sum("count").over(by.orderBy("b")), "n": F.sum("count").over(by)}).where("4 * below >= 3 * n").groupBy("g", "start").agg(F.min("b").alias("h"))
        step = _moments(_joined(near, inner, ["g", "start"]).where("b <= h"), "g", "start")
        step = step.select("g", "start", *[F.col(c).alias(f"new_{c}") for c in (*PARAMETERS, "det")])
        fell = F.coalesce(F.col("new_det") < F.col("det") * FALL, F.lit(False))
        both = fit.join(step, ["g", "start"], "left").withColumn("fell", fell)
        fit = common.cut(both.select("g", "start", *[F.when(F.col("fell"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in (*PARAMETERS, "det")], F.col("fell").alias("moving")))
    best = Window.partitionBy("g").orderBy("det", "start")
    return common.cut(fit.withColumn("n", F.row_number().over(best)).where("n = 1").select("g", *PARAMETERS))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, d2 (null where there is no estimate) and kept."""
    base = with_statistics(docs.select("doc_id", "text", "lang", "source")).withColumn("base_failed", F.expr(FAILED))
    one, two = F.coalesce("lang", F.lit("\0")), F.coalesce("source", F.lit("\0"))
    stats = common.cut(base.select("doc_id", *STATS, "base_failed", one.alias("g1"), F.concat_ws("\x01", one, two).alias("g2")))
    fine = _layered(stats.where("not base_failed"), [VALUES])
    both = fine.select(F.explode(F.array("g1", "g2")).alias("g"), "x1", "x2", "x3", "x4")
    known = common.cut(both.groupBy("g").count().where(F.col("count") >= MIN_ROWS).select("g"))
    fit = mcd(_joined(both, known))
    few = common.has_rows_within(fit, 50_000)
    scored = []
    for k in ("g1", "g2"):
        named = fit.select(F.col("g").alias(f"{k}_g"), F.struct(*PARAMETERS).alias(f"{k}_fit"))
        scored.append(F.broadcast(named) if few else named)
    out = _layered(stats, [{k: f"CASE WHEN NOT base_failed THEN {v} END" for k, v in VALUES.items()}])
    out = out.join(scored[1], F.col("g2") == F.col("g2_g"), "left").join(scored[0], F.col("g1") == F.col("g1_g"), "left")
    out = out.withColumn("_fit", F.coalesce("g2_fit", "g1_fit")).select("doc_id", *STATS, "base_failed", "x1", "x2", "x3", "x4", "_fit.*")
    return _layered(out, DISTANCE).select("doc_id", *STATS, "base_failed", "d2", F.expr(f"NOT base_failed AND coalesce(d2 <= {CUTOFF}, true)").alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality_verdicts(common.table(spark, sf_dir, "documents")).select("doc_id", *STATS, "base_failed", "kept")


def oracle() -> str:
    """The same in DuckDB SQL, without hashes or buckets where plain SQL has no need of them."""
    ctes = [
        r"""d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(0)) AS g1, concat(coalesce(lang, chr(0)), chr(1), coalesce(source, chr(0))) AS g2,
  coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)""",
        "p AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d)",
        "g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM p)",
        "u AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY r)",
        r"""l AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r)""",
        r"""b AS (SELECT doc_id, g1, g2, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(u.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN l USING (r) LEFT JOIN u USING (r))""",
        f"st AS (SELECT *, {FAILED} AS base_failed FROM b)",
        "f AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in VALUES.items()) + " FROM st WHERE NOT base_failed)",
        f"x0 AS (SELECT g1 AS g, x1, x2, x3, x4 FROM f WHERE g1 IN (SELECT g1 FROM f GROUP BY g1 HAVING count(*) >= {MIN_ROWS})"
        f" UNION ALL SELECT g2, x1, x2, x3, x4 FROM f WHERE g2 IN (SELECT g2 FROM f GROUP BY g2 HAVING count(*) >= {MIN_ROWS}))",
    ]

    def layered(source: str, layers: list[dict[str, str]]) -> str:
        for layer in layers:
            source = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in layer.items())} FROM {source})"
        return source

    quart = ", ".join(f"quantile_disc(x{i}, {q / 100}) AS q{i}{q}" for i in DIMS for q in (25, 50, 75))
    ctes.append(f"qs AS (SELECT g, {quart} FROM x0 GROUP BY g)")
    sums = ", ".join(f"{v} AS {c}" for c, v in SUMS.items())
    starts = [layered("qs", [START]), layered(f"(SELECT g, {sums} FROM x0 GROUP BY g)", MOMENTS), layered(f"(SELECT g, {sums} FROM x0 JOIN qs USING (g) WHERE {BOX} GROUP BY g)", MOMENTS)]
    first = " UNION ALL ".join(f"SELECT g, {k} AS start, 0 AS step, 'infinity'::DOUBLE AS det, {', '.join(PARAMETERS)} FROM {x}" for k, x in enumerate(starts, 1))
    near = f"(SELECT g, start, step, det, x1, x2, x3, x4, {BUCKET} AS b FROM {layered('(x0 JOIN fall USING (g))', DISTANCE)})"
    ranked = f"(SELECT *, count(*) OVER (PARTITION BY g, start ORDER BY b) AS below, count(*) OVER (PARTITION BY g, start) AS n FROM {near})"
    inside = f"(SELECT * FROM (SELECT *, min(CASE WHEN 4 * below >= 3 * n THEN b END) OVER (PARTITION BY g, start) AS h FROM {ranked}) WHERE b <= h)"
    stepped = layered(f"(SELECT g, start, any_value(step) AS step, any_value(det) AS before, {sums} FROM {inside} GROUP BY g, start)", [*MOMENTS, {"det": DETERMINANT}])
    ctes.append(f"fall AS ({first} UNION ALL SELECT g, start, step + 1, det, {', '.join(PARAMETERS)} FROM {stepped} WHERE det < before * {FALL})")
    ctes.append("fit AS (SELECT * FROM fall QUALIFY row_number() OVER (PARTITION BY g ORDER BY det, start, step DESC) = 1)")
    last = "fit"
    both = "SELECT st.*, " + ", ".join(f"coalesce(a.{c}, z.{c}) AS {c}" for c in PARAMETERS)
    both += ", " + ", ".join(f"CASE WHEN NOT base_failed THEN {v} END AS {k}" for k, v in VALUES.items())
    ctes.append(f"o AS ({both} FROM st LEFT JOIN {last} a ON st.g2 = a.g LEFT JOIN {last} z ON st.g1 = z.g)")
    columns = ", ".join(["doc_id", *STATS, "base_failed"])
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT {columns}, NOT base_failed AND coalesce(d2 <= {CUTOFF}, true) AS kept FROM {layered('o', DISTANCE)}"


ORACLE = oracle()

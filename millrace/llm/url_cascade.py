"""Rules for hosts and paths, matched through a cascade of Bloom filters.

A url's keys are its host and each parent domain, each with every beginning of its path that is as
long as some rule's path. Level 1 holds the listed keys; level 2 those keys of the corpus that level 1
takes wrongly; level 3 the listed ones that level 2 takes wrongly; and so on until none is taken
wrongly. Over the complete key universe of the corpus membership is therefore exact, and a url is
judged in its row: no join. A second cascade, over the listed keys that occur, tells block from allow.

Keys are known by two 64-bit hashes. The filters are built by aggregation and go through the driver,
MOST_BITS at most; longer lists are joined with the keys by equality instead.

Defined results: host and path as in `parts`; a null url, or one without `://`, has an empty host and
path; a rule fits its host and all subdomains, where the path starts with the rule's; the longest wins
(host and path together, then the longer host); a key listed as both is blocked; A-Z in rules' hosts
count as a-z, a null path as empty, rules with a null host or a verdict other than allow and block are
ignored; without a rule that fits, `unlisted` is the verdict. Urls of any length are judged whole;
repeated rows each; empty tables give no rows. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits per key of the first level and of the others, and the most that a filter may have in all (16 MB).
FIRST_BITS, MORE_BITS, MOST_BITS = 12, 3, 1 << 27
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host: from the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end."""
    found = [F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2)]
    return F.translate(found[0], UPPER, LOWER), found[1]


@dataclass
class Level:
    seed: int
    n_bits: int
    n_hashes: int
    words: Broadcast | np.ndarray | None = None

    @classmethod
    def for_keys(cls, seed: int, n: int, bits_per_key: int) -> Level:
        return cls(seed, max(64, -(-n * bits_per_key // 64) * 64), max(1, round(bits_per_key * math.log(2))))

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            salt = common.mix64(np.array([self.seed], np.uint64))
            a, b = common.mix64(h1 ^ salt), common.mix64(h2 + salt) | np.uint64(1)
            for i in range(self.n_hashes):
                yield (a + np.uint64(i) * b) % np.uint64(self.n_bits)

    def bits(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n_bits // 64, np.uint64)
        for p in self._places(h1, h2):
            np.bitwise_or.at(out, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        return out

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        words = self.words.value if isinstance(self.words, Broadcast) else self.words
        tests = ((words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool) for p in self._places(h1, h2))
        return functools.reduce(operator.and_, tests)


def listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether the keys are listed: the number of levels that take one, one after the other, is odd."""
    out, left = np.zeros(len(h1), bool), np.arange(len(h1))
    for n, level in enumerate(levels):
        left = left[level.holds(h1[left], h2[left])]
        out[left] = n % 2 == 0
    return out


def _hashes(host: Column, path: Column) -> list[Column]:
    return [F.xxhash64(host, path).alias("h1"), F.xxhash64(F.lit(17), host, path).alias("h2")]


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def _taken(keys: DataFrame, level: Level) -> DataFrame:
    """The distinct (h1, h2) that a level takes, from arrays of such keys or single ones."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair = [x.flatten() if pa.types.is_list(x.type) else x for x in (b.column("h1"), b.column("h2"))]
            h = np.unique(np.stack([_unsigned(x) for x in pair], 1), axis=0)
            h = h[level.holds(h[:, 0], h[:, 1])].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1])], names=["h1", "h2"])

    return common.cut(common.in_batches(keys, test, "h1 long, h2 long").distinct())


def _filled(keys: DataFrame, level: Level) -> Level:
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(level.n_bits // 64, np.uint64)
        for b in batches:
            words |= level.bits(_unsigned(b.column("h1")), _unsigned(b.column("h2")))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at].view(np.int64))], names=["word", "bits"])

    found = keys.select("h1", "h2").mapInArrow(fill, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(level.n_bits // 64, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    level.words = keys.sparkSession.sparkContext.broadcast(words)
    return level


def cascade(keys: DataFrame, universe: DataFrame, first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS) -> tuple[list[Level], DataFrame]:
    """Levels that tell the distinct (h1, h2) of `keys` from all others in `universe`; and the keys that occur in it."""
    levels = [_filled(keys, Level.for_keys(1, keys.count(), first_bits))]
    taken = _taken(universe, levels[0])
    inside = common.cut(keys.join(taken, ["h1", "h2"], "left_semi"))
    before, now = inside, common.cut(taken.join(keys, ["h1", "h2"], "left_anti"))
    while n := now.count():
        if len(levels) == 64:
            raise RuntimeError("two keys with the same hashes")
        levels.append(_filled(now, Level.for_keys(len(levels) + 1, n, more_bits)))
        before, now = now, _taken(before, levels[-1])
    return levels, inside


def _keys(host: str, path: str, lengths: list[int], most_labels: int) -> Column:
    """The keys of a url as an array of structs, the longest first."""
    n = f"length(`{host}`) - length(replace(`{host}`, '.', '')) + 1"
    suffixes = F.expr(f"transform(sequence(1, least({most_labels}, {n})), i -> substring_index(`{host}`, '.', -i))")
    fits = F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length(path))

    def with_beginnings(s: Column) -> Column:
        return F.transform(fits, lambda k: F.struct((-F.length(s) - k).alias("size"), (-F.length(s)).alias("host_size"), s.alias("host"), F.left(F.col(path), k).alias("path")))

    return F.array_sort(F.flatten(F.transform(suffixes, with_beginnings)))


def _rules(rules: DataFrame) -> DataFrame:
    """Distinct host and path with their hashes, and whether they are blocked."""
    known = rules.where("host is not null and verdict in ('allow', 'block')")
    cleaned = known.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), (F.col("verdict") == "block").alias("block"))
    return cleaned.groupBy("host", "path").agg(F.max("block").alias("block")).select("*", *_hashes(F.col("host"), F.col("path")))


def judged(pages: DataFrame, rules: DataFrame, unlisted: str = "allow", first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS, most_bits: int = MOST_BITS) -> tuple[DataFrame, str, str, str, str]:
    """pages (url) with four more columns, whose names follow: host, path, rule (or null), verdict. rules: host, path, verdict."""
    host, path, rule, verdict, keys, found, row, pos = common.unused(pages, "host", "path", "rule", "verdict", "keys", "found", "row", "pos")
    listing = common.cut(_rules(rules))
    rows = pages.withColumns(dict(zip([host, path], parts(F.col("url")))))
    sizes = listing.agg(F.count("*"), F.collect_set(F.length("path")), F.max(F.size(F.split("host", "[.]", -1)))).first()
    n, lengths, labels = sizes[0], sorted(sizes[1]), sizes[2]
    if not n:
        return rows.withColumns({rule: F.lit(None).cast("string"), verdict: F.lit(unlisted)}), host, path, rule, verdict
    best = F.col(found)
    if n * first_bits <= most_bits:
        hashed = lambda i: F.transform(keys, lambda k: _hashes(k.host, k.path)[i])
        universe = rows.select(_keys(host, path, lengths, labels).alias(keys)).select(hashed(0).alias("h1"), hashed(1).alias("h2"))
        levels, inside = cascade(listing.select("h1", "h2"), universe, first_bits, more_bits)
        blocked, _ = cascade(common.cut(inside.join(listing.where("block").select("h1", "h2"), ["h1", "h2"])), inside, first_bits, more_bits)

        @F.arrow_udf("int")
        def first_listed(a: pa.Array, b: pa.Array) -> pa.Array:
            """1 + twice the place of the first listed key, one more if it is blocked; 0 without any."""
            h1, h2, ends = _unsigned(a.flatten()), _unsigned(b.flatten()), np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False))
            at = np.flatnonzero(listed(levels, h1, h2))
            doc = np.searchsorted(ends, at, side="right")
            doc, first = np.unique(doc, return_index=True)
            at = at[first]
            starts = ends - a.value_lengths().to_numpy(zero_copy_only=False)
            out = np.zeros(len(a), np.int32)
            out[doc] = 2 * (at - starts[doc] + 1) + listed(blocked, h1[at], h2[at])
            return pa.array(out)

        rows = rows.withColumn(keys, _keys(host, path, lengths, labels)).withColumn(found, first_listed(hashed(0), hashed(1)))
        key = F.get(keys, F.shiftright(found, 1) - 1)
        return rows.withColumns({rule: F.concat(key.host, key.path), verdict: _verdict(best, unlisted)}).drop(keys, found), host, path, rule, verdict
    rows = common.stored(rows.withColumn(row, F.monotonically_increasing_id()), "pages")
    each = rows.select(row, F.posexplode(_keys(host, path, lengths, labels)).alias(pos, keys))
    each = each.select(row, pos, F.col(keys).host.alias("h"), F.col(keys).path.alias("p"))
    hits = each.join(listing.select(F.col("host").alias("h"), F.col("path").alias("p"), "block"), ["h", "p"])
    won = hits.groupBy(row).agg(F.min(F.struct(pos, "h", "p", (2 + F.col("block").cast("int")).alias("code"))).alias(keys))
    won = won.select(row, F.concat(F.col(keys).h, F.col(keys).p).alias(rule), F.col(keys).code.alias(found))
    return rows.join(won, row, "left").withColumn(verdict, _verdict(F.coalesce(best, F.lit(0)), unlisted)).select(*pages.columns, host, path, rule, verdict), host, path, rule, verdict


def _verdict(found: Column, unlisted: str) -> Column:
    return F.when(found == 0, unlisted).when(found % 2 == 1, "block").otherwise("allow")


#: The rules of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; what no rule lists is allowed."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows, *names = judged(common.table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return rows.select("page_id", *[F.col(c).alias(n) for c, n in zip(names, ("host", "path", "rule", "verdict"))])


ORACLE = rf"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(map(str, RULES))}),
p AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
f AS (
  SELECT p.r, arg_max((rules.host || rules.path, rules.verdict), (length(rules.host || rules.path), length(rules.host))) AS best
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path) GROUP BY p.r)
SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], 'allow') AS verdict FROM p LEFT JOIN f USING (r)
"""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import url_cascade as U


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path


def plain(url, rules, unlisted="allow"):
    host, path = split(url)
    fits = [(len(h) + len(p), len(h), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], ("block" if best[2] else "allow") if best else unlisted


def many(n=300):
    r = random.Random(6)
    names = [f"{a}.{b}" for a in ("shop", "news", "x", "a.b.c") for b in ("com", "net", "co.uk", "org")] + ["com", "net", "uk"]
    paths = ["", "/", "/a", "/a/", "/ab/c", "/en/", "/en/x/y", "/%7E", "/é/"]
    rules = [(r.choice(names), r.choice(paths), r.choice(["allow", "block"])) for _ in range(60)]
    urls = [f"{r.choice(['http', 'https'])}://{r.choice(['', 'www.', 'M.', 'x.y.'])}{r.choice(names)}{r.choice(paths)}{r.choice(['', '1', '/z'])}{r.choice(['', '?q=/a', '#f', '?a#b'])}" for _ in range(n)]
    urls += [None, "", "no scheme", "://", "http://", "http://?x", "http://com", "http://xcom/", "http://.com/", "http://com./", "HTTP://NEWS.Com/a://b/", "http://a\nb.com/en/\nx", "http://" + "a." * 5000 + "com/" + "p" * 50_000]
    return rules, urls + urls[:20]


@pytest.mark.parametrize("first_bits,more_bits,most_bits", [(12, 3, 1 << 27), (1, 1, 1 << 27), (12, 3, 0)])
def test_against_plain_rules(spark, first_bits, more_bits, most_bits):
    rules, urls = many()
    frame = spark.createDataFrame([(i, u, "h", 1, 2) for i, u in enumerate(urls)], "page_id long, url string, _host string, _keys int, _found int").repartition(4)
    listing = spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block"), ("org", "/", "maybe")], "host string, path string, verdict string")
    both = {(h, p): "block" for h, p, v in [*rules, ("com", "", "block")] if v == "block"}
    exact = [(h, p, both.get((h, p), "allow")) for h, p, _ in [*rules, ("com", "", "block")]]
    rows, *names = U.judged(frame, listing, "allow", first_bits, more_bits, most_bits)
    assert rows.columns == [*frame.columns, *names]
    got = {r.page_id: tuple(r[c] for c in names) for r in rows.collect()}
    assert got == {i: plain(u, exact) for i, u in enumerate(urls)}


def test_levels_alternate_until_none_is_wrong(spark):
    keys = spark.range(0, 400).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"))
    universe = spark.range(100, 5000).select(F.array(F.xxhash64("id")).alias("h1"), F.array(F.xxhash64(F.lit(1), "id")).alias("h2"))
    levels, inside = U.cascade(keys, universe, 2, 1)
    assert len(levels) > 3 and inside.count() == 300
    rows = universe.select(F.get("h1", F.lit(0)), F.get("h2", F.lit(0))).collect()
    h1, h2 = (np.array([r[i] for r in rows], np.int64).view(np.uint64) for i in (0, 1))
    assert U.listed(levels, h1, h2).tolist() == [i < 400 for i in range(100, 5000)]


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    assert U.judged(pages.limit(0), rules)[0].collect() == []
    assert [tuple(r) for r in U.judged(pages, rules.limit(0), "block")[0].collect()] == [(1, "http://a.com/", "a.com", "/", None, "block")]

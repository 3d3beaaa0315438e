"""Exact near-duplicate join on word shingles: parity sketches, pigeonhole blocks, verification.

Every shingle flips one bit of a (long, sparse) parity sketch, so the Hamming distance of two
sketches is at most the size of the sets' symmetric difference. At Jaccard 3/4 sets of a and b
shingles differ in at most d = (a + b) / 7 of them. The sketch of a size band is cut into B blocks;
sketches at distance d or less agree in B - d blocks at least, so if every document keeps the first
d + 1 of its blocks in one order that all documents share, two linked documents keep a common block
(the pigeonhole and prefix principles together: exact, for any order). The order puts blocks that a
bounded sample finds frequent late and empty blocks last, which keeps buckets small.

Equal sets are one node from the start. Buckets with the same members are one. First every set is
verified, on the whole sets, against one hub (a hub is the member of a bucket that most other
buckets have too, as the original of many copies), the one that it shares most blocks with, and
components are formed; large groups of near copies are one component after that. Then the buckets
that still hold several components are searched for pairs across these by the Hamming distance of
short parity sketches and by size, and the pairs that pass are verified too; a bucket of more than
`BUCKET` members is dealt into parts, and each two of its parts are searched by a task of their own.
So no link between different components is lost, and no bucket is expanded into all of its pairs.

Defined results: null and empty texts and texts without words have no shingles and are linked with
nothing; a null doc_id takes part but is never a component's name unless all of its ids are null;
repeated rows are copies; an empty table gives no rows. Extra columns are ignored. Shingles and
sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

#: Documents whose blocks are counted to find frequent ones, and how many of those are remembered. Only the order depends on it.
SAMPLE, FREQUENT = 4000, 100_000
#: Candidates' ids are broadcast up to this many (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Sets that share fewer blocks than this are left to the search by sketches.
SHARED = 4
#: So many buckets of each set are known in all of its buckets, to search a pair in the first that both have.
FIRST = 10
#: Members of a contested bucket that are searched as one; a larger one is dealt into parts of about this size.
BUCKET = 4096
_U = np.uint64


def set_id(h: np.ndarray) -> int:
    """A 64-bit name of a sorted set of hashes."""
    with np.errstate(over="ignore"):
        x = np.bitwise_xor.reduce(common.mix64(h * common.M64 + _U(1))) if len(h) else _U(0)
        return int(common.mix64(np.array([x + _U(len(h))]))[0].view(np.int64))


def tables_of(n: int) -> list[tuple[int, int, int]]:
    """(table, blocks, blocks to keep) for a set of n shingles: its own size band, and the one below if partners can be there."""
    if n < 3:
        return []
    t, low = 0, 3
    while n >= 4 * low:
        t, low = t + 1, 4 * low
    own = [(t, 4 * low, n // 3 + 1)]
    return own + ([(t - 1, low, (n + low - 1) // 7 + 1)] if t and 3 * n < 4 * low else [])


def blocks(h: np.ndarray, table: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(block numbers, keys) of the non-empty blocks of a sorted set's parity sketch; a key names table, block and bits."""
    block = ((h >> _U(32)) * _U(count)) >> _U(32)
    start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    with np.errstate(over="ignore"):
        bits = np.bitwise_xor.reduceat(common.mix64(h + _U(table)), start)
        return block[start], common.mix64(bits + block[start] * common.M64 + _U(table << 48))


def kept_keys(h: np.ndarray, table: int, count: int, keep: int, heavy: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """The first `keep` blocks in the common order: by frequency (0 if not known), then key; empty ones last, by number."""
    number, keys = blocks(h, table, count)
    if len(keys) > keep:
        late = np.zeros(len(keys), np.int64)
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)
            late = np.where(heavy[at] == keys, freq[at], 0)
        if not late.any():
            return np.partition(keys, keep - 1)[:keep]
        return keys[np.lexsort((keys, late))[:keep]]
    empty = np.setdiff1d(np.arange(count, dtype=np.uint64), number)[: keep - len(keys)]
    return np.append(keys, common.mix64(empty + _U(table << 48) + _U(1 << 47)))


def _arrow(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [common.shingle_hashes(t) for t in b.column("text").to_pylist()]
        yield _arrow("doc_id n sid", b.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(map(set_id, sets), pa.int64()))


def _key_rows(heavy: np.ndarray, freq: np.ndarray, every: bool):
    """(key, sid) of each distinct set that a task meets: the kept blocks, or every non-empty one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            keys, sids = [], []

            def made():
                sizes = np.array([len(k) for k in keys])
                return _arrow("key sid", np.concatenate(keys).view(np.int64), np.repeat(np.array(sids, np.int64), sizes))

            for t in b.column("text").to_pylist():
                h = common.shingle_hashes(t)
                sid = set_id(h)
                if sid in met or len(h) < 3:
                    continue
                if len(met) > 500_000:
                    met.clear()
                met.add(sid)
                for table, count, keep in tables_of(len(h)):
                    keys.append(blocks(h, table, count)[1] if every else kept_keys(h, table, count, keep, heavy, freq))
                    sids.append(sid)
                if sum(map(len, keys[-200:])) > 200_000 or len(keys) >= 2000:
                    yield made()
                    keys, sids = [], []
            if keys:
                yield made()

    return rows


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, sid): (key, rep, sid) of all but the least sid of each key, once each."""
    last_key, last_rep, last_sid = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        key, sid = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sid"))
        new = np.append(last_key is None or key[0] != last_key, key[1:] != key[:-1])
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        rep = np.where(at >= 0, sid[at], last_rep)
        again = ~new & (sid == np.append(last_sid, sid[:-1]))
        last_key, last_rep, last_sid = key[-1], rep[-1], sid[-1]
        out = np.flatnonzero((rep != sid) & ~again)
        if len(out):
            yield _arrow("key rep sid", key[out], rep[out], sid[out])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [common.shingle_hashes(t) for t in b.column("text").to_pylist()]
        yield _arrow("sid hashes", pa.array(map(set_id, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
            p, q = np.frombuffer(x, _U), np.frombuffer(y, _U)
            same = 0
            if 4 * min(len(p), len(q)) >= 3 * max(len(p), len(q)):
                at = np.minimum(np.searchsorted(p, q), len(p) - 1)
                same = int((p[at] == q).sum())
            out.append(100 * same >= 75 * (len(p) + len(q) - same))
        yield _arrow("a b linked", b.column("a"), b.column("b"), pa.array(out, pa.bool_()))


def parity_sketch(h: np.ndarray, bits: int) -> np.ndarray:
    """The parity sketch of `bits` bits as bytes: every hash flips one bit."""
    flips = np.bincount(((h & _U(0xFFFFFFFF)) * _U(bits) >> _U(32)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(bool))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sid, n, bits = [], [], []
        for t in b.column("text").to_pylist():
            h = common.shingle_hashes(t)
            for _, count, _ in tables_of(len(h)):
                sid.append(set_id(h)), n.append(len(h)), bits.append(parity_sketch(h, count).tobytes())
        yield _arrow("sid n sketch", pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary()))


def _near_in_bucket(n: np.ndarray, comp: np.ndarray, sketch: np.ndarray, first: np.ndarray, key: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different components that sizes and Hamming distance allow, a few rows at a time.

    first: some buckets of each row. Pairs that have one of them, below this key, in common belong to that bucket.
    side: the part of the bucket that each row is of; if given, only pairs of different parts.
    """
    order = np.argsort(n, kind="stable")
    upto = np.searchsorted(n[order], 4 * n[order] // 3, side="right")
    for i, o in enumerate(order[:-1]):
        rest = order[i + 1 : upto[i]]
        rest = rest[comp[rest] != comp[o]]
        if side is not None:
            rest = rest[side[rest] != side[o]]
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            apart = np.bitwise_count(sketch[part] ^ sketch[o]).sum(axis=1, dtype=np.int64)
            near = part[7 * apart <= n[part] + n[o]]
            if len(near):
                before = first[o][first[o] < key]
                near = near[~np.isin(first[near], before).any(axis=1)]
            if len(near):
                yield np.full(len(near), o), near


def _contested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and two parts of its bucket, each with its sketch: the pairs that are still to be verified."""

    def search(rows: list) -> Iterator[pa.RecordBatch]:
        task, sid, comp, n, first, side = (np.concatenate([r[i] for r in rows]) for i in range(6))
        sketch = [x for r in rows for x in r[6]]
        key, i, j = task[0].tolist()
        for width in {len(x) for x in sketch}:  # the bands that meet in a bucket have one width; others are sketches of another band
            at = np.flatnonzero([len(x) == width for x in sketch])
            bits = np.frombuffer(b"".join(sketch[i] for i in at), np.uint8).reshape(len(at), width)
            for p, q in _near_in_bucket(n[at], comp[at], bits, first[at], key, None if i == j else side[at]):
                yield _arrow("a b", np.minimum(sid[at][p], sid[at][q]), np.maximum(sid[at][p], sid[at][q]))

    open_rows: list = []
    for b in batches:
        if not b.num_rows:
            continue
        key, i, j, sid, comp, n, side = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "sid", "comp", "n", "side"))
        task = np.stack([key, i, j], axis=1)
        sketch = b.column("sketch").to_pylist()
        first = np.frombuffer(b"".join(b.column("first").to_pylist()), ">i8").astype(np.int64).reshape(len(key), FIRST)
        edges = [0, *(np.flatnonzero((task[1:] != task[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for s, e in zip(edges, edges[1:]):
            if open_rows and (open_rows[0][0][0] != task[s]).any():
                yield from search(open_rows)
                open_rows = []
            open_rows.append((task[s:e], sid[s:e], comp[s:e], n[s:e], first[s:e], side[s:e], sketch[s:e]))
    if open_rows:
        yield from search(open_rows)


def _made_again(docs: DataFrame, slim: DataFrame, sids: DataFrame, make, schema: str) -> DataFrame:
    """What `make` makes of the texts of the wanted sets, of one document each (more if an id repeats, which adds nothing later)."""
    none = F.lit(-(2**63))
    few = common.has_rows_within(sids, BROADCAST_IDS)
    one = common.cut(slim.join(F.broadcast(sids) if few else sids, "sid").groupBy("sid").agg(F.min(F.coalesce("doc_id", none)).alias("one")).select("one").distinct())
    texts = docs.select(F.coalesce("doc_id", none).alias("one"), "text").join(F.broadcast(one) if few else one, "one").select("text")
    made = common.in_batches(texts, make, schema)
    return made.join(F.broadcast(sids) if few else sids, "sid")


def _verified(docs: DataFrame, slim: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose whole sets are similar enough."""
    pairs = common.cut(pairs)
    named = common.cut(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    return common.cut(_links(pairs, common.cut(_made_again(docs, slim, named, _whole_sets, "sid long, hashes binary"))))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose whole sets are similar enough."""
    x, y = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long, linked boolean").where("linked").select("a", "b")


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n = docs.count()
    part = docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(max(1, n // SAMPLE))) == 0)
    keys = common.in_batches(part.select("text"), _key_rows(np.zeros(0, _U), np.zeros(0, np.int64), True), "key long, sid long").distinct()
    rows = keys.groupBy("key").count().where("count > 2").orderBy(F.desc("count"), "key").limit(FREQUENT).collect()
    heavy, freq = np.array([r.key for r in rows], np.int64).view(_U), np.array([r["count"] for r in rows], np.int64)
    order = np.argsort(heavy)
    return heavy[order], freq[order]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    slim = common.cut(common.in_batches(docs, _set_rows, "doc_id long, n long, sid long"))
    heavy, freq = _frequent(docs)
    keys = common.in_batches(docs.select("text"), _key_rows(heavy, freq, False), "key long, sid long")
    stars = common.stored(keys.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(_stars, "key long, rep long, sid long"), "stars")
    members = F.struct(F.bit_xor(F.xxhash64("sid")), F.sum(F.xxhash64("sid").cast("decimal(38,0)")), F.count("*"), F.min("rep"))
    buckets = stars.groupBy("key").agg(members.alias("members")).groupBy("members").agg(F.min("key").alias("key"), F.count("*").alias("blocks")).drop("members")
    rows = stars.join(buckets, "key")
    rows = common.stored(rows.select("key", "sid", "blocks").unionByName(rows.groupBy("key").agg(F.min("rep").alias("sid"), F.min("blocks").alias("blocks"))), "buckets")
    links = _verified(docs, slim, _with_hubs(rows))
    links = links.unionByName(_verified(docs, slim, _across(docs, slim, rows, components(links))))
    comps = components(links)
    canon = slim.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    comp = canon.join(comps.withColumnRenamed("id", "sid"), "sid", "left").select("sid", "least", F.coalesce("component", "sid").alias("component"))
    names = common.cut(comp.groupBy("component").agg(F.min("least").alias("component_id")))
    by_set = comp.join(names, "component").select("sid", "component_id")
    return slim.join(by_set, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _with_hubs(rows: DataFrame) -> DataFrame:
    """(a, b): every member b with the hub a that it shares most blocks with, if enough."""
    known = rows.groupBy("sid").agg(F.sum("blocks").alias("d"))
    hubs = rows.join(known, "sid").groupBy("key").agg(F.max_by("sid", F.struct("d", "sid")).alias("hub"))
    shared = rows.join(hubs, "key").where("sid <> hub").groupBy("hub", "sid").agg(F.sum("blocks").alias("n")).where(F.col("n") >= SHARED)
    return shared.groupBy(F.col("sid").alias("b")).agg(F.max_by("hub", F.struct("n", "hub")).alias("a"))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (key, sid, parts and more), each in its part (side) of its bucket, once for each pair i <= j of parts that its part is in."""
    side = F.pmod(F.xxhash64(F.lit(7), "sid"), F.col("parts"))
    rows = rows.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", "parts")


def _across(docs: DataFrame, slim: DataFrame, rows: DataFrame, comps: DataFrame) -> DataFrame:
    """(a, b): pairs of one bucket and of different components that sizes and sketches allow."""
    known = comps.withColumnRenamed("id", "sid")
    rows = common.stored(rows.join(known, "sid", "left").select("key", "sid", F.coalesce("component", "sid").alias("comp")), "members")
    apart = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.ceil(F.count("*") / BUCKET).cast("long").alias("parts")).where("x <> y").select("key", "parts")
    rows = common.stored(rows.join(apart, "key"), "contested")
    last = F.lit(2**63 - 1)
    first = F.slice(F.concat(F.array_sort(F.collect_set("key")), F.array_repeat(last, FIRST)), 1, FIRST)
    packed = F.aggregate(first, F.lit(b""), lambda acc, x: F.concat(acc, F.unhex(F.lpad(F.hex(x), 16, "0"))))
    known = common.stored(rows.groupBy("sid").agg(packed.alias("first")), "first")
    sketches = _made_again(docs, slim, known.select("sid"), _sketches, "sid long, n long, sketch binary")
    task = ("key", "i", "j")
    return _dealt(rows.join(known.join(sketches, "sid"), "sid")).repartition(*task).sortWithinPartitions(*task).mapInArrow(_contested, "a long, b long").distinct()


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of Jaccard 3/4 or more on 5-word shingles."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))

"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to, their pattern. In the corpus a text
belongs to every source that carries a copy of it. A flow routes token capacity from patterns to source
quotas at convex repetition costs: a pattern gives its texts once at no cost, a second time at cost
1, a third and fourth time at cost 2, up to eight times at cost 3 and so on, so that no text repeats
before all that can be reached were used. The cost of a path depends on its first edge alone, so the
cheapest flow comes from largest flows, one cost after the other. What a pattern gives to a source
is taken in whole rounds, and of the last, partial round as a seeded prefix of documents; what that and
the source's other patterns leave open is filled with later documents that still fit.

Defined results: null texts and texts without words have size 0 and are never taken; a null source
is a source of its own, ordered last; rows that tie (repeats of an id in a source) are told apart by
their text and then by their place in the table, so that a part of them can be taken (docs are read twice:
give a stored table, whose places don't change); texts of any length are taken or left whole; an empty table
gives no rows. Extra columns are ignored by the query and kept by `mixed_documents`, whatever their names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Rows of small tables (texts that several sources carry; plans) that are broadcast; beyond it they are joined by shuffle.
BROADCAST_TEXTS, BROADCAST_PLAN = 500_000, 50_000


def capped_shares(sizes: list[tuple[str | None, int]], weights: dict, most: int) -> dict:
    """Shares of the total by weight, none above most times its size; what is above goes to the rest by weight."""
    left, pot, out = sorted(sizes, key=lambda x: most * x[1] / weights[x[0]]), sum(n for _, n in sizes), {}
    heavy = sum(weights[s] for s, _ in sizes)
    for i, (s, n) in enumerate(left):
        level = pot / heavy
        if most * n >= level * weights[s]:
            out |= {k: level * weights[k] for k, _ in left[i:]}
            break
        out[s] = float(most * n)
        pot, heavy = pot - most * n, heavy - weights[s]
    return out


@dataclass
class Pattern:
    """A set of sources, the tokens of one round over its distinct texts, and what each source can take of it at most."""

    members: tuple
    round: int
    most: dict


def _blocking_flows(graph: list[list[int]], to: list[int], room: list[int], origin: int, sink: int) -> None:
    """Fills a network to its largest flow: shortest paths first, all of one length together."""
    while True:
        level, queue = {origin: 0}, deque([origin])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if room[e] > 0 and to[e] not in level:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if sink not in level:
            return
        at = [0] * len(graph)
        while True:
            path, v = [], origin
            while v != sink:
                edges = graph[v]
                while at[v] < len(edges) and not (room[edges[at[v]]] > 0 and level.get(to[edges[at[v]]]) == level[v] + 1):
                    at[v] += 1
                if at[v] < len(edges):
                    path.append(edges[at[v]])
                    v = to[path[-1]]
                elif path:
                    v = to[path.pop() ^ 1]
                    at[v] += 1
                else:
                    break
            if v != sink:
                break
            step = min(room[e] for e in path)
            for e in path:
                room[e] -= step
                room[e ^ 1] += step


def route(patterns: list[Pattern], quota: dict) -> list[dict]:
    """Tokens that each pattern gives to each of its sources: the largest flow, and of those one of least cost."""
    sources = {s: i for i, s in enumerate(dict.fromkeys(s for p in patterns for s in p.members))}
    first = 2 + len(sources)
    graph: list[list[int]] = [[] for _ in range(first + len(patterns))]
    to, room = [], []

    def edge(a: int, b: int, cap: int) -> int:
        for u, v, c in ((a, b, cap), (b, a, 0)):
            graph[u].append(len(to))
            to.append(v), room.append(c)
        return len(to) - 2

    origins = [edge(0, first + i, 0) for i in range(len(patterns))]
    routes = [{s: edge(first + i, 2 + sources[s], p.most[s]) for s in p.members} for i, p in enumerate(patterns)]
    needs = [edge(2 + i, 1, quota.get(s, 0)) for s, i in sources.items()]
    given, cost = [0] * len(patterns), 0
    while any(room[e] for e in needs) and any(g < sum(p.most.values()) for g, p in zip(given, patterns)):
        for i, p in enumerate(patterns):  # the first round costs 0, the second 1, the next two 2, the next four 3
            open_ = min(sum(p.most.values()), p.round * 2**cost) if p.round else 0
            room[origins[i]] += max(0, open_ - given[i])
            given[i] = max(given[i], open_) if p.round else sum(p.most.values())
        _blocking_flows(graph, to, room, 0, 1)
        cost += 1
    return [{s: room[e ^ 1] for s, e in r.items()} for r in routes]


def _coded(source: Column) -> Column:
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))


def _source(code: str) -> str | None:
    return None if code == "n" else code[1:]


def _edges(rows: DataFrame, by: list[str], key: str, digits: int = 3) -> DataFrame:
    """Where each group's prefix by key ends: (by, the first key that doesn't fit into `open` as a whole, tokens left before it) of rows (by, key, size, open).

    Only sums by leading digits of the key leave the executors' aggregation; single keys are sorted inside the one
    cell of 16^-digits of a group where its prefix ends.
    """
    upto = lambda c: Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    celled = rows.withColumn("cell", F.substring(key, 1, digits))
    cells = celled.groupBy(*by, "cell").agg(F.sum("size").alias("size"), F.min("open").alias("open")).withColumn("after", F.sum("size").over(upto("cell")))
    cells = cells.where("after > open and after - size <= open").select(*by, "cell", (F.col("open") - F.col("after") + F.col("size")).alias("left"))
    inside = celled.join(cells, [*by, "cell"]).groupBy(*by, key).agg(F.sum("size").alias("size"), F.min("left").alias("left")).withColumn("after", F.sum("size").over(upto(key)))
    return inside.where("after > left and after - size <= left").select(*by, F.col(key).alias(f"edge_{key}"), (F.col("left") - F.col("after") + F.col("size")).alias("left"))


#: Rows of each size class (powers of two) of a cell that may fill what its prefix leaves, less than a document's size.
FILLERS = 2000


def _along(c: str, flip: Column) -> Column:
    """A key in hex digits, or its complement."""
    return F.when(flip, F.translate(c, "0123456789abcdefABCDEF", "fedcba9876543210543210")).otherwise(F.col(c))


def _open_ends(rows: DataFrame, wanted: list[tuple[list, str, int, bool]]) -> DataFrame:
    """Where the partial rounds end: (members, own, edge_key, edge_tie, left, flip) of cells (members, own, tokens of the partial round, flip).

    Rows before the edge, a key and a tie-breaker within it, are in; `left` tokens are missing then. With flip the rows are run
    through from the other end.
    """
    by = ["members", "own"]
    named = rows.sparkSession.createDataFrame(wanted, "members array<string>, own string, open long, flip boolean")
    small = len(wanted) <= BROADCAST_PLAN
    named = F.broadcast(named) if small else named
    rows = rows.join(named, by).withColumns({c: _along(c, F.col("flip")) for c in ("key", "tie")})
    ends = common.cut(_edges(rows.drop("flip"), by, "key"))
    tied = rows.drop("flip").join(F.broadcast(ends) if small else ends, by).where("key = edge_key").withColumn("open", F.col("left")).drop("left")
    last = _edges(tied, by, "tie")
    return common.cut(ends.drop("left").join(last, by).join(named.select(*by, "flip"), by))


def _fillers(rows: DataFrame, ends: DataFrame, small: bool) -> DataFrame:
    """(members, own, key, tie, the latter flipped where the cell is) of rows after the edges that fit into what is left there: of every size class the first along the key, larger ones before smaller."""
    by = ["members", "own"]
    after = (F.col("key") > F.col("edge_key")) | ((F.col("key") == F.col("edge_key")) & (F.col("tie") > F.col("edge_tie")))
    rows = rows.join(F.broadcast(ends) if small else ends, by).withColumns({c: _along(c, F.col("flip")) for c in ("key", "tie")})
    fits = rows.where(after & (F.col("size") <= F.col("left")))
    fits = fits.withColumn("class", F.floor(F.log2("size")).cast("int"))
    first = fits.withColumn("n", F.row_number().over(Window.partitionBy(*by, "class").orderBy("key", "tie"))).where(F.col("n") <= FILLERS)
    first = first.where(F.col("n") <= 16 + F.floor(F.col("left") / F.pow(F.lit(2), "class")))  # more can't fit
    some = first.groupBy(*by).agg(F.min("left").alias("left"), F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "key", "tie"))).alias("some"))
    # As many as fit, in one go along the list.
    start = F.struct(F.col("left"), F.array().cast("array<struct<key:string,tie:string>>").alias("taken"))
    step = lambda acc, x: F.when(acc.left + x.less >= 0, F.struct((acc.left + x.less).alias("left"), F.array_append(acc.taken, F.struct(x.key.alias("key"), x.tie.alias("tie"))).alias("taken"))).otherwise(acc)
    return some.select(*by, F.inline(F.aggregate("some", start, step).taken))


def plan(rows: DataFrame, cells: list[tuple[list, str, int, int]], most: int) -> tuple[DataFrame, DataFrame]:
    """((members, own, cell_size, rounds, edge_key, edge_tie, flip), (members, own, key, tie) of fillers) of rows (members, own, size, key, tie).

    cells: (members, own, their tokens, tokens to take). A partial round is the prefix of whole rows that fits; what the cells of a
    source leave open goes to its largest cell, whose rows after the prefix fill it as far as any fits.
    """
    taken = {(tuple(m), own): (n, give) for m, own, n, give in cells}
    largest: dict = {}
    for (m, own), (n, _) in sorted(taken.items()):
        if own and n > taken.get(largest.get(own), (0, 0))[0]:
            largest[own] = (m, own)
    main = {*largest.values()} or {*taken}
    ends = _open_ends(rows, [(list(c[0]), c[1], give % n, False) for c, (n, give) in taken.items() if c not in main and n and give % n])
    more: dict = {}
    for r in ends.toLocalIterator():  # a row for each cell, as the cells themselves
        more[r.own] = more.get(r.own, 0) + r.left
    taken |= {c: (taken[c][0], min(most * taken[c][0], taken[c][1] + more[own])) for own, c in largest.items() if own in more}
    # Where most of a main cell is in the partial round, what stays out is chosen instead, so that many rows are left to choose from.
    rests = [(list(c[0]), c[1], taken[c][0], taken[c][1] % taken[c][0]) for c in sorted(main) if taken[c][0] and taken[c][1] % taken[c][0]]
    last = _open_ends(rows, [(m, own, n - rest if 2 * rest > n else rest, 2 * rest > n) for m, own, n, rest in rests])
    small = len(taken) <= BROADCAST_PLAN
    per = rows.sparkSession.createDataFrame([(list(m), own, n, give // n if n else 0) for (m, own), (n, give) in taken.items()], "members array<string>, own string, cell_size long, rounds long")
    return per.join(ends.unionByName(last).drop("left"), ["members", "own"], "left"), _fillers(rows, last, small)


def contract_quotas(sizes: dict, most: int = 3) -> dict:
    """Targets of {source: tokens}: sources by code point, null last, weigh 1, 2, 3, repeating."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    return capped_shares([(s, sizes[s]) for s in order], {s: 1 + i % 3 for i, s in enumerate(order)}, most)


@dataclass
class Mix:
    """docs' columns with the names of two more, tokens and copies to take; per source its tokens and its target."""

    rows: DataFrame
    size: str
    copies: str
    sources: dict


def mix(docs: DataFrame, members: Column | None = None, seed: int = 7, quotas: Callable[[dict, int], dict] = contract_quotas, most: int = 3) -> Mix:
    """Every document with the number of times that the mix takes it, at most `most`.

    members: the sources that a row can be counted to (an array); then any of them may take it. Without it a row counts to
    its `source`, and the pattern of a text is the set of sources that carry it.
    """
    by_text = members is None
    size, copies, key, tie, text, pattern, own = common.unused(docs, "size", "copies", "key", "tie", "text_hash", "members", "own")
    keyed = docs.withColumns(
        {
            size: common.n_words(F.col("text")),
            key: F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))),
            tie: F.lpad(F.hex(F.xxhash64(F.lit(seed), "text", F.monotonically_increasing_id())), 16, "0"),
            text: F.xxhash64("text"),
            own: _coded(F.col("source")) if by_text else F.lit(""),
            pattern: F.array(_coded(F.col("source"))) if by_text else F.array_sort(F.array_distinct(F.transform(members, _coded))),
        }
    )
    slim = common.cut(keyed.where(F.col(size) > 0).select(*[F.col(c).alias(n) for c, n in ((pattern, "members"), (own, "own"), (size, "size"), (key, "key"), (tie, "tie"), (text, "text"))]))
    texts = slim.groupBy("text", "own").agg(F.min("size").alias("size")).groupBy("text").agg(F.array_sort(F.collect_set("own")).alias("shared"), F.min("size").alias("size"))
    if by_text:
        shared = common.cut(texts.where("size(shared) > 1").select("text", "shared"))
        shared = F.broadcast(shared) if common.has_rows_within(shared, BROADCAST_TEXTS) else shared
        slim = common.cut(slim.join(shared, "text", "left").withColumn("members", F.coalesce("shared", "members")).drop("shared"))
        rounds = texts.groupBy(F.col("shared").alias("members")).agg(F.sum("size").alias("round"))
    else:
        rounds = slim.groupBy("members").agg(F.sum("size").alias("round"))
    per_round = {tuple(r.members): r["round"] for r in rounds.toLocalIterator()}
    held = {(tuple(r.members), r.own): r["size"] for r in slim.groupBy("members", "own").agg(F.sum("size").alias("size")).toLocalIterator()}

    sizes: dict = {_source(r.own): 0 for r in keyed.select(F.col(own).alias("own")).distinct().toLocalIterator()} if by_text else {}
    for (m, o), n in held.items():
        for s in [o] if by_text else m:
            sizes[_source(s)] = sizes.get(_source(s), 0) + n
    targets = quotas(sizes, most)
    patterns = [Pattern(m, per_round[m], {s: most * (held.get((m, s), 0) if by_text else n) for s in m}) for m, n in sorted(per_round.items())]
    flows = dict(zip([p.members for p in patterns], route(patterns, {_coded_name(s): int(t) for s, t in targets.items()})))
    cells = [(list(m), o, n, min(most * n, flows[m][o] if by_text else sum(flows[m].values()))) for (m, o), n in sorted(held.items())]
    chosen, fillers = map(common.cut, plan(slim, cells, most))

    p = {c: f"{pattern}_{c}" for c in [*chosen.columns, "key", "tie"]}
    chosen, fillers = (x.select(*[F.col(c).alias(p[c]) for c in x.columns if x is chosen or c in ("key", "tie")]) for x in (chosen, fillers))
    if by_text:
        shared = shared.select(F.col("text").alias(f"{text}_shared"), F.col("shared").alias(f"{pattern}_shared"))
        keyed = keyed.join(shared, F.col(text) == F.col(f"{text}_shared"), "left").withColumn(pattern, F.coalesce(f"{pattern}_shared", pattern))
    out = keyed.join(F.broadcast(chosen) if len(cells) <= BROADCAST_PLAN else chosen, (F.col(pattern) == F.col(p["members"])) & (F.col(own) == F.col(p["own"])), "left")
    flip = F.col(p["flip"])
    at, at_tie = _along(key, flip), _along(tie, flip)
    out = out.join(F.broadcast(fillers) if common.has_rows_within(fillers, BROADCAST_TEXTS) else fillers, (at == F.col(p["key"])) & (at_tie == F.col(p["tie"])), "left")
    before = (at < F.col(p["edge_key"])) | ((at == F.col(p["edge_key"])) & (at_tie < F.col(p["edge_tie"])))
    extra = (F.coalesce(before | F.col(p["tie"]).isNotNull(), F.lit(False)) != F.coalesce(flip, F.lit(False))).cast("long")
    out = out.withColumn(copies, F.when(F.col(size) == 0, F.lit(0)).otherwise(F.col(p["rounds"]) + extra).cast("long"))
    return Mix(out.select(*docs.columns, size, copies), size, copies, {s: (n, targets.get(s, 0.0)) for s, n in sizes.items()})


def _coded_name(source: str | None) -> str:
    return "n" if source is None else f"s{source}"


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    m = mix(docs, seed=seed)
    (one,) = common.unused(m.rows, "one")
    return m.rows.where(F.col(m.copies) > 0).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(m.copies).cast("int")))).select(*docs.columns)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    m = mix(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    named = spark.createDataFrame([(s, n, float(t)) for s, (n, t) in m.sources.items()], "named string, source_size long, target double")
    named = F.broadcast(named) if len(m.sources) <= BROADCAST_PLAN else named
    return m.rows.join(named, F.col("source").eqNullSafe(F.col("named")), "left").select(
        "doc_id", F.col(m.size).alias("size"), "source_size", "target", (F.col(m.copies) * F.col(m.size)).alias("taken")
    )

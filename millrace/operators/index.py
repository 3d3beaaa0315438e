"""A stored inverted index: built once for a version of the documents, then read by every question batch.

postings: a term's documents in the order of their ids, cut into blocks of BLOCK ids, each with its largest
weight and the term's df and idf; no term is one row, however common. stats: the number of documents and their
mean length. weights and vectors (every document's terms in order with their weights) are read from the postings.

Top-k of a batch whose terms have few postings scores them all. For others it reads the largest weights
first. They bound what a block can score; a question's best blocks are scored, and its k-th score leaves
out all other blocks that can't reach it. Only blocks that may are joined. Both ways give the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..sources.store import Folder, cut, fingerprint, shared
from . import retrieval as R

#: Ids of a block, and blocks of each question that are scored first (of k documents' worth at least).
BLOCK, FIRST = 32, 24
#: Counts up when the tables of an index change, so that an older one isn't read.
LAYOUT = 2
#: Up to so many postings of a batch's terms, counted with each question, all are scored.
DIRECT = 20_000_000
#: Documents whose terms are counted at once, and ids of a row of the shuffle at most.
SLICE, RANGE = 1024, 1 << 16
#: Tokens of those documents (one document isn't cut).
TOKENS = 1 << 20
#: Scores are rounded to this many digits; bounds allow for that.
DIGITS = 6


@dataclass
class Index:
    folder: Folder
    key: str

    def table(self, name: str) -> DataFrame:
        if name == "weights":
            each = self.table("postings").select("term", F.explode(F.arrays_zip("ids", "weights")).alias("p"))
            return each.select(F.col("p.ids").alias(self.key), "term", F.col("p.weights").alias("weight"))
        if name == "vectors":
            rows = self.table("weights").groupBy(self.key).agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("p"))
            return rows.select(self.key, F.col("p.term").alias("terms"), F.col("p.weight").alias("weights"))
        return self.folder.spark.read.parquet(f"{self.folder}/{name}")


def _lists(at: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(at, len(values)), pa.int32()), pa.array(values))


def _apart(sizes: np.ndarray, most: int) -> np.ndarray:
    """Of each place whether a new part begins there: parts hold less than `most` besides their last place's size."""
    part = (np.cumsum(sizes) - sizes) // most
    return np.r_[True, part[1:] != part[:-1]][: len(part)]


LISTS = "term string, range long, ids array<long>, tfs array<long>, dls array<long>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tokens) to LISTS: the documents of a slice that have a term, by RANGE of ids."""
    for whole in batches:
        sizes = whole.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(_apart(sizes, TOKENS) | (np.arange(len(sizes)) % SLICE == 0)).tolist()
        for at, end in zip(cuts, [*cuts[1:], whole.num_rows]):
            b = whole.slice(at, end - at)
            key, t = b.column(0).to_numpy(), b.column(1)
            dl, words = t.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), t.flatten().dictionary_encode()
            pair, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(key) + np.repeat(np.arange(len(key)), dl), return_counts=True)
            code, row = np.divmod(pair, max(len(key), 1))
            ids, part = key[row], key[row] // RANGE
            order = np.lexsort((ids, part, code))
            code, row, ids, part, tf = code[order], row[order], ids[order], part[order], tf[order]
            first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (part[1:] != part[:-1])][: len(code)])
            names = [f.split()[0] for f in LISTS.split(", ")]
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[first])), pa.array(part[first]), _lists(first, ids), _lists(first, tf), _lists(first, dl[row])], names=names)


BLOCKS = "term string, block long, df long, idf double, most double, ids array<long>, weights array<double>"


def _parts(rows: pa.Table) -> Iterator[pa.Table]:
    """Rows in the order of term and range, some RANGE ids at a time (at most twice as many); a term's range stays whole."""
    term, part = (rows[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in ("term", "range"))
    begins = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (part[1:] != part[:-1])][: len(term)])
    sizes = np.add.reduceat(pc.list_value_length(rows["ids"]).to_numpy().astype(np.int64), begins) if len(begins) else begins
    cuts = begins[_apart(sizes, RANGE)].tolist()
    for at, end in zip(cuts, [*cuts[1:], rows.num_rows]):
        yield rows.slice(at, end - at)


def _blocked(avgdl: float):
    """LISTS with df and idf, in the order of term and range, to BLOCKS; what may go on in the next batch waits for it."""

    def blocks(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        lengths = rows["ids"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths)), lengths)
        ids, tf, dl = (rows[c].combine_chunks().flatten() for c in ("ids", "tfs", "dls"))
        none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        term = rows["term"].combine_chunks().dictionary_encode()
        code = term.indices.to_numpy()[row]
        order = np.lexsort((ids, none, code))
        code, ids, none, row = code[order], ids[order], none[order], row[order]
        tf, dl, block = tf.to_numpy()[order], dl.to_numpy()[order], ids // BLOCK
        idf, df = rows["idf"].to_numpy()[row], rows["df"].to_numpy()[row]
        weight = idf * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * dl / (avgdl or 1.0)))
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1]) | (none[1:] != none[:-1])][: len(code)])
        most = np.maximum.reduceat(weight, first) if len(first) else weight
        held = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pa.array(ids, mask=none))
        arrays = [term.dictionary.take(pa.array(code[first])), pa.array(block[first], mask=none[first]), pa.array(df[first]), pa.array(idf[first]), pa.array(most), held, _lists(first, weight)]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            term, part = (rows[c][-1] for c in ("term", "range"))
            going_on = pc.and_(pc.equal(rows["term"], term), pc.equal(rows["range"], part) if part.is_valid else rows["range"].is_null())
            ended = rows.num_rows - pc.sum(pc.fill_null(going_on, False)).as_py()
            left = rows.slice(ended)
            # A common term's rows are long: a batch of them has many times the ids that others have.
            yield from map(blocks, _parts(rows.slice(0, ended)))
        if left is not None:
            yield blocks(left)

    return run


def build(docs: DataFrame, folder: Folder, key: str = "doc_id", text: str = "text") -> Index:
    """Writes the index of docs (integer key, text) to a folder that isn't there yet.

    Terms are counted where the texts are, and one shuffle by term takes (term, ids, counts) of many documents a row. A term has
    one number of each document there, and is written block by block.
    """
    index, spark = Index(folder, key), docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))
    n, length = docs.agg(F.count("*"), F.coalesce(F.sum(F.size(tokens(F.col("text")))), F.lit(0))).first()
    avgdl = length / max(n, 1)
    if docs.groupBy(key).count().where(f"count > 1 OR {key} IS NULL").isEmpty():
        lists = docs.select(key, tokens(F.col("text")).alias("t")).mapInArrow(_counted, LISTS)
    else:  # rows of one key are one document
        one = lambda c: F.array(F.col(c).cast("long"))
        lists = R.term_counts(docs, key).select("term", F.floor(F.col(key) / RANGE).alias("range"), one(key).alias("ids"), one("tf").alias("tfs"), one("dl").alias("dls"))
    df = F.sum(F.size("ids")).over(Window.partitionBy("term").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = lists.withColumn("df", df).withColumn("idf", R.idf(F.lit(n), F.col("df"))).sortWithinPartitions("term", "range")
    rows.mapInArrow(_blocked(avgdl), BLOCKS).write.parquet(f"{folder}/postings")
    spark.createDataFrame([(n, float(avgdl))], "n_docs long, avgdl double").write.parquet(f"{folder}/stats")
    return index


def opened(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of docs in the shared folder; built first if their files have none yet. A half-built one is never read."""
    name = f"index-{LAYOUT}-{BLOCK}-{key}-{text}-{fingerprint(docs)[:16]}"
    done = shared(spark) / name
    if not done.exists():
        part = shared(spark) / f"{name}.{uuid.uuid4().hex}"
        build(docs, part, key, text)
        part.moved_to(done)
    return Index(done, key)


def asked_terms(index: Index, queries: DataFrame, query_key: str) -> DataFrame:
    """(query, term, qw, df): a question's terms that the index knows, weighing as in a document of length one, with idf again."""
    avgdl = index.table("stats").first().avgdl or 1.0
    counts = cut(R.query_counts(queries, query_key))
    tf = F.col("tf")
    known = index.table("postings").select("term", "df", "idf").join(R.small(counts.select("term").distinct()), "term", "left_semi").distinct()
    return known.join(R.small(counts), "term").select(query_key, "term", (F.col("idf") * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B / F.lit(avgdl)))).alias("qw"), "df")


def bounds(index: Index, asked: DataFrame, query_key: str) -> DataFrame:
    """(query, block, bound): what the block's best document can score at most. Reads no posting."""
    most = index.table("postings").select("term", "block", "most").join(R.small(asked), "term")
    return most.groupBy(query_key, "block").agg(F.sum(F.col("qw") * F.col("most")).alias("bound"))


def _scores(index: Index, asked: DataFrame, pairs: DataFrame | None, query_key: str) -> DataFrame:
    """Of the documents in these (query, block), or in all blocks."""
    wanted, on = (asked, ["term"]) if pairs is None else (asked.join(pairs, query_key), ["term", "block"])
    rows = index.table("postings").select("term", "block", "ids", "weights")
    # Other terms' blocks don't reach the shuffle that a long list of blocks takes.
    rows = rows if pairs is None else rows.join(R.small(asked.select("term").distinct()), "term", "left_semi")
    rows = rows.join(R.small(wanted.select(query_key, "qw", *on)), on)
    each = rows.select(query_key, "qw", F.explode(F.arrays_zip("ids", "weights")).alias("p"))
    return each.groupBy(query_key, F.col("p.ids").alias(index.key)).agg(F.round(F.sum(F.col("qw") * F.col("p.weights")), DIGITS).alias("score"))


def needed(index: Index, asked: DataFrame, query_key: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all (query, block) with bounds, scores of the blocks taken first, the other (query, block) that may still matter)."""
    every = cut(bounds(index, asked, query_key))
    best = Window.partitionBy(query_key).orderBy(F.desc("bound"), "block")
    first = cut(every.withColumn("n", F.row_number().over(best)).where(F.col("n") <= max(FIRST, k)).select(query_key, "block"))
    scored = cut(_scores(index, asked, first, query_key))
    level = cut(R.top(scored, query_key, "score", index.key, k).groupBy(query_key).agg(F.when(F.count("*") == k, F.min("score")).alias("level")))
    rest = every.join(first, [query_key, "block"], "left_anti").join(R.small(level), query_key, "left")
    rest = rest.where(F.col("level").isNull() | (F.col("bound") >= F.col("level") - 10.0**-DIGITS)).select(query_key, "block")
    return every, scored, cut(rest)


def sparse_top(index: Index, queries: DataFrame, query_key: str, k: int, direct: int = DIRECT) -> DataFrame:
    """query, document, score, rank: the k best documents of each question by sums of weight products over shared terms."""
    asked = cut(asked_terms(index, queries, query_key))
    if (asked.agg(F.sum("df")).first()[0] or 0) <= direct:
        scores = _scores(index, asked, None, query_key)
    else:
        _, scored, rest = needed(index, asked, query_key, k)
        scores = scored.unionByName(_scores(index, asked, rest, query_key))
    return R.top(scores, query_key, "score", index.key, k)

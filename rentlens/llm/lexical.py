"""Ranked lexical search: impact vectors in buckets by length, pruned in two steps, rescored in integers.

A document is a vector of impacts over the terms of the queries: a term's weight w times
(10**9 * tf) div (1000 * tf + 12 * m), with m from the document's number of terms. A query
is the vector of its terms' counts, and a score is their product.

Documents are cut into terms once; no vector is shuffled. Each task orders its vectors
by length (norm), longest first, and deals them into buckets of BUCKET. For each
bucket and query, no score exceeds the product of the query's norm and the bucket's
longest (Cauchy-Schwarz), nor the sum of the bucket's largest coordinates: if that is below
the query's threshold, the bucket is skipped. Inside, the query's heaviest half of terms (its focus) is
added up from lists by term; what its other terms can add is bounded by the rest of each
vector's norm and by the largest coordinates. What may still reach the threshold is
scored again exactly in 64-bit integers over all terms of the query.

The threshold is a query's `top`-th score so far. First the documents with the most
distinct query terms are searched; their scores are every task's first thresholds for
all others. Bounds only skip what cannot enter the result, so the result is exact. Queries
are worked on in blocks of BLOCK_TERMS terms at most (or one longer query), one pass over
the documents each.

Texts that are null or without terms match nothing. Equal scores are ranked by id, null
ids last. Each row of queries and documents stands for itself, so repeated rows come
repeatedly. An empty table of either gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentlens.llm.common import scratch, stored

TOP = 20
BLOCK_TERMS = 1 << 20
BUCKET = 1024
#: Entries of vectors that a task orders and searches at once, or one longer vector.
CHUNK_ENTRIES = 1 << 21
#: Share of documents that are searched first.
FIRST = 1 / 64
#: Room for rounding where doubles only bound.
SLACK = 1 + 1e-9
NULL_ID = np.iinfo(np.int64).max
#: Bytes that are no term turn into blanks, A-Z into a-z.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "query int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


@dataclass
class Queries:
    """Queries as rows of a sparse matrix over the vocabulary, each row's heaviest terms first."""

    terms: np.ndarray
    counts: np.ndarray
    bounds: np.ndarray
    focus: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def blocks_of(queries: DataFrame, block_terms: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Queries as (id, terms), so many at a time as hold block_terms terms together."""
    block, held = [], 0
    for identity, text in queries.select("item_id", "text").toLocalIterator():
        words = terms_of(text)
        if block and held + len(words) > block_terms:
            yield block
            block, held = [], 0
        block.append((identity, words))
        held += len(words)
    if block:
        yield block


def extractor(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text's number of terms, and those of the vocabulary with their frequencies."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                sizes.append(len(words))
                counts = Counter(words)
                own = [w for w in counts if w in known] if len(counts) < len(known) else [w for w in known if w in counts]
                terms += [known[w] for w in own]
                tfs += [counts[w] for w in own]
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return extract


def document_counter(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "df"])

    return count


def as_matrix(block: list[tuple[object, list[bytes]]], known: dict[bytes, int], weights: np.ndarray) -> Queries:
    terms, counts, bounds, focus = [], [], [0], []
    for _, words in block:
        own = sorted(Counter(known[w] for w in words).items(), key=lambda x: (-int(weights[x[0]]), x[0]))
        terms += [t for t, _ in own]
        counts += [c for _, c in own]
        bounds.append(len(terms))
        focus.append(bounds[-2] + (len(own) + 1) // 2)
    as_long = lambda x: np.array(x, np.int64)
    return Queries(as_long(terms), as_long(counts), as_long(bounds), as_long(focus), weights, np.zeros(len(block), np.int64))


class Best:
    """The best `top` documents of each query so far."""

    def __init__(self, queries: Queries, top: int):
        self.top, self.floor = top, np.maximum(queries.thresholds, 1)
        self.scores = [np.zeros(0, np.int64)] * len(self.floor)
        self.ids = list(self.scores)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        enough = scores >= self.floor[query]
        scores, ids = np.append(self.scores[query], scores[enough]), np.append(self.ids[query], ids[enough])
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores[query], self.ids[query] = scores[order], ids[order]
        if len(order) == self.top:
            self.floor[query] = max(self.floor[query], scores[order[-1]])

    def rows(self) -> pa.RecordBatch:
        query = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids])
        none = np.zeros(0, np.int64)
        ids = np.concatenate([none, *self.ids])
        columns = [pa.array(query, pa.int32()), pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(np.concatenate([none, *self.scores]), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds, exact for whole numbers."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions from each start to its end, one after the other."""
    n = ends - starts
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts, n)


def search_bucket(queries: Queries, best: Best, ids: np.ndarray, norms: np.ndarray, terms: np.ndarray, parts: np.ndarray, bounds: np.ndarray) -> None:
    """Documents of one bucket: terms and parts (impacts without the weight) of each lie between its bounds."""
    size, n = len(queries.weights), len(ids)
    impacts = (queries.weights[terms] * parts).astype(np.float64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    by_term = np.argsort(terms, kind="stable")
    first = np.searchsorted(terms[by_term], np.arange(size + 1))
    listed, listed_owner = impacts[by_term], owner[by_term]
    largest = np.zeros(size)
    filled = np.flatnonzero(np.diff(first))
    largest[filled] = np.maximum.reduceat(listed, first[filled]) if len(filled) else 0
    most = queries.counts * largest[queries.terms]
    query_norms = np.sqrt(sums((queries.counts**2).astype(np.float64), queries.bounds))
    highest = np.minimum(query_norms * norms[0], sums(most, queries.bounds)) * SLACK + 1
    coefficients = np.zeros(size, np.int64)
    for q in np.flatnonzero(highest >= best.floor).tolist():
        a, f, z = queries.bounds[q], queries.focus[q], queries.bounds[q + 1]
        focus, rest = queries.terms[a:f], queries.counts[f:z].astype(np.float64)
        at = ranges(first[focus], first[focus + 1])
        values, docs = listed[at], listed_owner[at]
        partial = np.bincount(docs, values * np.repeat(queries.counts[a:f], first[focus + 1] - first[focus]), n)
        left = np.sqrt(np.maximum(norms**2 * SLACK - np.bincount(docs, values**2, n), 0))
        bound = partial + np.minimum(np.sqrt((rest**2).sum()) * left, most[f:z].sum())
        kept = np.flatnonzero(bound * SLACK + 1 >= best.floor[q])
        if len(kept):
            own = queries.terms[a:z]
            coefficients[own] = queries.counts[a:z] * queries.weights[own]
            at = ranges(bounds[kept], bounds[kept + 1])
            ends = np.concatenate([[0], np.cumsum(bounds[kept + 1] - bounds[kept])])
            best.add(q, sums(coefficients[terms[at]] * parts[at], ends), ids[kept])
            coefficients[own] = 0


def search_chunk(queries: Queries, best: Best, batch: pa.Table, n_docs: int, n_terms: int) -> None:
    lists = batch.column("terms").combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))])
    terms = lists.flatten().to_numpy().astype(np.int64)
    tf = batch.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
    m = 75 + (25 * batch.column("n").to_numpy() * n_docs) // n_terms
    parts = (10**9 * tf) // (1000 * tf + 12 * np.repeat(m, np.diff(bounds)))
    norms = np.sqrt(np.maximum(sums((queries.weights[terms] * parts).astype(np.float64) ** 2, bounds), 0)) * SLACK
    ids = batch.column("doc_id").fill_null(int(NULL_ID)).to_numpy()
    order = np.argsort(-norms, kind="stable")
    for k in range(0, len(order), BUCKET):
        own = order[k : k + BUCKET]
        at = ranges(bounds[own], bounds[own + 1])
        ends = np.concatenate([[0], np.cumsum(bounds[own + 1] - bounds[own])])
        search_bucket(queries, best, ids[own], norms[own], terms[at], parts[at], ends)


def searcher(shared, top: int, n_docs: int, n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best, held, entries = Best(queries, top), [], 0
        for batch in batches:
            held.append(batch)
            entries += len(batch.column("terms").flatten())
            if entries >= CHUNK_ENTRIES:
                search_chunk(queries, best, pa.Table.from_batches(held), n_docs, n_terms)
                held, entries = [], 0
        if entries:
            search_chunk(queries, best, pa.Table.from_batches(held), n_docs, n_terms)
        yield best.rows()

    return search


def leading(found: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def searched(docs: DataFrame, block: list[tuple[object, list[bytes]]], top: int, folder: str) -> DataFrame:
    """(query, doc_id, score, rank) of one block, query counted within it."""
    spark = docs.sparkSession
    known = {w: k for k, w in enumerate(sorted({w for _, words in block for w in words}))}
    vectors = stored(docs.select("doc_id", "text").mapInArrow(extractor(spark.sparkContext.broadcast(known)), VECTORS), f"{folder}/vectors")
    first = F.percentile_approx(F.when(F.size("terms") > 0, F.size("terms")), 1 - FIRST, 1000)
    total = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms"), first.alias("first")).first()
    if total["first"] is None:
        return spark.createDataFrame([], f"{FOUND}, rank int")
    weights = np.full(len(known), math.floor(1000 * math.log(2 * total["docs"] + 2)), np.int64)
    for term, df in vectors.select("terms").mapInArrow(document_counter(len(known)), "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        weights[term] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * df + 1)))
    queries = as_matrix(block, known, weights)

    def search(part: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(queries)
        return part.mapInArrow(searcher(shared, top, total["docs"], total["terms"]), FOUND)

    ahead = F.size("terms") >= total["first"]
    seeds = stored(leading(search(vectors.where(ahead)), top), f"{folder}/seeds")
    for q, score in seeds.where(F.col("rank") == top).select("query", "score").collect():
        queries.thresholds[q] = score
    rest = search(vectors.where(~ahead & (F.size("terms") > 0)))
    return leading(seeds.drop("rank").unionByName(rest), top)


def ranked(docs: DataFrame, queries: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of each query's best documents with a score above 0."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "lexical")
    kind = queries.schema["item_id"].dataType.simpleString()
    parts = []
    for k, block in enumerate(blocks_of(queries, block_terms)):
        names = spark.createDataFrame([(q, x) for q, (x, _) in enumerate(block)], f"query int, item_id {kind}")
        found = searched(docs, block, top, f"{folder}/block{k}").join(names, "query").select("item_id", "rank", "doc_id", "score")
        parts.append(f"{folder}/block{k}/found")
        found.write.parquet(parts[-1])
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)

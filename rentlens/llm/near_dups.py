"""MinHash near-dedup by improved consistent weighted sampling.

A text's features are its distinct 5-word shingles (words of bytes, A-Z lowered;
a text of fewer words is one shingle), weighted by count times idf. Document
frequencies are exact for each 64-bit shingle hash, over distinct texts, so equal copies
count once: blocks of documents deal the distinct hashes and counts of their first
copies out by hash, and what is summed there goes back to the blocks. Each idf is
ln(1 + texts / frequency), where a shingle in fewer than one of RARE texts counts as
one in RARE: else what a large group of near copies has in common would weigh
less than what each of them has alone, the less the larger the group, and copies
that are linked in a small group would not be in a large one. Only groups of more than
that share of all distinct texts are weighted down. No table grows with the corpus.
Blocks are written once, bucketed by their number: counts that come back, and decisions
on their documents, meet them there, so texts are never shuffled, but for those of pairs.

Consistent weighted sampling draws SAMPLES features per text such that two texts
draw the same with the probability of their weighted Jaccard similarity. BANDS of
ROWS draws are the keys of buckets. Equal texts are one class throughout. Within
a bucket nothing is paired with everything: each class is first compared with the
smallest one; after verified links are merged, what is still in different
components is compared with a growing share of the bucket, until all pairs that
could add a link have been compared. Pairs are verified by exact weighted Jaccard
similarity of at least SIMILARITY. Components come from distributed label
propagation. Texts, links and labels stay in Spark.

Null texts are empty; texts without words are never near to another, but equal
ones are one class, as all equal texts are. Rows of equal id and text are one
document each; rows of equal id and unlike texts are judged by their texts. Texts
of any length are compared whole. An empty table gives an empty result. Other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.bytewords import mix, slices, texts, window_hashes, windows_inside, word_hashes, words
from rentlens.llm.buckets import linked, shared
from rentlens.llm.common import joined_by, removed, scratch, stored
from rentlens.llm.repeats import packed, unpacked

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 3, 10
SAMPLES = ROWS * BANDS
#: A shingle in one of RARE texts weighs as much as a rarer one.
RARE = 100
#: Room for rounding where weights only choose what is compared.
SLACK = 1e-5
#: Common weight c of texts of weights a and b gives c / (a + b - c), so SIMILARITY asks for this much of a + b.
REACHABLE = f"reach is null or reach2 is null or least(reach, reach2) >= {SIMILARITY / (1 + SIMILARITY) - SLACK} * (whole + whole2)"
#: Frequencies are counted for blocks of documents of this size at once, or for one longer text.
BLOCK_BYTES = 1 << 21
#: Text of a bucket of blocks, and text whose hashes one group counts.
BUCKET_BYTES, PART_BYTES = 12 << 20, 4 << 20
#: Draws come from tables of quantiles, looked up by bits of a hash.
QUANTILES = 1 << 15
#: Texts are worked on together up to this size, so that arrays stay in the cache.
TEXT_BYTES = 1 << 19


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, sorted within each, and each text's first one (n + 1)."""
    low, starts, ends, first = words(data, offsets)
    hashes = word_hashes(low, starts, ends)
    own = window_hashes(hashes, SHINGLE)
    at = np.flatnonzero(windows_inside(first, SHINGLE, len(own)))
    n_words = np.diff(first)
    counts = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(bounds[-1], np.uint64)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    whole = np.ones(len(out), bool)
    whole[bounds[short]] = False
    out[whole] = own[at]
    for k in short.tolist():
        out[bounds[k]] = window_hashes(hashes[first[k] : first[k + 1]], int(n_words[k]))[0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    return out, bounds


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features within each text, their counts, and the texts' first ones (n + 1)."""
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    inner = bounds[:-1]
    new[inner[inner < len(hashes)]] = True
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(hashes)))
    return hashes[at], counts, np.searchsorted(at, bounds)


def blocker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(docs, texts, rows): a row per block of documents."""
    for batch in batches:
        column = batch.column("text").cast(pa.string()).fill_null("")
        _, offsets = texts(column)
        parts = (batch.column("doc_id"), column, batch.column("row"), batch.column("text").is_null())
        for first, end, _, _ in slices(offsets, offsets, BLOCK_BYTES):
            bounds = pa.array([0, end - first], pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, x.slice(first, end - first)) for x in parts]
            yield pa.RecordBatch.from_arrays(lists, ["docs", "texts", "rows", "nulls"])


def dealt(column: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Of a block's texts: distinct hashes by part, in how many of them each is, the parts' bounds, and the texts' own features."""
    data, offsets = texts(column)
    pieces = [(part, at, *distinct(*features(part, at))) for _, _, part, at in slices(data, offsets, TEXT_BYTES)]
    hashes, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[2] for x in pieces)]), return_counts=True)
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return hashes[order], n[order], np.searchsorted(part[order], np.arange(parts + 1)), pieces


def digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, row, doc_id, class) of every document, class the digest of its text."""
    for batch in batches:
        for source, docs, column in zip(batch.column("source").to_pylist(), batch.column("docs"), batch.column("texts"), strict=True):
            data, offsets = texts(column.values)
            classes = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            rows = np.arange(len(classes), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([source] * len(rows), pa.int64()), pa.array(rows), docs.values, pa.array(classes, pa.binary())],
                ["source", "row", "doc_id", "class"],
            )


def first_copies(block: pa.Table, firsts: pa.Table) -> tuple[pa.Table, pa.Array]:
    """The rows (row, id) of a block's texts that are the first of their class, in order, and the texts."""
    firsts = firsts.select(["row", "id"]).sort_by("row").combine_chunks()
    column = block.column("texts")[0].values if len(block) else pa.array([], pa.string())
    return firsts, column.take(firsts.column("row").combine_chunks())


def hash_dealer(parts: int):
    """(part, source, hashes, counts) of a block's first copies: a row per part."""

    def deal(block: pa.Table, firsts: pa.Table) -> pa.Table:
        hashes, n, bounds, _ = dealt(first_copies(block, firsts)[1], parts)
        used = np.flatnonzero(np.diff(bounds))
        cut = lambda f, x: pa.array([f(x[bounds[k] : bounds[k + 1]]) for k in used], pa.binary())
        source = block.column("source").to_pylist()[:1] * len(used)
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays(
            [pa.array(used, pa.int32()), pa.array(source, pa.int64()), cut(lambda x: x.tobytes(), hashes), cut(lambda x: packed(narrow(x)), n)],
            ["part", "source", "hashes", "counts"],
        )

    return deal


def frequencies(table: pa.Table) -> pa.Table:
    """Of one part's hashes, each block's, in its order: documents of all blocks that have them."""
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    counts = [widened(unpacked(x), len(h)) for x, h in zip(table.column("counts").to_pylist(), hashes, strict=True)]
    _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    found = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)[inverse]
    ends = np.cumsum([len(h) for h in hashes]).tolist()
    pa.default_memory_pool().release_unused()
    out = [packed(narrow(found[a:b])) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return pa.Table.from_arrays([table.column("source"), table.column("part"), pa.array(out, pa.binary())], ["source", "part", "found"])


def narrow(counts: np.ndarray) -> bytes:
    """Counts in the narrowest of 1, 2, 4 or 8 bytes; the length tells which."""
    for kind in ("<u1", "<u2", "<u4"):
        if counts.max(initial=0) <= np.iinfo(kind).max:
            return counts.astype(kind).tobytes()
    return counts.astype("<i8").tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[len(data) // n]).astype(np.int64)


def idf(found: np.ndarray, n: int) -> np.ndarray:
    return np.log1p(np.minimum(n / found, RARE)).astype(np.float32)


def draw_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), of its logarithm, and of the uniform distribution."""
    levels = (np.arange(QUANTILES) + 0.5) / QUANTILES
    x = np.full(QUANTILES, 2.0)
    for _ in range(60):  # Newton's method on 1 - (1 + x) exp(-x)
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - levels) / (x * np.exp(-x)), x / 4)
    return x.astype(np.float32), np.log(x).astype(np.float32), levels.astype(np.float32)


def signatures(own: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SAMPLES draws (rows: texts, as 64-bit codes) by consistent weighted sampling."""
    gamma, log_gamma, uniform = draw_tables()
    filled = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, SAMPLES), np.uint64)
    if not len(filled):
        return out
    starts, lengths = bounds[filled], np.diff(bounds)[filled]
    logs, bits = np.log(weights), np.uint64(QUANTILES - 1)
    for k in range(SAMPLES):
        h = mix(own + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        r = gamma[(h & bits).astype(np.int32)]
        c = log_gamma[((h >> np.uint64(16)) & bits).astype(np.int32)]
        b = uniform[((h >> np.uint64(32)) & bits).astype(np.int32)]
        t = np.floor(logs / r + b)
        value = c - r * (t - b + 1)
        least = np.minimum.reduceat(value, starts)
        at = np.flatnonzero(value == np.repeat(least, lengths))
        text = np.searchsorted(starts, at, "right") - 1
        code = mix(own[at] * np.uint64(31) + t[at].astype(np.int64).astype(np.uint64))
        best = np.full(len(starts), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(best, text, code)
        out[filled, k] = best
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """Bucket keys: a hash of each band's draws and its number."""
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(signature), band + 1, np.uint64)
        for row in range(ROWS):
            h = mix(h * np.uint64(0x100000001B3) + signature[:, band * ROWS + row])
        keys[:, band] = h
    return keys


def signer(parts: int, n: int):
    """(id, source, row, keys, found) of a block's first copies: bucket keys, and frequencies of the sorted features.

    What comes back is (part, found) of the block's hashes, and (row, id) of its first copies, which have no part.
    """

    def sign(block: pa.Table, returned: pa.Table) -> pa.Table:
        dealt_out = returned.filter(pc.is_valid(returned.column("part")))
        firsts, column = first_copies(block, returned.filter(pc.is_null(returned.column("part"))))
        hashes, _, bounds, pieces = dealt(column, parts)
        all_found = np.ones(len(hashes), np.int64)
        for k, x in zip(dealt_out.column("part").to_pylist(), dealt_out.column("found"), strict=True):
            all_found[bounds[k] : bounds[k + 1]] = widened(unpacked(x.as_py()), int(bounds[k + 1] - bounds[k]))
        order = np.argsort(hashes)
        hashes, all_found = hashes[order], all_found[order]
        keys, counted = [], []
        for _, _, own, counts, first in pieces:
            found = all_found[np.searchsorted(hashes, own)]
            signed = bands(signatures(own, counts.astype(np.float32) * idf(found, n), first)).view(np.int64)
            empty = np.diff(first) == 0
            keys += [None if e else k for e, k in zip(empty.tolist(), signed.tolist(), strict=True)]
            counted += [packed(narrow(found[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]
        source = block.column("source").to_pylist()[:1] * len(firsts)
        pa.default_memory_pool().release_unused()
        columns = [firsts.column("id").combine_chunks(), pa.array(source, pa.int64()), firsts.column("row").combine_chunks(), pa.array(keys, pa.list_(pa.int64())), pa.array(counted, pa.binary())]
        return pa.Table.from_arrays(columns, ["id", "source", "row", "keys", "found"])

    return sign


def take_texts(block: pa.Table, wanted: pa.Table) -> pa.Table:
    """(id, text, found) of the wanted documents of a block."""
    at = wanted.column("row")
    text = block.column("texts")[0].values if len(block) else pa.array([], pa.string())
    return pa.Table.from_arrays([wanted.column("id"), text.take(at.combine_chunks()), wanted.column("found")], ["id", "text", "found"])


def take_rows(block: pa.Table, wanted: pa.Table) -> pa.Table:
    """(text, row) of the wanted documents of a block, null texts null again."""
    at = wanted.column("row").combine_chunks()
    one = lambda c: block.column(c)[0].values.take(at)
    text = pc.if_else(one("nulls"), pa.scalar(None, pa.string()), one("texts"))
    return pa.Table.from_arrays([text, one("rows")], ["text", "row"])


def weighted(column: pa.Array, found: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct features, weights and document frequencies of each text."""
    data, offsets = texts(column)
    for start, end, part, at in slices(data, offsets, TEXT_BYTES):
        own, counts, bounds = distinct(*features(part, at))
        for a, b, x in zip(bounds[:-1], bounds[1:], found.slice(start, end - start).to_pylist(), strict=True):
            frequency = widened(unpacked(x), int(b - a))
            yield own[a:b], counts[a:b] * idf(frequency, n).astype(np.float64), frequency


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted feature lists with weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    whole = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - least
    return least / whole if whole else 0.0


def verifier(n: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [((own, weights) for own, weights, _ in weighted(batch.column(f"text_{x}"), batch.column(f"found_{x}"), n)) for x in ("a", "b")]
            scores = [weighted_jaccard(a, b) for a, b in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(scores, pa.float64())], ["a", "b", "score"])

    return verify


def prefixes(n_docs: int):
    """(bucket, id, whole, reach): features without which the others of a text weigh less than SIMILARITY of it, taken from the rarest on.

    Texts that share none of them share less than SIMILARITY of the one whose
    features end first in that order, so they cannot be near. whole is the text's
    weight, reach that of the feature and all after it: texts whose first common
    feature it is share at most the smaller reach (REACHABLE).
    """

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, sizes, reach, whole = [], [], [], []
            for own, weights, frequency in weighted(batch.column("text"), batch.column("found"), n_docs):
                order = np.lexsort((own, frequency))
                sums = np.concatenate([[0.0], np.cumsum(weights[order])])
                n = min(len(own), int(np.searchsorted(sums[1:], (1 - SIMILARITY + SLACK) * sums[-1], "right")) + 1)
                buckets.append(own[order[:n]].view(np.int64))
                sizes.append(n)
                whole.append(sums[-1])
                reach.append(sums[-1] - sums[:n])
            ids = np.repeat(batch.column("id").to_numpy(), sizes)
            columns = [np.concatenate([np.zeros(0, np.int64), *buckets]), ids, np.repeat(whole, sizes), np.concatenate([[], *reach])]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["bucket", "id", "whole", "reach"])

    return prefix


class Blocks:
    """Documents in blocks, written bucketed by `source`, the block's number."""

    def __init__(self, docs: DataFrame, folder: str) -> None:
        self.spark, self.path, self.name = docs.sparkSession, f"{folder}/blocks", f"near_blocks_{uuid.uuid4().hex}"
        row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"])
        docs = docs.select("doc_id", "text", row.alias("row"))
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
        self.parts = 1 + size["bytes"] // PART_BYTES
        schema = f"docs array<long>, texts array<string>, rows array<{docs.schema['row'].dataType.simpleString()}>, nulls array<boolean>"
        frame = docs.mapInArrow(blocker, schema).withColumn("source", F.monotonically_increasing_id())
        writer = frame.write.format("parquet").bucketBy(1 + size["bytes"] // BUCKET_BYTES, "source")
        writer.option("path", self.path).saveAsTable(self.name)

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def met(self, other: DataFrame, function, schema: str, columns: list[str]) -> DataFrame:
        """What function makes of each block and the rows of other that have its source; blocks stay where they are."""
        return self.frame().select("source", *columns).groupBy("source").cogroup(other.groupBy("source")).applyInArrow(function, schema)

    def remove(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        removed(self.spark, self.path)


def grouped(docs: DataFrame, blocks: Blocks, folder: str) -> DataFrame:
    """(source, row, doc_id, class_id, group_id) of every document: smallest doc_id of its class, and of its component."""
    digests = blocks.frame().select("source", "docs", "texts").mapInArrow(digester, "source long, row int, doc_id long, class binary")
    places = stored(digests, f"{folder}/places")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "source", "row")).alias("first")
    classes = places.groupBy("class").agg(first, F.count("*").alias("n"))
    classes = classes.select("class", "n", "first.*").withColumn("id", F.monotonically_increasing_id())
    classes = stored(classes, f"{folder}/classes")
    n, parts, copies = classes.count(), blocks.parts, classes.select("source", "row", "id")
    counted = blocks.met(copies, hash_dealer(parts), "part int, source long, hashes binary, counts binary", ["texts"])
    counted = counted.groupBy("part").applyInArrow(frequencies, "source long, part int, found binary")
    signed = blocks.met(counted.unionByName(copies, allowMissingColumns=True), signer(parts, n), "id long, source long, row int, keys array<long>, found binary", ["texts"])
    signed = stored(signed, f"{folder}/signed")
    members = stored(shared(signed.select("id", F.explode("keys").alias("bucket"))), f"{folder}/members")
    wanted = signed.join(members.select("id").distinct(), "id").select("source", "row", "id", "found")
    firsts = stored(blocks.met(wanted, take_texts, "id long, text string, found binary", ["texts"]), f"{folder}/texts")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda x: firsts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"), F.col("found").alias(f"found_{x}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b", "found_a", "found_b")
        return both.mapInArrow(verifier(n), "a long, b long, score double").where(F.col("score") >= SIMILARITY).select("a", "b")

    def finer(ids: DataFrame) -> DataFrame:
        return firsts.join(ids, "id").mapInArrow(prefixes(n), "bucket long, id long, whole double, reach double")

    labels = linked(members, verified, folder, finer, REACHABLE)
    labelled = classes.select("class", "n", "id", F.col("doc_id").alias("class_id")).join(labels, "id", "left")
    labelled = stored(labelled.withColumn("label", F.coalesce("label", "id")).drop("id"), f"{folder}/labelled")
    groups = labelled.groupBy("label").agg(F.min("class_id").alias("group_id"))
    found = stored(labelled.join(groups, "label").drop("label"), f"{folder}/groups")
    removed(docs.sparkSession, *(f"{folder}/{x}" for x in ("texts", "members", "classes", "signed", "labelled")))
    return joined_by(places, found, "class").drop("class")


def duplicates(docs: DataFrame) -> DataFrame:
    """A row per document: its class (smallest doc_id of equal texts), group (smallest doc_id of its component), and whether it is the one kept."""
    folder = scratch(docs.sparkSession, "near")
    blocks = Blocks(docs.select("doc_id", "text"), folder)
    found = grouped(docs, blocks, folder).select("doc_id", "class_id", "group_id")
    found = stored(found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("group_id"))), f"{folder}/found")
    blocks.remove()
    return found


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents kept, one of each group, with all their columns; of repeated rows one stays, of those without id all."""
    folder = scratch(docs.sparkSession, "near")
    blocks = Blocks(docs, folder)
    found = grouped(docs, blocks, folder).where(F.col("doc_id").eqNullSafe(F.col("group_id")))
    # Of rows with the id that stays, the first; without id there is nothing to tell rows by.
    same = F.when(F.col("doc_id").isNull(), F.struct("source", "row"))
    first = F.min(F.struct("source", "row")).alias("first")
    kept = found.groupBy("group_id", same.alias("same")).agg(first).select("first.*")
    row = blocks.frame().schema["rows"].dataType.elementType.simpleString()
    rows = blocks.met(kept, take_rows, f"text string, row {row}", ["texts", "rows", "nulls"])
    place = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = stored(rows.select(*[F.col("text") if c == "text" else F.col("row").getField(place[c]).alias(c) for c in docs.columns]), f"{folder}/kept")
    blocks.remove()
    return rows

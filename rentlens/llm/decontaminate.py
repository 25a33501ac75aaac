"""Benchmark decontamination: test word windows, looked up in a broadcast hash set.

The windows of one block of benchmark items, whose bytes are bounded by
BLOCK_BYTES, are broadcast as sorted hashes with their words. Training texts are
scanned once per block, in arrays; a hash that is found is verified word by
word. There is one block unless the benchmark is larger than the bound.

Nulls and empty texts have no words and no hits. An item without words has no
window; a window of an item without id marks words, but names no item. Repeated
rows are marked alike, each for itself; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.bytewords import slices, texts, window_hashes, windows_inside, word_hashes, words
from rentlens.llm.common import scratch, stored

WINDOW = 10
BLOCK_BYTES = 64 << 20


def windows_of(rows: list[tuple[object, str | None]], size: int) -> dict[int, dict[bytes, list[str]]]:
    """Windows of items as words joined by a space, by their number of words, with the items' ids."""
    found: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
    for item, text in rows:
        data, offsets = texts(pa.array([text], pa.string()))
        low, starts, ends, _ = words(data, offsets)
        parts = [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        length = min(size, len(parts))
        for k in range(len(parts) - length + 1 if parts else 0):
            found[length][b" ".join(parts[k : k + length])].append(item)
    return {n: dict(x) for n, x in found.items()}


def hashed(windows: dict[bytes, list[str]], size: int) -> np.ndarray:
    data, offsets = texts(pa.array(list(windows), pa.binary()))
    low, starts, ends, _ = words(data, offsets)
    return np.unique(window_hashes(word_hashes(low, starts, ends), size)[::size])


def marker(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds hits to the masks (a bit for each word) and items of a batch."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(size, windows, sieve(keys), keys) for size, (windows, keys) in shared.value.items()]
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            masks, items = batch.column("mask").to_pylist(), batch.column("items").to_pylist()
            for first, _, part, at in slices(data, offsets):
                low, starts, ends, first_words = words(part, at)
                hits, found = find(low, starts, ends, first_words, known)
                for k, (a, b) in enumerate(zip(first_words[:-1], first_words[1:], strict=True)):
                    row, old = first + k, masks[first + k]
                    bits = np.packbits(hits[a:b])
                    masks[row] = (bits if old is None else bits | np.frombuffer(old, np.uint8)).tobytes()
                    items[row] = sorted({*(items[row] or ()), *found.get(k, ())})
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text"), pa.array(masks, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array([any(x) for x in masks], pa.bool_())],
                ["row", "text", "mask", "items", "hit"],
            )

    return mark


def sieve(keys: np.ndarray) -> np.ndarray:
    """Which upper 20 bits occur: most windows need no search."""
    flags = np.zeros(1 << 20, bool)
    flags[(keys >> np.uint64(44)).astype(np.int64)] = True
    return flags


def find(low, starts, ends, first_words, known) -> tuple[np.ndarray, dict[int, set[str]]]:
    hits, found = np.zeros(len(starts), bool), defaultdict(set)
    hashes = word_hashes(low, starts, ends)
    for size, windows, flags, keys in known:
        own = window_hashes(hashes, size)
        at = np.flatnonzero(flags[(own >> np.uint64(44)).astype(np.int64)])
        at = at[keys[np.minimum(np.searchsorted(keys, own[at]), len(keys) - 1)] == own[at]]
        at = at[windows_inside(first_words, size, len(own))[at]]
        rows = np.searchsorted(first_words, at, "right") - 1
        for k, row in zip(at.tolist(), rows.tolist(), strict=True):
            window = b" ".join(low[a:b].tobytes() for a, b in zip(starts[k : k + size], ends[k : k + size], strict=True))
            if window in windows:
                hits[k : k + size] = True
                found[row].update(x for x in windows[window] if x is not None)
    return hits, found


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] = ["doc_id"], block_bytes: int = BLOCK_BYTES) -> DataFrame:  # noqa: B006
    """row (the columns to keep), text, mask (a bit per word, first word in the highest bit of the first byte), items, hit."""
    spark = docs.sparkSession
    sizes = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()
    blocks = -(-sizes["n"] // block_bytes) or 1
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)])
    frame = docs.select(row.alias("row"), "text", F.lit(None).cast("binary").alias("mask"), F.lit(None).cast("array<string>").alias("items"), F.lit(False).alias("hit"))
    schema = frame.schema
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block) if blocks > 1 else items
        found = windows_of([tuple(x) for x in own.collect()], window)
        shared = spark.sparkContext.broadcast({n: (x, hashed(x, n)) for n, x in found.items()})
        frame = frame.mapInArrow(marker(shared), schema)
        if block < blocks - 1:
            frame = stored(frame, scratch(spark, "marks"))
    return frame


def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        n_words = np.zeros(len(batch), np.int64)
        for first, end, part, at in slices(data, offsets):
            n_words[first:end] = np.diff(words(part, at)[3])
        masks, items = batch.column("mask").to_pylist(), batch.column("items").to_pylist()
        n_hit = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in masks]
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row").field(0), pa.array(n_words), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document: words, words hit, items that occur in it."""
    frame = marked(docs, benchmark, window)
    frame = frame.mapInArrow(summary, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return frame.withColumn("contaminated", F.col("n_hit") > 0)


def without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, mask in zip(batch.column("text").to_pylist(), batch.column("mask").to_pylist(), strict=True):
            hits = np.unpackbits(np.frombuffer(mask, np.uint8)).astype(bool)
            if hits.any():
                data, offsets = texts(pa.array([text], pa.string()))
                _, starts, ends, _ = words(data, offsets)
                hits = np.append(hits[: len(starts)], False)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], hits]).astype(np.int8)))
                keep = np.ones(len(data), bool)
                for a, b in edges.reshape(-1, 2):
                    keep[starts[a] : ends[b - 1]] = False
                text = data[keep].tobytes().decode()
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("row").field(0), pa.array(out, pa.string())], ["doc_id", "text"])


def clean_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and text without the words hit and what stands between them."""
    return marked(docs, benchmark, window).mapInArrow(without_spans, "doc_id long, text string")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with all their columns; the scan carries whole rows, so no join follows."""
    names = [c for c in docs.columns if c != "text"]
    frame = marked(docs, benchmark, window, names).where(~F.col("hit"))
    return frame.select(*[F.col("text") if c == "text" else F.col("row").getField(f"c{names.index(c)}").alias(c) for c in docs.columns])

"""SimHash near-dedup by the counts of set bits in segments of the fingerprints.

A text's fingerprint has 64 bits, each the majority of that bit in the XXH64 hashes of
its 3-word shingles (words without white space, A-Z lowered, repeats included; fewer
words are one shingle, none give fingerprint zero). Fingerprints link at DISTANCE = 2
or fewer differing bits. Equal fingerprints are one class throughout.

A fingerprint's counts of set bits in 16 segments of 4 bits are a point of a grid. A
differing bit changes one count by one, so the Manhattan distance of two points never
exceeds the number of differing bits: the range join asks for points within 2. Two such
points have a point within 1 of both, so every class goes to its own cell and the cells
next to it, 33 at most, and those that share a cell are verified by their differing bits.
Cells of more than CROWD classes are not compared pair by pair: their classes
go to the 65 fingerprints within one bit. Those that meet there are within 2 bits of
each other, and never more than 65, whatever the table. Both ways are exact.

Null texts are empty. Rows of equal or null id stand each for themselves; a component
has the smallest id that is not null. Ties do not arise. Texts are worked on one at a
time. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import joined_by, scratch, stored
from rentlens.llm.components import components

WORDS, SEED, DISTANCE = 3, 42, 2
SEGMENT = 4
CROWD = 64
#: Hashes whose bits are counted at once.
PIECE = 1 << 14
STEPS = np.uint64(1) << np.arange(0, 64, SEGMENT, dtype=np.uint64)
FLIPS = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])


def fingerprint(text: str | None) -> int:
    """The majority of each bit, as an unsigned 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and only the white space of ASCII
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    stops = ends[WORDS - 1 :] or ends[-1:]
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))  # noqa: B905
    counts = np.zeros(64, np.int64)
    for first in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[first : first + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "print"])


def counted(prints: np.ndarray) -> np.ndarray:
    """Set bits of each segment of 4, in place of the segment."""
    twos = prints - ((prints >> np.uint64(1)) & np.uint64(0x5555555555555555))
    threes = np.uint64(0x3333333333333333)
    return (twos & threes) + ((twos >> np.uint64(2)) & threes)


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, print): the point of each fingerprint's counts and the points next to it that counts can take."""
    full, digit = np.uint64(SEGMENT), np.uint64(15)
    for batch in batches:
        prints = batch.column("print").to_numpy().view(np.uint64)
        points = counted(prints)
        out, own = [points], [prints]
        for k, step in enumerate(STEPS):
            count = (points >> np.uint64(SEGMENT * k)) & digit
            for able, near in ((count < full, points + step), (count > 0, points - step)):
                out.append(near[able])
                own.append(prints[able])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out, own)], ["cell", "print"])


def flips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(centre, print): each fingerprint with itself and the 64 that differ from it in one bit."""
    for batch in batches:
        prints = batch.column("print").to_numpy().view(np.uint64)
        centres = (prints[:, None] ^ FLIPS[None, :]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(centres.view(np.int64)), pa.array(np.repeat(prints, len(FLIPS)).view(np.int64))], ["centre", "print"])


def links_of(prints: DataFrame, folder: str, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of fingerprints that link, enough of them to connect every component."""
    grid = prints.mapInArrow(cells, "cell long, print long")
    shared = grid.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes the grid like the fingerprints, of which it has 33 times the rows: it would be broadcast.
    members = stored(grid.join(shared.hint("merge"), "cell"), f"{folder}/members")
    few = members.where(F.col("n") <= crowd)
    other = few.select("cell", F.col("print").alias("other")).hint("merge")
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= DISTANCE
    pairs = few.join(other, (few["cell"] == other["cell"]) & (F.col("print") < F.col("other")) & near).select(F.col("print").alias("a"), F.col("other").alias("b"))
    many = members.where(F.col("n") > crowd).select("print").distinct().mapInArrow(flips, "centre long, print long")
    groups = many.groupBy("centre").agg(F.collect_list("print").alias("all")).where("size(all) > 1")
    stars = groups.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a != b")
    return pairs.unionByName(stars).distinct()


def near_classes(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    folder = scratch(docs.sparkSession, "segments")
    signed = stored(docs.select("doc_id", "text").mapInArrow(signer, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, print long"), f"{folder}/signed")
    classes = stored(signed.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), f"{folder}/classes")
    labels = components(links_of(classes.select("print"), folder, crowd), f"{folder}/labels")
    labelled = classes.join(labels.withColumnRenamed("id", "print"), "print", "left").withColumn("label", F.coalesce("label", "print"))
    labelled = stored(labelled, f"{folder}/labelled")
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    found = labelled.join(least, "label").select("print", "n", "component_id")
    rows = joined_by(signed, stored(found, f"{folder}/found"), "print")
    return rows.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")

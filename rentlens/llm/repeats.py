"""Long repeats across documents, found with run-length indexes.

A byte goes if a string of LENGTH bytes that covers it also starts in a document
of smaller id. Every such string has an anchor, the ANCHOR-byte string in it with
the smallest hash; strings in a row with one anchor make a passage, so equal
strings lie in passages of equal anchor.

1. Anchors are dealt out by hash, and those of a single document fall away.
2. Passages of the others are dealt out by anchor. Equal passages of one task,
   then of one part, are merged at once: all but the one of the smallest id go
   whole. So a passage that a third of all documents share is one row a task.
3. Where different passages have one anchor, those that agree with another one next to
   it, as passages that share a string do, are indexed: a run-compressed
   Burrows-Wheeler transform with sampled run ends (`run_index`). Matching
   statistics of each passage are streamed through it, and strings of LENGTH
   bytes that a smaller document has are marked. Groups above INDEX_BYTES are dealt
   again within the task by other grams, in the end by whole strings, so an index is
   bounded; the task still holds all passages of its anchors.
4. The marks of a document are united and its bytes cut.

Texts are read as UTF-8; null texts are empty. Rows of equal id must have equal
texts, and count as one document; rows without id are neither cut nor compared.
Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.bytewords import mix, powers, prefix_sums, range_hashes, slices, texts
from rentlens.llm.run_index import RunIndex

LENGTH, ANCHOR = 50, 16
WIDTH = LENGTH - ANCHOR + 1
SIDE = WIDTH // 2
#: Longer passages (of one repeated pattern) are parted.
MOST_STRINGS = 64
TEXT_BYTES = 1 << 19
FLUSH_ANCHORS, FLUSH_PASSAGES = 1 << 20, 1 << 18
#: Passages of one anchor group are indexed together with others up to this many bytes.
INDEX_BYTES = 1 << 20
#: A larger group is dealt again by grams of these sizes in turn. In the last, equal keys are equal strings, which are merged.
SPLITS = (ANCHOR, 24, 36, LENGTH)
DEALT = "part int, kind int, docs binary, counts binary, low binary, high binary, places binary"
PASSAGES = "part int, kind int, docs binary, starts binary, counts binary, anchors binary, bytes binary"


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: text number, first string's start, number of strings, and anchor of each passage."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    sums = prefix_sums(data)
    grams = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * powers(len(sums), "inverse")[: len(sums) - ANCHOR])
    least, size = grams, 1
    while size * 2 <= WIDTH:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < WIDTH:
        least = np.minimum(least[: n], least[WIDTH - size : WIDTH - size + n])
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1), 1)
    np.add.at(edge, offsets[1:], -1)
    valid = (np.cumsum(edge[:-1]) == 0)[:n]
    change = least[1:] != least[:-1]
    opens, closes = valid.copy(), valid.copy()
    opens[1:] &= ~valid[:-1] | change
    closes[:-1] &= ~valid[1:] | change
    starts, counts = np.flatnonzero(opens), np.flatnonzero(closes)
    counts = counts - starts + 1
    anchors = least[starts]
    if counts.max(initial=0) > MOST_STRINGS:
        parts = -(-counts // MOST_STRINGS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, whole, anchors = np.repeat(starts, parts) + nth * MOST_STRINGS, np.repeat(counts, parts), np.repeat(anchors, parts)
        counts = np.minimum(MOST_STRINGS, whole - nth * MOST_STRINGS)
    return np.searchsorted(offsets, starts, "right") - 1, starts, counts, anchors


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def shared_by_documents(anchors: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each entry's anchor is of two documents or more; and one entry for each such anchor."""
    order = np.argsort(anchors)
    a, d = anchors[order], docs[order]
    heads = np.ones(len(a), bool)
    heads[1:] = a[1:] != a[:-1]
    at = np.flatnonzero(heads)
    ends = np.append(at[1:], len(a)) - 1
    many = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at) if len(at) else np.zeros(0, bool)
    out = np.zeros(len(a), bool)
    out[order] = np.repeat(many, ends - at + 1)
    return out, order[at[many]]


def flat(docs: np.ndarray) -> tuple[bytes, bytes]:
    """Documents of entries, which stand together, as each document once and its number of entries."""
    heads = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    return docs[heads].astype("<i8").tobytes(), np.diff(np.append(heads, len(docs))).astype("<u4").tobytes()


def unflat(docs: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(docs, "<i8"), np.frombuffer(counts, "<u4"))


def packed(data: bytes) -> bytes:
    """Compressed, behind its length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def rows(schema: str, found: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    named = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kinds[t]) for k, (_, t) in enumerate(named)], [n for n, _ in named])


def anchor_dealer(parts: int):
    """Entries (anchor, document, place of the passage in it) by part (kind 0), anchors known to be shared (1),
    and marked places (2), which only pass through."""

    def flush(docs: np.ndarray, places: np.ndarray, anchors: np.ndarray) -> pa.RecordBatch:
        shared, one = shared_by_documents(anchors, docs)
        out = [(int(docs[0] % parts), 2, *flat(docs[shared]), b"", b"", places[shared].astype("<u4").tobytes())] if shared.any() else []
        for kind, at in ((0, np.flatnonzero(~shared)), (1, np.sort(one))):
            part = (anchors[at] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                own = at[order[bounds[k] : bounds[k + 1]]]
                a = anchors[own] >> np.uint64(24)
                where = flat(docs[own]) + (a.astype("<u4").tobytes(), (a >> np.uint64(32)).astype("u1").tobytes(), packed(narrow(places[own]))) if kind == 0 else (b"", b"", a.astype("<u4").tobytes(), (a >> np.uint64(32)).astype("u1").tobytes(), b"")
                out.append((k, kind, *where))
        return rows(DEALT, out)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            data, offsets = texts(batch.column("text"))
            for first, _, part, at in slices(data, offsets, TEXT_BYTES):
                text, _, _, anchors = passages(part, at)
                held[0].append(ids[first + text])
                held[1].append(np.arange(len(text)) - np.searchsorted(text, text))
                held[2].append(anchors)
                size += len(text)
            if size >= FLUSH_ANCHORS:
                yield flush(*map(np.concatenate, held))
                held, size = ([], [], []), 0
        if size:
            yield flush(*map(np.concatenate, held))

    return deal


def narrow(places: np.ndarray) -> bytes:
    return places.astype("<u2" if places.max(initial=0) < 1 << 16 else "<u4").tobytes()


def marked_places(table: pa.Table, parts: int) -> pa.Table:
    """Of one part's entries, those whose anchor more than one document has, as (part, docs, places)."""
    docs, places, anchors, known, through = [], [], [], [], []
    for r in table.to_pylist():
        if r["kind"] == 2:
            through.append((unflat(r["docs"], r["counts"]), np.frombuffer(r["places"], "<u4")))
            continue
        a = np.frombuffer(r["low"], "<u4").astype(np.uint64) | (np.frombuffer(r["high"], "u1").astype(np.uint64) << np.uint64(32))
        if r["kind"] == 1:
            known.append(a)
        else:
            docs.append(unflat(r["docs"], r["counts"]))
            found = unpacked(r["places"])
            places.append(np.frombuffer(found, "<u2" if len(found) == 2 * len(a) else "<u4").astype(np.uint32))
            anchors.append(a)
    docs_, places_, anchors_ = joined(docs, np.int64), joined(places, np.uint32), joined(anchors, np.uint64)
    shared, _ = shared_by_documents(anchors_, docs_)
    shared |= np.isin(anchors_, joined(known, np.uint64))
    through.append((docs_[shared], places_[shared]))
    docs_, places_ = joined([x for x, _ in through], np.int64), joined([x for _, x in through], np.uint32)
    return by_part(docs_, [places_], ["places"], parts)


def by_part(docs: np.ndarray, columns: list[np.ndarray], names: list[str], parts: int) -> pa.Table:
    """Entries by part of their document: few rows, however many documents."""
    part = docs % parts
    order = np.argsort(part, kind="stable")
    docs, columns, bounds = docs[order], [x[order].astype("<u4") for x in columns], np.searchsorted(part[order], np.arange(parts + 1))
    used = np.flatnonzero(np.diff(bounds))
    cut = lambda x: pa.array([packed(x[bounds[k] : bounds[k + 1]].tobytes()) for k in used], pa.binary())
    return pa.Table.from_arrays([pa.array(used, pa.int32()), *map(cut, [docs, *columns])], ["part", "docs", *names])


def by_document(table: pa.Table) -> pa.Table:
    """Of one part's rows of `by_part`, a row per document."""
    names = table.column_names[2:]
    joined_ = lambda name, kind: np.frombuffer(b"".join(unpacked(x) for x in table.column(name).to_pylist()), kind)
    docs = joined_("docs", "<i8")
    order = np.argsort(docs, kind="stable")
    docs, columns = docs[order], [joined_(n, "<u4")[order] for n in names]
    heads = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    bounds = np.append(heads, len(docs)).tolist()
    parts = [[x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for x in columns]
    return pa.Table.from_arrays([pa.array(docs[heads], pa.int64()), *(pa.array(x, pa.binary()) for x in parts)], ["doc_id", *names])


def passage_dealer(parts: int):
    """Marked passages by part of their anchor (kind 0); of equal ones in a task all but the smallest document's go whole (kind 1)."""

    def flush(found: dict[bytes, list]) -> pa.RecordBatch:
        by_part: dict[int, list] = {}
        whole: list[tuple[int, int, int]] = []
        for text, (anchor, owners) in found.items():
            least = min(owners)
            whole += [(d, s, s + len(text)) for d, s in owners if d != least[0]]
            by_part.setdefault(anchor % parts, []).extend((d, s, text, anchor) for d, s in owners if d == least[0])
        out = []
        for part, own in by_part.items():
            d, s, t, a = zip(*own, strict=True)
            out.append((part, 0, np.array(d, "<i8").tobytes(), np.array(s, "<u4").tobytes(), np.array([len(x) for x in t], "<u1").tobytes(), (np.array(a, np.uint64) >> np.uint64(32)).astype("<u4").tobytes(), packed(b"".join(t))))
        if whole:
            d, s, e = zip(*whole, strict=True)
            out.append((whole[0][0] % parts, 1, np.array(d, "<i8").tobytes(), np.array(s, "<u4").tobytes(), np.array(e, "<u4").tobytes(), b"", b""))
        return rows(PASSAGES, out)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            ids, marks = batch.column("doc_id").to_pylist(), batch.column("places").to_pylist()
            data, offsets = texts(batch.column("text"))
            for first, end, part, at in slices(data, offsets, TEXT_BYTES):
                text, starts, counts, anchors = passages(part, at)
                bounds = np.searchsorted(text, np.arange(end - first + 1))
                buffer = part.tobytes()
                for k in range(end - first):
                    places = np.unique(np.frombuffer(marks[first + k], "<u4")).astype(np.int64)
                    own = bounds[k] + places[places < bounds[k + 1] - bounds[k]]
                    begin = int(at[k])
                    for s, c, a in zip(starts[own].tolist(), counts[own].tolist(), anchors[own].tolist(), strict=True):
                        found.setdefault(buffer[s : s + c + LENGTH - 1], [a, []])[1].append((ids[first + k], s - begin))
                    size += len(own)
            if size >= FLUSH_PASSAGES:
                yield flush(found)
                found, size = {}, 0
        if size:
            yield flush(found)

    return deal


def marked_ranges(table: pa.Table, parts: int) -> pa.Table:
    """Of one part's passages, the byte ranges to cut as (part, docs, starts, ends)."""
    docs, starts, ends = [], [], []
    first: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for r in table.to_pylist():
        d, s = np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["starts"], "<u4").astype(np.int64)
        if r["kind"] == 1:
            docs.append(d)
            starts.append(s)
            ends.append(np.frombuffer(r["counts"], "<u4").astype(np.int64))
            continue
        at, text = 0, unpacked(r["bytes"])
        for doc, start, n, anchor in zip(d.tolist(), s.tolist(), np.frombuffer(r["counts"], "<u1").tolist(), np.frombuffer(r["anchors"], "<u4").tolist(), strict=True):
            first.setdefault((anchor, text[at : at + n]), []).append((doc, start))
            at += n
    whole = settled(first)
    extra = np.array(whole, np.int64).reshape(-1, 3)
    return by_part(joined([*docs, extra[:, 0]], np.int64), [joined([*starts, extra[:, 1]], np.int64), joined([*ends, extra[:, 2]], np.int64)], ["starts", "ends"], parts)


def settled(first: dict[tuple[int, bytes], list[tuple[int, int]]], depth: int = 0) -> list[tuple[int, int, int]]:
    """Ranges to cut of passages by (anchor, text). Equal ones are merged; groups above INDEX_BYTES are dealt again, so every index is bounded."""
    whole, groups = [], {}
    for (anchor, text), owners in first.items():
        least = min(owners)[0]
        whole += [(d, s, s + len(text)) for d, s in owners if d != least]
        groups.setdefault(anchor, []).append((text, least, [s for d, s in owners if d == least]))
    block: list[tuple] = []
    size = 0
    for own in groups.values() if depth else plausible(groups):
        n_bytes = sum(len(x[0]) for x in own)
        if len(own) > 1 and n_bytes > INDEX_BYTES and depth < len(SPLITS):
            whole += settled(dealt_again(own, depth), depth + 1)
        elif len(own) > 1:
            block += own
            size += n_bytes
            if size >= INDEX_BYTES:
                whole += indexed(block)
                block, size = [], 0
    return whole + indexed(block)


def plausible(groups: dict[int, list[tuple]]) -> Iterator[list[tuple]]:
    """The groups, with those passages only that can share a string with another one.

    A string of LENGTH bytes around an anchor has SIDE bytes before it or SIDE behind it at least,
    so passages that share one agree in one of these, next to some place of the anchor.
    """
    many = [(anchor, x) for anchor, own in groups.items() if len(own) > 1 for x in own]
    if not many:
        return
    anchors = np.array([a for a, _ in many], np.uint64)
    joint = np.frombuffer(b"".join(x[0] for _, x in many), np.uint8)
    keys, holders = [], []
    for first, end, data, at in slices(joint, np.concatenate([[0], np.cumsum([len(x[0]) for _, x in many])]), TEXT_BYTES):
        sums = prefix_sums(data)
        grams = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * powers(len(sums), "inverse")[: len(sums) - ANCHOR])
        holder = np.repeat(np.arange(end - first), np.diff(at))[: len(grams)]
        own = anchors[first:end]
        place = np.flatnonzero((grams >> np.uint64(32)) == own[holder])
        holder = holder[place]
        for turn, (a, b) in enumerate(((place - SIDE, place), (place + ANCHOR, place + ANCHOR + SIDE))):
            inside = (a >= at[holder]) & (b <= at[holder + 1])
            sides = range_hashes(sums, a[inside], b[inside])
            keys.append(mix(sides + own[holder[inside]] * np.uint64(2) + np.uint64(turn)))
            holders.append(holder[inside] + first)
    shared, _ = shared_by_documents(joined(keys, np.uint64), joined(holders, np.int64))
    possible = np.zeros(len(many), bool)
    possible[joined(holders, np.int64)[shared]] = True
    kept: dict[int, list[tuple]] = {}
    for (anchor, x), good in zip(many, possible.tolist(), strict=True):
        if good:
            kept.setdefault(anchor, []).append(x)
    yield from kept.values()


def dealt_again(own: list[tuple], depth: int) -> dict[tuple[int, bytes], list[tuple[int, int]]]:
    """The strings of a group's passages by the smallest of their SPLITS[depth]-byte grams in a new order; strings in a row with one stay together."""
    gram = SPLITS[depth]
    width = LENGTH - gram + 1
    out: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in own])])
    joint = np.frombuffer(b"".join(x[0] for x in own), np.uint8)
    for first, end, data, at in slices(joint, offsets, TEXT_BYTES):
        sums = prefix_sums(data)
        hashes = mix(mix((sums[gram:] - sums[:-gram]) * powers(len(sums), "inverse")[: len(sums) - gram]) + np.uint64(depth + 1))
        n = len(data) - LENGTH + 1
        least = hashes[:n].copy()
        for k in range(1, width):
            np.minimum(least, hashes[k : k + n], out=least)
        for (text, doc, starts), begin in zip(own[first:end], at.tolist()):
            keys = least[begin : begin + len(text) - LENGTH + 1]
            bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                out.setdefault((int(keys[a]), text[a : b + LENGTH - 1]), []).extend((doc, s + a) for s in starts)
    return out


def indexed(block: list[tuple]) -> list[tuple[int, int, int]]:
    """Ranges of strings that a passage of a smaller document has."""
    if not block:
        return []
    strings, owners = [x[0] for x in block], np.array([x[1] for x in block], np.int64)
    index = RunIndex(strings, owners, LENGTH)
    begins, _, least = index.matches(strings)
    lengths = np.array([len(x) for x in strings])
    hit = least < np.repeat(owners, lengths)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
    out = []
    for a, b in edges.tolist():  # a run of hits may go on into the next passage only from start to start, never across: the last LENGTH - 1 positions hit nothing
        k = int(np.searchsorted(begins, a, "right")) - 1
        out += [(block[k][1], s + a - int(begins[k]), s + b - int(begins[k]) + LENGTH - 1) for s in block[k][2]]
    return out


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges without overlap or contact."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    heads = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[heads], ends[np.append(heads[1:], len(starts)) - 1]


def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        data, offsets = texts(batch.column("text"))
        for k, (s, e) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)):
            own = data[offsets[k] : offsets[k + 1]]
            starts, ends = united(np.frombuffer(s, "<u4").astype(np.int64), np.frombuffer(e, "<u4").astype(np.int64))
            keep = np.ones(len(own), bool)
            for a, b in zip(starts, ends, strict=True):
                keep[a:b] = False
            kept = own[keep].tobytes()
            out.append((len(own) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary())))],
            ["doc_id", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed, n_spans, kept_sha256 and kept (bytes) of every document that loses a byte."""
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    dealt = docs.mapInArrow(anchor_dealer(parts), DEALT)
    places = dealt.groupBy("part").applyInArrow(lambda t: marked_places(t, parts), "part int, docs binary, places binary")
    places = places.groupBy("part").applyInArrow(by_document, "doc_id long, places binary")
    dealt = docs.join(places, "doc_id").mapInArrow(passage_dealer(parts), PASSAGES)
    ranges = dealt.groupBy("part").applyInArrow(lambda t: marked_ranges(t, parts), "part int, docs binary, starts binary, ends binary")
    ranges = ranges.groupBy("part").applyInArrow(by_document, "doc_id long, starts binary, ends binary")
    return docs.join(ranges, "doc_id").mapInArrow(cutter, "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeats_removed(docs: DataFrame) -> DataFrame:
    """A row per document: bytes, bytes and spans removed, digest of what is kept."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    whole = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    found = cut(docs).drop("kept").dropDuplicates(["doc_id"])
    return whole.join(found, "doc_id", "left").select(
        "doc_id", "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )

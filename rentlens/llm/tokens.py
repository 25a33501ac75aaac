"""Token ids in files that give any token by its position.

A shard splits each id into 8-bit chunks. Level 0 has the lowest chunk of every
token; a bitmap says which tokens continue on the next level, and a rank
directory with the ones before each 512-bit block turns a position on one level
into one on the next. So token(i) reads a few bytes a level, and the chunks of a
range of tokens lie together on each level.

Documents are range-partitioned and sorted by doc_id (nulls first, equal ids by
text); each task writes shards of bounded size and returns their names, counts
and place, which make a table. The driver adds up one figure per partition.
Files of failed attempts are never named.

Null texts are empty: their ids are the end id alone. Repeated rows are documents
of their own. An empty table gives no shard; other columns are not looked at.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentlens.llm.common import scratch, stored

END_ID = 1
SHARD_TOKENS = 1 << 22
#: Ids that a reading task is to get.
TASK_TOKENS = 1 << 22
BLOCK_BITS = 512
MAGIC = b"DACIDS01"
CACHE_WORDS = 1_200_000
WORDS_AT_ONCE = 10_000
PIECE_CHARS = 1 << 22
#: Rows whose texts a writing task holds as strings at a time.
ROWS_AT_ONCE = 1000
SHARDS = "place long, seq long, path string, n_docs long, n_tokens long"


#: Pairs of these, apart by white space, tell whether a tokenizer looks across it.
PROBES = ["a", "Bc", "don't", "1", "12", "é", "\u0301", "日本", "'s", ".", "--", "x.y", "ß", "\u0345", "Σ", "_", "\u00ad"]
#: What a tokenizer must do alike for words to share ids: case of Latin letters, and marks that close a word.
CASES = ["ABC", "ÀÉÑ", "Straße", "xÞY", "Áb", "É.", "ÝZ"]
LETTERS, TAILS = ["a", "bé", "Straß", "ñN"], [".", ",", "%%%", "!?", "--", "_", "...", "$&", ")", ";:", "#*|"]
TAIL = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])[!-&(-/:-@\[-`{-~]+$")
LATIN = re.compile(r"[\x00-\xff]+")
#: Characters that may stand between words while they are encoded together.
MARKS = "§¶¤¦¬"


class Encoder:
    """ids of whole texts as little-endian 32-bit integers.

    With `by_words`, texts are cut at spaces and line ends and the ids of each word
    are kept. That holds for tokenizers that drop white space and whose patterns
    never cross it, such as the word-end BPE used here. Whether it does is tried on
    pairs of PROBES; tokenizers that fail, and `by_words=False`, encode whole texts.
    """

    def __init__(self, path: str, by_words: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.by_words = by_words and self.parts_at_blanks()
        self.folds = self.by_words and self.ids(CASES) == self.ids([x.lower() for x in CASES])
        self.tails = self.by_words and self.ids([x + y for x in LETTERS for y in TAILS]) == [x + y for x in self.ids(LETTERS) for y in self.ids(TAILS)]
        alone = zip(MARKS, self.ids(list(MARKS)), strict=True)
        self.mark = next(((c, int.from_bytes(x, "little")) for c, x in alone if len(x) == 4), None)

    def parts_at_blanks(self) -> bool:
        own = self.ids(PROBES)
        pairs = [(x, y, blank) for x in range(len(PROBES)) for y in range(len(PROBES)) for blank in (" ", "\n", " \n ")]
        found = self.ids([PROBES[x] + blank + PROBES[y] for x, y, blank in pairs])
        return all(ids == own[x] + own[y] for ids, (x, y, _) in zip(found, pairs, strict=True))

    def ids(self, parts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def word_ids(self, words: list[str]) -> list[bytes]:
        """ids of each word: words are encoded in one string, apart by a mark, whose id parts them again."""
        if len(words) < 2 or self.mark is None or any(self.mark[0] in w for w in words):
            return self.ids(words)
        ids = np.frombuffer(self.ids([f" {self.mark[0]} ".join(words)])[0], "<u4")
        at = np.flatnonzero(ids == self.mark[1])
        if len(at) != len(words) - 1:  # another character became the mark
            return self.ids(words)
        data, bounds = ids.tobytes(), [0, *(4 * at + 4).tolist(), 4 * len(ids) + 4]
        return [data[a : b - 4] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def parts(self, word: str) -> tuple[str, str]:
        """A word as one that is shared by more words, and its tail: case and closing marks off where the tokenizer allows."""
        tail = ""
        if self.added and self.added.search(word):
            return word, tail
        if self.tails and not word[-1:].isalnum() and (found := TAIL.search(word)):
            word, tail = word[: found.start()], found[0]
        if self.folds and (word.isascii() or LATIN.fullmatch(word)):
            word = word.lower()
        return word, tail

    def learn(self, words: list[str]) -> list[bytes]:
        """ids of different words not known, which are encoded WORDS_AT_ONCE together."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known = {"": b""}
        known, parted = self.known, list(map(self.parts, words))
        new = [x for x in dict.fromkeys(chain.from_iterable(parted)) if x not in known]
        for first in range(0, len(new), WORDS_AT_ONCE):
            part = new[first : first + WORDS_AT_ONCE]
            known.update(zip(part, self.word_ids(part), strict=True))
        out = [known[word] + known[tail] if tail else known[word] for word, tail in parted]
        known.update(zip(words, out, strict=True))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """ids of texts that are not long in sum; their new words are encoded together."""
        if not self.by_words:
            return self.ids(texts)
        # A full table has millions of strings, which are not to be searched for cycles at each batch.
        paused = gc.isenabled()
        gc.disable()
        try:
            return self.encode_words(texts)
        finally:
            if paused:
                gc.enable()

    def encode_words(self, texts: list[str]) -> list[bytes]:
        """ids of texts: Arrow cuts them, numbers their different words and strings the ids of words together; each different word is looked up once."""
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        if None in found:
            new = [k for k, ids in enumerate(found) if ids is None]
            # Learning may empty the table, so the new words' ids are kept from it.
            for k, ids in zip(new, self.learn([words[k] for k in new]), strict=True):
                found[k] = ids
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, ends, data = ids.buffers()
        if data is None:  # not a single id
            return [b""] * len(texts)
        at = np.frombuffer(ends, "<i8")[ids.offset :][cut.offsets.to_numpy()].tolist()
        view = memoryview(data)
        return [bytes(view[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, text: str) -> bytes:
        if not self.by_words:
            return self.ids([text])[0]
        out, first = [], 0
        while first < len(text):
            end = text.find(" ", first + PIECE_CHARS)
            end = len(text) if end < 0 else end
            out += self.encode_all([text[first:end]])
            first = end
        return b"".join(out)

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """ids of each text, in order; short ones are encoded up to PIECE_CHARS together."""
        held: list[str] = []
        size = 0
        for text in texts:
            if size + len(text) > PIECE_CHARS and held:
                yield from self.encode_all(held)
                held, size = [], 0
            if len(text) > PIECE_CHARS:
                yield self.encode(text)
            else:
                held.append(text)
                size += len(text)
        yield from self.encode_all(held)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder_of(path: str, by_words: bool) -> Encoder:
    """One encoder, with the words it knows, for all tasks of a Python worker."""
    if (path, by_words) not in _encoders:
        _encoders[path, by_words] = Encoder(path, by_words)
    return _encoders[path, by_words]


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> Iterator[bytes]:
    """The parts of a shard file: magic, header length, header, sections."""
    sections: list[bytes] = []

    def add(part: np.ndarray) -> list[int]:
        data = part.tobytes()
        sections.append(data)
        return [sum(map(len, sections)) - len(data), len(data)]

    header = {"n_docs": len(doc_ids), "n_tokens": len(ids), "null_ids": sum(x is None for x in doc_ids)}
    header["doc_ids"] = add(np.array([x or 0 for x in doc_ids], "<i8"))
    header["starts"] = add(np.concatenate([[0], np.cumsum(lengths)]).astype("<u8"))
    header["levels"], rest = [], ids
    while len(rest) or not header["levels"]:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, BLOCK_BITS // 8).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        header["levels"].append({"n": len(rest), "chunks": add(rest.astype(np.uint8)), "bits": add(bits), "ranks": add(ranks)})
        rest = rest[more] >> 8
    head = json.dumps(header).encode()
    yield MAGIC + struct.pack("<I", len(head)) + head
    yield from sections


class Shard:
    """Reads a shard; only the bytes that a call needs are fetched."""

    def __init__(self, path: str) -> None:
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        magic, size = struct.unpack("<8sI", self.file.read_at(12, 0))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.header = json.loads(self.file.read_at(size, 12))
        self.base = 12 + size

    def part(self, section: list[int], kind: str, first: int, end: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        data = self.file.read_at((end - first) * width, self.base + section[0] + first * width)
        return np.frombuffer(data, kind)

    def rank(self, level: dict, i: int) -> int:
        """Ones before position i of a level's bitmap."""
        block = i // BLOCK_BITS
        before = int(self.part(level["ranks"], "<u8", block, block + 1)[0])
        bits = self.part(level["bits"], "u1", block * BLOCK_BITS // 8, -(-i // 8))
        return before + int(np.unpackbits(bits, bitorder="little")[: i % BLOCK_BITS].sum())

    def tokens(self, first: int, end: int, depth: int = 0) -> np.ndarray:
        if end <= first:
            return np.zeros(0, np.uint32)
        level = self.header["levels"][depth]
        out = self.part(level["chunks"], "u1", first, end).astype(np.uint32)
        bits = np.unpackbits(self.part(level["bits"], "u1", first // 8, -(-end // 8)), bitorder="little")
        at = np.flatnonzero(bits[first % 8 :][: end - first])
        if len(at):
            begin = self.rank(level, first)
            out[at] |= self.tokens(begin, begin + len(at), depth + 1) << np.uint32(8)
        return out

    def token(self, i: int) -> int:
        return int(self.tokens(i, i + 1)[0])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) of every document."""
        n, nulls = self.header["n_docs"], self.header["null_ids"]
        doc_ids = self.part(self.header["doc_ids"], "<i8", 0, n).tolist()
        starts = self.part(self.header["starts"], "<u8", 0, n + 1).tolist()
        ids = self.tokens(0, self.header["n_tokens"])
        for k, doc in enumerate(doc_ids):
            yield None if k < nulls else doc, starts[k], ids[starts[k] : starts[k + 1]]


def shard_writer(folder: str, tokenizer: str, by_words: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        pa.default_memory_pool().release_unused()  # of other work of this worker, before the table of words grows
        encoder, place, seq = encoder_of(tokenizer, by_words), TaskContext.get().partitionId(), 0
        end_id = np.array([END_ID], "<u4").tobytes()
        doc_ids, lengths, parts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.ids"
            ids = np.frombuffer(b"".join(parts), "<u4")
            with fs.open_output_stream(f"{path}/{name}") as out:
                for part in shard_bytes(doc_ids, lengths, ids):
                    out.write(part)
            row = [[place], [seq], [f"{folder}/{name}"], [len(doc_ids)], [len(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["place", "seq", "path", "n_docs", "n_tokens"])

        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, len(whole), ROWS_AT_ONCE)):
            encoded_texts = encoder.encode_batch(batch.column("text").fill_null("").to_pylist())
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded_texts, strict=True):
                data = ids + end_id
                doc_ids.append(doc)
                lengths.append(len(data) // 4)
                parts.append(data)
                size += lengths[-1]
                if size >= SHARD_TOKENS:
                    yield flush()
                    doc_ids, lengths, parts, size, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, by_words: bool = True) -> DataFrame:
    """Writes all documents in order of doc_id; the shards' table: path, n_docs, n_tokens, place and start (the ids before it)."""
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    shards = stored(rows.mapInArrow(shard_writer(folder, tokenizer, by_words), SHARDS), f"{folder}-shards")
    # A number for each partition, not for each shard, so a prefix sum on the driver is short.
    sums, start = [], 0
    for place, n in sorted(tuple(r) for r in shards.groupBy("place").agg(F.sum("n_tokens")).collect()):
        sums.append((place, start))
        start += n
    before = docs.sparkSession.createDataFrame(sums, "place long, before long")
    within = Window.partitionBy("place").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return shards.join(before, "place").withColumn("start", start).drop("before")


def read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found = [(doc, row["start"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, at, ids in Shard(row["path"]).documents()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the shards; tasks get neighbouring shards of about TASK_TOKENS."""
    total = shards.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] or 0
    listed = shards.select("path", "start").repartitionByRange(max(1, total // TASK_TOKENS), "start")
    return listed.mapInArrow(read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the ids of docs and reads the files back."""
    return read_tokens(write_tokens(docs, scratch(docs.sparkSession, "tokens"), tokenizer))

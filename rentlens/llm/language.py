"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of anything but letters become one space, and every
1- to 3-gram of the result counts in one of BUCKETS slots. Counts of all training
documents are summed in Spark per (language, slot); the smoothed log-probability
matrix is broadcast and scored in numpy, for BLOCK_LANGUAGES languages at a time: what
a block gives is merged with those before, so there may be any number of languages.

A text that is null or has no letter (digits, numerals such as ½ or Ⅷ and marks are
none) is `und` with score 0. Long texts are worked on in pieces that overlap, which give
the n-grams of the whole text. Languages are learned
from documents with text and language; with none learned, all are `und`. Equal
scores go to the language that sorts first. Repeated rows count repeatedly and
are predicted alike; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import scratch, stored

BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
SMOOTHING = 0.1
#: Languages scored at once: 64 MB of log-probabilities.
BLOCK_LANGUAGES = 256
#: The evidence of a text counts as of so many characters at most, so that scores of long texts stay apart.
EVIDENCE = 40
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Word characters that are neither letters nor decimal digits. Sets within 16 bits are looked up in one step, others not.
_NUMERALS = [c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
NUMERALS = re.compile("[" + "".join(c for c in _NUMERALS if c <= "\uffff") + "]")
HIGH, HIGH_NUMERALS = re.compile("[\U00010000-\U0010ffff]"), re.compile("[" + "".join(c for c in _NUMERALS if c > "\uffff") + "]")
PIECE_CHARS = 1 << 20


def normal(text: str | None) -> str:
    """The letters of a text, words apart by single blanks and in blanks; empty without letters."""
    low = (text or "").lower()
    if not low.isascii():
        low = NUMERALS.sub(" ", low)
        low = HIGH_NUMERALS.sub(" ", low) if HIGH.search(low) else low
    letters = NOT_LETTERS.sub(" ", low).strip()
    return f" {letters} " if letters else ""


def slots(text: str, most: int) -> np.ndarray:
    """Slots of the n-grams that begin in the first `most` characters of a normal text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    parts, value = [], np.zeros(len(codes), np.uint32)
    for size in range(1, max(GRAMS) + 1):
        value = value[: len(codes) - size + 1] * np.uint32(0x01000193) + codes[size - 1 :]
        if size in GRAMS:
            parts.append(((value[:most] * np.uint32(0x9E3779B1)) ^ np.uint32((size * 0x5BD1E995) & 0xFFFFFFFF)) >> np.uint32(16))
    return np.concatenate(parts)


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """Slots of a whole text, for PIECE_CHARS characters at a time; the next ones complete the last n-grams of a piece."""
    letters = normal(text)
    for first in range(0, len(letters), PIECE_CHARS):
        yield slots(letters[first : first + PIECE_CHARS + max(GRAMS) - 1], PIECE_CHARS)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n) over all rows of the task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for found in pieces(text):
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                counts[lang] += np.bincount(found, minlength=BUCKETS)
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "slot", "n"])


#: What blocks of languages have found so far: the best total and language, and the sum of all odds against it.
FOUND = "total double, lang_pred string, odds double"


class Model:
    """A block of languages: names in order and the log-probabilities, slots x languages."""

    def __init__(self, names: list[str], logs: np.ndarray) -> None:
        self.names, self.logs = names, logs

    def totals(self, text: str | None) -> tuple[np.ndarray, int]:
        """The log-probability of the text in each language, and its number of n-grams."""
        total, n = np.zeros(len(self.names)), 0
        for found in pieces(text):
            used = np.bincount(found, minlength=BUCKETS) if len(found) > BUCKETS else None
            total += used @ self.logs if used is not None else self.logs[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        return total, n

    def judge(self, text: str | None, before: tuple[float, str, float] | None = None) -> tuple[float, str, float] | None:
        """Best total, its language, and the sum of odds against it, with those of the blocks before."""
        total, n = self.totals(text)
        if not n or not self.names:
            return before
        tempered = min(1.0, EVIDENCE * len(GRAMS) / n)
        best = int(np.argmax(total))
        odds = float(np.exp((total - total[best]) * tempered).sum())
        if before is None:
            return float(total[best]), self.names[best], odds
        high = max(before[0], float(total[best]))
        odds = odds * np.exp((total[best] - high) * tempered) + before[2] * np.exp((before[0] - high) * tempered)
        # Names are in order over all blocks, so of equal totals the earlier one stays.
        return high, before[1] if before[0] >= total[best] else self.names[best], float(odds)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.judge(text)
        return ("und", 0.0) if found is None else (found[1], 1 / found[2])


def fit(docs: DataFrame, at_once: int = BLOCK_LANGUAGES) -> list[Model]:
    """Learns from every row with text and lang; the languages in order, in blocks."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    counts = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    counts = stored(counts, scratch(docs.sparkSession, "languages"))
    names = sorted(r[0] for r in counts.select("lang").distinct().collect())
    models = []
    for first in range(0, len(names), at_once):
        block = names[first : first + at_once]
        table = np.full((BUCKETS, len(block)), SMOOTHING)
        place = {x: k for k, x in enumerate(block)}
        for batch in counts.where((F.col("lang") >= block[0]) & (F.col("lang") <= block[-1])).toArrow().to_batches():
            langs = batch.column("lang").dictionary_encode()
            at = np.array([place[x] for x in langs.dictionary.to_pylist()], np.int64)[langs.indices.to_numpy()]
            table[batch.column("slot").to_numpy(), at] += batch.column("n").to_numpy()
        models.append(Model(block, np.log(table / table.sum(axis=0)).astype(np.float32)))
    return models


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The quarter of the documents that is not learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            before = zip(*(batch.column(c).to_pylist() for c in ("total", "lang_pred", "odds")), strict=True)
            found = [model.judge(x.as_py(), None if b[0] is None else b) or (None, None, None) for x, b in zip(batch.column("text"), before, strict=True)]
            kinds = (pa.float64(), pa.string(), pa.float64())
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *columns], ["row", "text", "total", "lang_pred", "odds"])

    return predict


def predicted(docs: DataFrame, models: list[Model], keep: list[str]) -> DataFrame:
    """row (the columns to keep, as c0, c1, ...), text, lang_pred and score."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)])
    none = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in FOUND.split(", ")]
    frame = docs.select(row.alias("row"), "text", *none)
    for model in models:
        frame = frame.mapInArrow(predictor(docs.sparkSession.sparkContext.broadcast(model)), frame.schema)
    known = F.col("lang_pred").isNotNull()
    return frame.select("row", "text", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.when(known, 1 / F.col("odds")).otherwise(0.0).alias("score"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those that are not held out."""
    frame = predicted(docs, fit(docs.where(~held_out())), ["doc_id"]).select(F.col("row.c0").alias("doc_id"), "lang_pred", "score")
    return frame.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose language is found with a score of `least` or more."""
    names = [c for c in docs.columns if c != "text"]
    frame = predicted(docs, fit(docs.where(~held_out())), names).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return frame.select(*[F.col("text") if c == "text" else F.col("row").getField(f"c{names.index(c)}").alias(c) for c in docs.columns])

"""Quality rules as a short-circuit cascade of native expressions.

Each rule is a SQL expression over the text that is true where the text passes. On a
sample of about SAMPLE_ROWS rows from all partitions, the time of a rule is measured over
REPEATS evaluations of each row, less the time of the same job without it, and one job
tells which rows fail which rules. The order is built step by step: next comes the rule with
the most rejections per second among the rows that the rules before let through. Rules run
in that order as the branches of one CASE, so a text that a cheap rule rejects
never reaches a dear one. The verdict does not depend on the order or the sample; only
the name of the first rule that rejects does.

A null text has no words and is treated as an empty one. Whole texts are judged, however
long. Repeated rows get equal verdicts; ties in the order go by name; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: The sample's expected size, and evaluations of a rule per sampled row.
SAMPLE_ROWS, REPEATS = 1000, 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda x: x != "")


def symbol_count(text: Column) -> Column:
    bare = text
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol))
    return (F.length(text) - F.length(bare)).cast("long")


def word_chars(text: Column) -> Column:
    bare = text
    for space in " \n\t\r\v\f":
        bare = F.replace(bare, F.lit(space))
    return F.length(bare).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words in windows of `size` words that are found twice or more, the first included.

    Windows are compared by 64-bit hash. Sorted, equal ones are neighbours; the
    starts of repeated ones, sorted again, each add the words up to the next start.
    """

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - size)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    def starts(s: Column) -> Column:
        h = lambda k: F.get(s, k)["h"]
        again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (h(k) == h(k + 1)) | (h(k) == h(k - 1)))
        return F.sort_array(F.transform(again, lambda k: F.get(s, k)["i"]))

    def covered(p: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(p) - 1)
        part = lambda k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(size)))
        return F.aggregate(at, F.lit(0), lambda n, k: n + part(k))

    def repeats(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, lambda s: let(starts(s), covered)))

    def count(w: Column) -> Column:
        return F.when(F.size(w) < size, F.lit(0)).otherwise(let(hashes(w), repeats))

    return let(F.transform(words, lambda x: F.xxhash64(x)), count).cast("long")


@dataclass(frozen=True)
class Rule:
    """Passes where `passes` of (text, words) is true."""

    name: str
    passes: Callable[[Column, Column], Column]


def at_most(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 <= whole * percent


def count_of(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign)))


def signs(text: Column, every: str) -> Column:
    return F.length(text) - F.length(F.translate(text, every, ""))


def lines_like(text: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern)))


def n_lines(text: Column) -> Column:
    return count_of(text, "\n") + 1


#: Bounds are wide: a rule rejects only what no prose has.
RULES = [
    Rule("symbols", lambda t, w: at_most(symbol_count(t), F.size(w), 50)),
    Rule("exclamations", lambda t, w: at_most(count_of(t, "!"), F.size(w), 50)),
    Rule("questions", lambda t, w: at_most(count_of(t, "?"), F.size(w), 50)),
    Rule("short_words", lambda t, w: word_chars(t) >= F.size(w) * 2),
    Rule("long_words", lambda t, w: word_chars(t) <= F.size(w) * 25),
    Rule("digits", lambda t, w: at_most(signs(t, "0123456789"), F.length(t), 40)),
    Rule("capitals", lambda t, w: at_most(signs(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.length(t), 70)),
    Rule("braces", lambda t, w: at_most(signs(t, "{}"), F.length(t), 5)),
    Rule("broken_characters", lambda t, w: at_most(count_of(t, "\ufffd"), F.length(t), 1)),
    Rule("duplicate_lines", lambda t, w: at_most(duplicate_lines(t), n_lines(t), 50)),
    Rule("bullets", lambda t, w: at_most(lines_like(t, r"^[\x20\x09]*[-*•]"), n_lines(t) + 3, 90)),
    Rule("ellipses", lambda t, w: at_most(lines_like(t, r"(\.\.\.|…)[\x20\x09\x0D]*\z"), n_lines(t) + 3, 50)),
    Rule("longest_word", lambda t, w: F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)) <= 500),
    Rule("distinct_words", lambda t, w: F.size(F.array_distinct(w)) * 100 >= F.size(w) * 2),
]


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """Texts and words of about so many rows, from all partitions."""
    share = min(1.0, rows / max(1, docs.count()))
    return docs.select(text_of().alias("text")).sample(share, seed).withColumn("words", split_words(F.col("text")))


def measured(sample: DataFrame, rules: list[Rule]) -> tuple[dict[str, float], list[set[str]]]:
    """Seconds of each rule over the sample, and for each sampled row the rules that it fails."""
    sample = sample.persist()
    try:
        failed = [F.when(~r.passes(F.col("text"), F.col("words")), F.lit(r.name)) for r in rules]
        fails = [set(x[0]) for x in sample.select(F.array_compact(F.array(*failed))).collect()]
        many = sample.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

        def seconds(condition: Column) -> float:
            # The turn is part of the text, so that no evaluation can be saved.
            text = F.concat("text", F.when(F.col("turn") > REPEATS, F.lit("!")).otherwise(F.lit("")))
            start = time.perf_counter()
            many.withColumn("text", text).agg(F.count(F.when(condition, 1))).collect()
            return time.perf_counter() - start

        seconds(F.col("text") != "")  # compiles what all have in common
        base = min(seconds(F.col("text") != "") for _ in range(2))
        return {r.name: max(seconds(r.passes(F.col("text"), F.col("words"))) - base, 1e-4) for r in rules}, fails
    finally:
        sample.unpersist()


def ordered(rules: list[Rule], cost: dict[str, float], fails: list[set[str]]) -> list[Rule]:
    """Each next rule has the most rejections per cost among the rows left by those before; ties by cost, then name."""
    left, waiting, out = list(fails), list(rules), []
    while waiting:
        hits = {r.name: sum(r.name in f for f in left) for r in waiting}
        best = min(waiting, key=lambda r: (-hits[r.name] / cost[r.name], cost[r.name], r.name))
        waiting.remove(best)
        out.append(best)
        left = [f for f in left if best.name not in f]
    return out


def expected_cost(rules: list[Rule], cost: dict[str, float], fails: list[set[str]]) -> float:
    """Cost of the cascade on the sample: each rule is paid for by the share of rows that reach it."""
    left, total = list(fails), 0.0
    for r in rules:
        total += cost[r.name] * len(left) / max(1, len(fails))
        left = [f for f in left if r.name not in f]
    return total


def rejected_by(text: Column, words: Column, rules: list[Rule]) -> Column:
    """The first rule, in this order, that the text fails; null if it passes all."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        out = out.when(~rule.passes(text, words), F.lit(rule.name))
    return out


def judged(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """A row per document: counts, base verdict, and whether the cascade keeps it."""
    rules = RULES if rules is None else rules
    rules = ordered(rules, *measured(sampled(docs), rules))
    frame = docs.select("doc_id", text_of().alias("text")).withColumn("words", split_words(F.col("text")))
    frame = frame.select(
        "doc_id", "text", "words",
        F.size("words").cast("long").alias("n_words"),
        word_chars(F.col("text")).alias("word_chars"),
        symbol_count(F.col("text")).alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    frame = frame.withColumn("base_failed", base)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(rejected_by(F.col("text"), F.col("words"), rules).isNull())
    return frame.withColumn("kept", kept).drop("text", "words")

"""Text search by pattern over a posting index of three-character strings (grams).

A text that matches a pattern holds the pattern's required strings, and so all their
grams. The index lists, per gram, the ids of the texts that have it; a search reads
the lists of the rarest required grams and leaves the rest to the pattern itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3
FOLDERS = 64
#: Lists read for one alternative of a pattern: the rarest of its grams.
LISTS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_QUANTIFIER = re.compile(r"[?*+][?+]?|\{(\d+)(,\d*)?\}[?+]?")


def folder_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def postings(texts: DataFrame, identity: str, text: str) -> DataFrame:
    """(gram, id, folder) of every gram of a text, A-Z lowered as patterns ignore their case; ordered by gram."""
    low = F.translate(F.col(text), _UPPER, _LOWER)
    starts = F.sequence(F.lit(1), F.length(low) - SIZE + 1)
    # Below three characters there is no gram, and a sequence would run backwards.
    grams = F.when(F.length(low) >= SIZE, F.transform(starts, lambda at: F.substr(low, at, F.lit(SIZE))))
    rows = texts.select(F.explode(F.array_distinct(grams)).alias("gram"), F.col(identity).alias("id"))
    rows = rows.withColumn("folder", folder_of(F.col("gram")))
    return rows.repartitionByRange("folder", "gram", "id").sortWithinPartitions("folder", "gram", "id")


def _class_end(pattern: str, at: int) -> int:
    """The place behind a character class that begins at `at`."""
    depth, at = 1, at + 1 + pattern.startswith("^", at + 1)
    at += pattern.startswith("]", at)  # at the beginning it stands for itself
    while at < len(pattern) and depth:
        depth += {"[": 1, "]": -1}.get(pattern[at], 0)
        at += 2 if pattern[at] == "\\" else 1
    return at


def _group_end(pattern: str, at: int) -> int:
    depth, at = 1, at + 1
    while at < len(pattern) and depth:
        if pattern[at] == "[":
            at = _class_end(pattern, at)
            continue
        depth += {"(": 1, ")": -1}.get(pattern[at], 0)
        at += 2 if pattern[at] == "\\" else 1
    return at


def _alternatives(pattern: str) -> list[str]:
    found, start, at = [], 0, 0
    while at < len(pattern):
        if pattern[at] == "[":
            at = _class_end(pattern, at)
        elif pattern[at] == "(":
            at = _group_end(pattern, at)
        elif pattern[at] == "|":
            found.append(pattern[start:at])
            start = at = at + 1
        else:
            at += 2 if pattern[at] == "\\" else 1
    return [*found, pattern[start:]]


def required_strings(pattern: str) -> list[list[str]]:
    """For each alternative of a regular expression, strings that every match of it holds.

    What is not plainly literal (classes, groups, repeats) only ends a string, so fewer
    strings than possible may be found, never one that a match can lack.
    """
    if "\\Q" in pattern or re.search(r"\(\?[a-zA-Z-]*[xuU]", pattern):
        return [[] for _ in _alternatives(pattern)]  # quoting, free spacing and Unicode case are not read
    out = []
    for part in _alternatives(pattern):
        strings, run, at = [], "", 0

        def close() -> None:
            nonlocal run
            strings.append(run)
            run = ""

        while at < len(part):
            c = part[at]
            if c == "\\":
                literal, at = part[at + 1 : at + 2], at + 2
                if literal.isalnum() and (literal not in "dDwWsSbBAzZGhHvVR" or part[at : at + 1] == "{"):
                    break  # an escape of more than one character: what follows is not read
                one = None if literal.isalnum() else literal
            elif c == "[":
                one, at = None, _class_end(part, at)
            elif c == "(":
                one, at = None, _group_end(part, at)
            else:
                one, at = (None if c in ".^$)" else c), at + 1
            if found := _QUANTIFIER.match(part, at):
                at = found.end()
                least = found[1] if found[1] is not None else ("1" if found[0][0] == "+" else "0")
                if one is not None and int(least) > 0:
                    run += one
                    close()
                    run = one  # the last repeat stands before what follows
                else:
                    close()
            elif one is None:
                close()
            else:
                run += one
        close()
        out.append([s.translate(_FOLD) for s in strings if s])
    return out


def required_grams(pattern: str) -> list[list[str]] | None:
    """Grams per alternative, or None if one of them requires none."""
    grams = [sorted({s[k : k + SIZE] for s in strings for k in range(len(s) - SIZE + 1)}) for strings in required_strings(pattern)]
    return grams if all(grams) else None


def candidates(index: DataFrame, sizes: DataFrame, pattern: str) -> DataFrame | None:
    """(id) of texts that can match, read from the lists of the pattern's rarest grams; None if it requires no gram."""
    wanted = required_grams(pattern)
    if wanted is None:
        return None
    every = sorted({g for grams in wanted for g in grams})
    n = {r["gram"]: r["n"] for r in sizes.where(F.col("gram").isin(every)).collect()}
    found = None
    for grams in wanted:
        rare = sorted(grams, key=lambda g: (n.get(g, 0), g))[:LISTS]
        lists = index.where(F.col("folder").isin(_folders(index, rare)) & F.col("gram").isin(rare))
        ids = lists.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare)).select("id")
        found = ids if found is None else found.unionByName(ids)
    return found.distinct()


def _folders(index: DataFrame, grams: list[str]) -> list[int]:
    """Folders of a few grams, as literals, so that the scan lists only these."""
    row = index.sparkSession.range(1).select(*[folder_of(F.lit(g)).alias(f"f{k}") for k, g in enumerate(grams)]).first()
    return sorted(set(row))

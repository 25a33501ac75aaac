"""Mixing to target weights by iterative proportional fitting.

Tokens are summed per cell (one value for each dimension). Cell weights are raked to
one margin after the other until every margin holds: the tokens wanted of each value are
its target share of the output, whose size is a share of all tokens. No cell can give more
than it has, so a cell that would is taken whole and the others of its margin are fitted
again. A cell's weight against its tokens is the probability of its documents, and a hash
of a document's id decides.

Targets come as a table (dimension, value, share), or temper the present shares. Of a value
that lacks the tokens wanted of it all are taken, and the others of its margin share the
rest. What margins still miss in the end, as a share of the output, is returned (`error`):
0 where all targets can hold together.

Up to GATHERED cells are raked on the driver, more of them in Spark: margins by
group-by, factors joined back, in the same steps.

Nulls of a dimension are a value of their own. Targets that name no present value are left
out of a margin; present values without target keep their share. Documents without tokens
do not weigh, and get their cell's probability (1 if the cell has no token at all). Texts of any
length count whole. An empty table gives an empty result; repeated rows each count and get
the same decision; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import removed, scratch, stored

#: Cells are aggregates; up to so many are raked on the driver.
GATHERED = 200_000
SWEEPS, TOLERANCE = 100, 1e-9
#: Share of all tokens that the output is to have, and the power that tempers present shares.
SHARE, POWER = 0.6, 0.9
DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A topic from the form of a text: marked up, listed, spoken about in short, or prose."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    bars = F.length(text) - F.length(F.replace(text, F.lit("|")))
    return (
        F.when(text.isNull() | (text == ""), F.lit("none"))
        .when(bars * 40 > F.length(text), F.lit("list"))
        .when(F.length(text) < 500, F.lit("short"))
        .when(lines * 200 > F.length(text), F.lit("lines"))
        .otherwise(F.lit("prose"))
    )


def token_count(text: Column) -> Column:
    """White-space separated words."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\v\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def tempered(totals: dict, power: float = POWER) -> dict:
    """Shares proportional to a power of the present shares: large values shrink, small ones grow."""
    raised = {k: v**power for k, v in totals.items() if v > 0}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


def margin_of(cells: dict[tuple, float], axis: int) -> dict:
    totals: dict = defaultdict(float)
    for key, n in cells.items():
        totals[key[axis]] += n
    return dict(totals)


def wanted(totals: dict, target: dict, share: float) -> dict:
    """Tokens wanted of each value: its target of the output, but no more than it has; the others share what it lacks."""
    known = {k: t for k, t in target.items() if totals.get(k, 0) > 0 and t > 0}
    out = {k: n * share for k, n in totals.items()}
    left, open_ = sum(out[k] for k in known), dict(known)
    while open_:
        scale = left / sum(open_.values())
        short = {k for k, t in open_.items() if t * scale >= totals[k]}
        if not short:
            return out | {k: t * scale for k, t in open_.items()}
        for k in short:
            out[k], left = totals[k], left - totals[k]
            del open_[k]
    return out


def rake(cells: dict[tuple, float], targets: list[dict], share: float = SHARE, sweeps: int = SWEEPS) -> tuple[dict[tuple, float], float]:
    """Cell weights, none above the cell, whose margins are the wanted tokens; and the largest miss as a share of the output."""
    present = {k: float(v) for k, v in sorted(cells.items(), key=lambda x: repr(x[0])) if v > 0}
    size = share * sum(present.values())
    goals = [wanted(margin_of(present, axis), target, share) for axis, target in enumerate(targets)]
    weights, error = {k: v * share for k, v in present.items()}, 0.0
    for _ in range(sweeps):
        for axis, goal in enumerate(goals):
            fixed, free = defaultdict(float), defaultdict(float)
            for key, w in weights.items():
                (fixed if w >= present[key] else free)[key[axis]] += w
            factor = {v: max(goal[v] - fixed[v], 0.0) / n for v, n in free.items()}
            # Where whole cells alone are more than is wanted, they give way too.
            down = {v: goal[v] / n for v, n in fixed.items() if n > goal[v]}
            weights = {
                k: w * down.get(k[axis], 1.0) if w >= present[k] else min(present[k], w * factor[k[axis]])
                for k, w in weights.items()
            }
        error = max((abs(n - goal[v]) for axis, goal in enumerate(goals) for v, n in margin_of(weights, axis).items()), default=0.0) / (size or 1.0)
        if error < TOLERANCE:
            break
    return weights, error


def rake_in_spark(cells: DataFrame, targets: list[dict], share: float, folder: str, sweeps: int = SWEEPS) -> tuple[DataFrame, float]:
    """The same for any number of cells: (source, lang, topic, tokens, weight) and the largest miss."""
    spark = cells.sparkSession
    cells = cells.where("tokens > 0").withColumn("weight", F.col("tokens") * share)
    now, turn, error = stored(cells, f"{folder}/rake0"), 0, 0.0
    size = now.agg(F.sum("weight")).first()[0] or 1.0
    goals = []
    for axis, name in enumerate(DIMENSIONS):
        totals = {r[0]: float(r[1]) for r in now.groupBy(name).agg(F.sum("tokens")).collect()}
        rows = [(k, v) for k, v in wanted(totals, targets[axis], share).items()]
        goals.append(stored(spark.createDataFrame(rows, f"v{axis} string, goal double"), f"{folder}/goal{axis}"))
    whole = F.col("weight") >= F.col("tokens")
    for _ in range(sweeps):
        for axis, name in enumerate(DIMENSIONS):
            held = now.groupBy(F.col(name).alias("v")).agg(
                F.coalesce(F.sum(F.when(whole, F.col("weight"))), F.lit(0.0)).alias("fixed"), F.coalesce(F.sum(F.when(~whole, F.col("weight"))), F.lit(0.0)).alias("free"))
            factors = held.join(goals[axis], held["v"].eqNullSafe(F.col(f"v{axis}"))).select(
                "v", (F.greatest(F.col("goal") - F.col("fixed"), F.lit(0.0)) / F.when(F.col("free") > 0, F.col("free"))).alias("up"),
                F.when(F.col("fixed") > F.col("goal"), F.col("goal") / F.col("fixed")).otherwise(1.0).alias("down"))
            new = F.when(whole, F.col("weight") * F.col("down")).otherwise(F.least(F.col("tokens").cast("double"), F.col("weight") * F.col("up")))
            now = now.join(factors, now[name].eqNullSafe(factors["v"])).select(*DIMENSIONS, "tokens", new.alias("weight"))
        turn += 1
        now = stored(now, f"{folder}/rake{turn}")
        removed(spark, f"{folder}/rake{turn - 1}")
        misses = []
        for axis, name in enumerate(DIMENSIONS):
            sums = now.groupBy(F.col(name).alias("v")).agg(F.sum("weight").alias("w"))
            miss = sums.join(goals[axis], sums["v"].eqNullSafe(F.col(f"v{axis}"))).agg(F.max(F.abs(F.col("w") - F.col("goal"))))
            misses.append(miss.first()[0] or 0.0)
        error = max(misses) / size
        if error < TOLERANCE:
            break
    return now, error


def targets_of(table: DataFrame) -> list[dict]:
    """Shares by dimension of a table (dimension, value, share)."""
    rows = table.select("dimension", F.col("value").cast("string"), F.col("share").cast("double")).collect()
    return [{r[1]: r[2] for r in rows if r[0] == name} for name in DIMENSIONS]


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id: 52 bits of an MD5."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def weighted(docs: DataFrame, targets: DataFrame | None = None, share: float = SHARE, seed: int = 11, gathered: int = GATHERED) -> DataFrame:
    """docs (doc_id, text, source, lang) with _tokens, _topic, _prob, _u, _picked and _error.

    targets (dimension, value, share) gives the margins, as far as it names them; the others are the tempered present ones.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "mixing")
    frame = docs.withColumns({"_tokens": token_count(F.col("text")), "_topic": topic_of(F.col("text"))})
    keys = [F.col("source"), F.col("lang"), F.col("_topic")]
    cells = frame.groupBy(*[k.cast("string").alias(n) for k, n in zip(keys, DIMENSIONS, strict=True)]).agg(F.sum("_tokens").alias("tokens"))
    cells = stored(cells, f"{folder}/cells")
    given = targets_of(targets) if targets is not None else [{}] * len(DIMENSIONS)
    totals = [{r[0]: float(r[1]) for r in cells.groupBy(n).agg(F.sum("tokens")).collect()} for n in DIMENSIONS]
    shares = [g or tempered(t) for g, t in zip(given, totals, strict=True)]
    small = cells.count() <= gathered
    if small:
        present = {tuple(r[n] for n in DIMENSIONS): float(r["tokens"]) for r in cells.collect()}
        raked, error = rake(present, shares, share)
        rows = [(*k, raked[k] / n if n > 0 else 1.0) for k, n in present.items()]
        probs = spark.createDataFrame(rows or [(None, None, None, 1.0)], "source_ string, lang_ string, topic_ string, _prob double")
    else:
        raked, error = rake_in_spark(cells, shares, share, folder)
        empty = cells.where("tokens <= 0").select(*DIMENSIONS, F.lit(1.0).alias("_prob"))
        probs = raked.select(*DIMENSIONS, (F.col("weight") / F.col("tokens")).alias("_prob")).unionByName(empty).toDF("source_", "lang_", "topic_", "_prob")
    same = [k.cast("string").eqNullSafe(F.col(f"{n}_")) for k, n in zip(keys, DIMENSIONS, strict=True)]
    joined = frame.join(F.broadcast(probs) if small else probs, same[0] & same[1] & same[2], "left").drop("source_", "lang_", "topic_")
    return joined.withColumn("_u", draw(F.col("doc_id"), seed)).withColumn("_picked", F.col("_u") < F.col("_prob")).withColumn("_error", F.lit(error))


def mixture(docs: DataFrame, targets: DataFrame | None = None, share: float = SHARE, gathered: int = GATHERED) -> DataFrame:
    """A row per document: its cell, tokens, probability, whether it is drawn, and what the margins miss at most."""
    frame = weighted(docs.select("doc_id", "text", "source", "lang"), targets, share, gathered=gathered)
    return frame.select(
        "doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("_prob", 9).alias("prob"), F.col("_picked").alias("picked"), F.round("_error", 9).alias("error"),
    )


def sampled(docs: DataFrame, targets: DataFrame | None = None, share: float = SHARE) -> DataFrame:
    """The documents drawn, with all their columns."""
    names = docs.columns
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source", "lang")
    return weighted(packed, targets, share).where("_picked").select(*[F.col("_row").getField(c).alias(c) for c in names])

"""Rule-based action plans, as rows of (tier, title, body)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import labels
from rentlens.functions.scalar import named_rows
from rentlens.plans.churn import revenue_at_risk
from rentlens.plans.genres import top_next_genre
from rentlens.plans.profiles import profiles

LATE_RATE_LIMIT, DRIFTING_DAYS, GONE_DAYS, NARROW_DIVERSITY = 0.3, 60, 120, 0.2


def filled(text: str, values: dict[str, Column]) -> Column:
    """``text`` with every ``{name}`` replaced by the column of that name."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(
        *[
            values[part].cast("string") if i % 2 else F.lit(part)
            for i, part in enumerate(parts)
            if i % 2 or part
        ]
    )


def formatted(number: Column, pattern: str) -> Column:
    """Text of the number; rounds its exact binary value half to even."""
    return F.call_function("format_number", number, F.lit(pattern))


def _card(tier: str, card: tuple[str, str], values: dict[str, Column]) -> Column:
    title, body = card
    return F.struct(
        F.lit(tier).alias("tier"), F.lit(title).alias("title"), filled(body, values).alias("body")
    )


def _tier(tier: str, rules: list[tuple[Column, tuple]], fallback: tuple, values) -> Column:
    """All cards whose rule holds; the fallback if none does."""
    cards = F.filter(
        F.array(*[F.when(rule, _card(tier, card, values)) for rule, card in rules]),
        lambda c: c.isNotNull(),
    )
    return F.when(F.size(cards) > 0, cards).otherwise(F.array(_card(tier, fallback, values)))


def customer_actions(ws) -> DataFrame:
    days, segment, tier = (
        F.col("days_since_last_rental"), F.col("rfm_segment"), F.col("spending_tier")
    )
    risky = F.col("is_high_risk")
    values = {
        "late_pct": formatted(F.col("late_return_rate") * 100, "0"),
        "days": days,
        "rentals": F.col("total_rentals"),
        "tier": tier,
        "genre": F.col("top_genre"),
        "diversity": formatted(F.col("genre_diversity"), "0.00"),
    }
    leaving = segment.isin("At Risk", "Lost")
    vip, limit = segment == "Champions", risky
    upsell = (segment == "Loyal") & ~risky
    immediate = _tier(
        labels.TIERS[0],
        [
            (risky & (F.col("late_return_rate") > LATE_RATE_LIMIT), labels.IMMEDIATE["remind"]),
            ((days > DRIFTING_DAYS) & leaving, labels.IMMEDIATE["reactivate"]),
            ((segment == "Lost") & (days > GONE_DAYS), labels.IMMEDIATE["win_back"]),
        ],
        labels.IMMEDIATE["none"], values,
    )
    short = _tier(
        labels.TIERS[1],
        [
            (vip, labels.SHORT_TERM["vip"]),
            (limit, labels.SHORT_TERM["limit"]),
            (upsell, labels.SHORT_TERM["upsell"]),
            ((segment == "At Risk") & ~(vip | limit | upsell), labels.SHORT_TERM["promote"]),
        ],
        labels.SHORT_TERM["none"], values,
    )
    long = _tier(
        labels.TIERS[2],
        [
            (tier.isin("Top Spender", "High Spender"), labels.LONG_TERM["lifetime"]),
            (F.col("genre_diversity") < NARROW_DIVERSITY, labels.LONG_TERM["broaden"]),
            (leaving, labels.LONG_TERM["prevent"]),
        ],
        labels.LONG_TERM["none"], values,
    )
    return profiles(ws).select(
        "customer_id", F.explode(F.concat(immediate, short, long)).alias("action")
    ).select("customer_id", "action.*")


def segment_actions(ws) -> DataFrame:
    counts = profiles(ws).groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("n"))
    values = {"n": F.coalesce(F.col("n"), F.lit(0))}
    title, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    for segment, (name, text) in labels.SEGMENT_ACTIONS.items():
        here = F.col("rfm_segment") == segment
        title = F.when(here, name).otherwise(title)
        body = F.when(here, filled(text, values)).otherwise(body)
    return (
        named_rows(ws.spark, "rfm_segment", list(labels.SEGMENT_ACTIONS))
        .join(counts, "rfm_segment", "left")
        .select("position", "rfm_segment", title.alias("title"), body.alias("body"))
        .orderBy("position")
    )


def _cards(df: DataFrame, keys: list[str], cards: Column) -> DataFrame:
    return df.select(*keys, F.explode(cards).alias("action")).select(*keys, "action.*")


def next_genre_actions(ws) -> DataFrame:
    """Three cards per customer, naming the last and the expected genre."""
    values = {
        "name": F.col("full_name"), "next": F.col("next_category"), "last": F.col("last_category")
    }
    cards = F.array(
        *[
            _card(tier, card, values)
            for tier, card in zip(labels.TIERS, labels.NEXT_GENRE_ACTIONS, strict=True)
        ]
    )
    named = top_next_genre(ws).join(
        ws.places.select("customer_id", "full_name"), "customer_id"
    )
    return _cards(named, ["customer_id"], cards)


def churn_actions(ws, variant: str = "observed") -> DataFrame:
    """Three portfolio cards; the second states the revenue at risk."""
    values = {"revenue": formatted(F.col("revenue_at_risk"), "#,##0")}
    cards = F.array(
        *[
            _card(tier, card, values)
            for tier, card in zip(labels.TIERS, labels.CHURN_ACTIONS, strict=True)
        ]
    )
    return revenue_at_risk(ws, variant).select(F.explode(cards).alias("action")).select("action.*")

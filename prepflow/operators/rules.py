"""Declarative domain rules that fill NULLs.

A rule is ``(target, condition, value)``: where ``target`` is NULL and the
condition holds, ``target`` becomes ``value``; nothing else changes.  Rules run
in list order and each sees the result of the previous ones.  They compile to
one projection of nested ``CASE WHEN`` (Catalyst collapses the chain of
``withColumn``), so a rule set costs no shuffle and no extra scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q, row_sum

Condition = Callable[[DataFrame], Column] | str


@dataclass(frozen=True)
class Rule:
    target: str
    value: Any
    condition: Condition
    requires: tuple[str, ...] = ()
    name: str = ""

    def applicable(self, df: DataFrame) -> bool:
        return self.target in df.columns and all(c in df.columns for c in self.requires)

    def cond(self, df: DataFrame) -> Column:
        c = self.condition
        return F.expr(c) if isinstance(c, str) else c(df)


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Apply ``rules`` in order; a rule whose columns are absent is skipped."""
    out = df
    for r in rules:
        if not r.applicable(out):
            continue
        tgt = q(r.target)
        value = F.lit(r.value).cast(out.schema[r.target].dataType)
        out = out.withColumn(r.target, F.when(tgt.isNull() & F.coalesce(r.cond(out), F.lit(False)), value)
                             .otherwise(tgt))
    return out


def fill_constant(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    """F8: NULL -> constant on the columns that exist."""
    present = [c for c in cols if c in df.columns]
    return df.fillna(value, subset=present) if present else df


# ---------------------------------------------------------------------------
# Passenger rule set.  Fixed values of the reference's domain rules: deck
# letters, planet names, age limits, the 'True'/'False' strings.
PASSENGER_COSTS = ("RoomService", "FoodCourt", "ShoppingMall", "Spa", "VRDeck")
PASSENGER_COSTS_WITH_TOTAL = PASSENGER_COSTS + ("TotalSpending",)
CRYO_AWAKE_DECKS = ("T", "G")
NON_VIP_DECKS = ("G", "T")
NON_VIP_PLANET = "Earth"
VIP_MIN_AGE = 18
CHILD_MAX_AGE = 13
EUROPA_DECKS = ("A", "B", "C", "T")
EARTH_DECK = "G"
VIP_EUROPA_DECK = "D"


def _spend_total(df: DataFrame) -> Column:
    return row_sum([c for c in PASSENGER_COSTS_WITH_TOTAL if c in df.columns])


def _has_costs(df: DataFrame) -> bool:
    return any(c in df.columns for c in PASSENGER_COSTS_WITH_TOTAL)


def cryo_rules(df: DataFrame) -> list[Rule]:
    """Zero spend -> asleep; awake decks or any spend -> awake.

    The last two need Deck and VIP to be present (as in the reference)."""
    if "CryoSleep" not in df.columns or not _has_costs(df):
        return []
    return [
        Rule("CryoSleep", "True", lambda d: _spend_total(d) == 0, name="cryo_zero_spend"),
        Rule("CryoSleep", "False", lambda d: F.col("Deck").isin(*CRYO_AWAKE_DECKS),
             requires=("Deck", "VIP"), name="cryo_deck"),
        Rule("CryoSleep", "False", lambda d: _spend_total(d) > 0,
             requires=("Deck", "VIP"), name="cryo_spend"),
    ]


def vip_rules() -> list[Rule]:
    """C3 + C4: minors, lower decks and one planet are never VIP."""
    return [
        Rule("VIP", "False", lambda d: F.col("Age") < VIP_MIN_AGE, requires=("Age",), name="vip_age"),
        Rule("VIP", "False", lambda d: F.col("Deck").isin(*NON_VIP_DECKS), requires=("Deck",),
             name="vip_deck"),
        Rule("VIP", "False", lambda d: F.col("HomePlanet") == NON_VIP_PLANET,
             requires=("Deck", "HomePlanet"), name="vip_planet"),
    ]


def child_cost_rules(df: DataFrame) -> list[Rule]:
    """children's NULL costs are 0."""
    return [Rule(c, 0.0, lambda d: F.col("Age") < CHILD_MAX_AGE, requires=("Age",), name=f"child_{c}")
            for c in PASSENGER_COSTS_WITH_TOTAL if c in df.columns]


def homeplanet_rules() -> list[Rule]:
    """Planet from deck (and VIP on one deck)."""
    return [
        Rule("HomePlanet", "Europa", lambda d: F.col("Deck").isin(*EUROPA_DECKS), requires=("Deck",),
             name="planet_deck_europa"),
        Rule("HomePlanet", "Earth", lambda d: F.col("Deck") == EARTH_DECK, requires=("Deck",),
             name="planet_deck_earth"),
        Rule("HomePlanet", "Europa",
             lambda d: (F.col("Deck") == VIP_EUROPA_DECK) & (F.col("VIP") == "True"),
             requires=("Deck", "VIP"), name="planet_deck_vip"),
    ]


def passenger_pre_rules(df: DataFrame) -> list[Rule]:
    """C2 -> C3 -> C4 -> C5, the order of the reference."""
    return cryo_rules(df) + vip_rules() + child_cost_rules(df)

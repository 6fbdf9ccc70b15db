"""Composite-column split (C1) and derived spending features."""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bin_fixed, flag, q, row_sum, split_part, split_parts, to_double
from .groups import group_size
from .reshape import drop_existing, reorder


@dataclass(frozen=True)
class SplitSpec:
    """Split ``source`` on the literal ``sep`` into ``names``.

    ``max_parts`` caps the pieces (the last keeps the rest); ``doubles`` are
    the produced names converted to double (bad text -> NULL).
    """
    source: str
    sep: str
    names: tuple[str, ...]
    max_parts: int | None = None
    doubles: tuple[str, ...] = ()


@dataclass(frozen=True)
class BinSpec:
    source: str
    target: str
    start: float
    width: float
    count: int
    first_label: float = 1.0


# Fixed values of the passenger data set (column names, separators, zone width).
PASSENGER_COST_COLUMNS = ("RoomService", "FoodCourt", "ShoppingMall", "Spa", "VRDeck")
PASSENGER_LUXURY_COLUMNS = ("Spa", "VRDeck")


@dataclass(frozen=True)
class CompositeConfig:
    id_col: str | None = "PassengerId"
    id_sep: str = "_"
    group_col: str = "Group"
    size_col: str = "GroupSize"
    splits: tuple[SplitSpec, ...] = (
        SplitSpec("Cabin", "/", ("Deck", "Num", "Side"), doubles=("Num",)),
        SplitSpec("Name", " ", ("Names", "Surnames"), max_parts=2),
    )
    bins: tuple[BinSpec, ...] = (BinSpec("Num", "NumZone", 0.0, 200.0, 10),)
    drop_train: tuple[str, ...] = ("PassengerId", "Cabin", "Name", "Num", "Surnames")
    drop_test: tuple[str, ...] = ("Cabin", "Name", "Num", "Surnames")
    first: tuple[str, ...] = ("Group", "GroupSize")
    last: tuple[str, ...] = ("Transported",)
    group_via: str = "join"


def split_composite(df: DataFrame, is_train: bool = True, config: CompositeConfig = CompositeConfig(),
                    keep: Sequence[str] = ()) -> DataFrame:
    """Derive group / size / split parts / bins, drop the sources, reorder.

    The group size is counted over the frame handed in (before any train/test
    split, as in the reference).  ``keep`` lists columns to keep although the
    config drops them (e.g. ``Num``).
    """
    cols: dict = {}
    if config.id_col and config.id_col in df.columns:
        cols[config.group_col] = split_part(config.id_col, config.id_sep, 0)
    for spec in config.splits:
        if spec.source not in df.columns:
            continue
        arr = split_parts(spec.source, spec.sep, spec.max_parts)
        for i, name in enumerate(spec.names):
            part = F.get(arr, i)
            cols[name] = to_double(part) if name in spec.doubles else part
    out = df.withColumns(cols) if cols else df
    for b in config.bins:
        if b.source in out.columns:
            out = out.withColumn(b.target, bin_fixed(b.source, b.start, b.width, b.count, b.first_label))
    if config.group_col in out.columns:
        out = group_size(out, config.group_col, config.size_col, via=config.group_via)
    to_drop = [c for c in (config.drop_train if is_train else config.drop_test) if c not in keep]
    out = drop_existing(out, to_drop)
    return reorder(out, config.first, config.last)


@dataclass(frozen=True)
class SpendConfig:
    cost_cols: tuple[str, ...] = PASSENGER_COST_COLUMNS
    luxury_cols: tuple[str, ...] = PASSENGER_LUXURY_COLUMNS
    size_col: str = "GroupSize"
    total_col: str = "TotalSpending"
    zero_col: str = "SpendingZero"
    luxury_col: str = "HasLuxurySpending"
    alone_col: str = "IsAlone"
    drop: tuple[str, ...] = ("Names",)


def spend_features(df: DataFrame, config: SpendConfig = SpendConfig()) -> DataFrame:
    """Total spend, zero-spend flag, luxury flag, alone flag; drop first names."""
    costs = [c for c in config.cost_cols if c in df.columns]
    cols: dict = {}
    if costs:
        total = row_sum(costs)
        cols[config.total_col] = total
        cols[config.zero_col] = flag(total == 0)
        lux = [c for c in config.luxury_cols if c in df.columns]
        if lux:
            cols[config.luxury_col] = flag(row_sum(lux) > 0)
    if config.size_col in df.columns:
        cols[config.alone_col] = flag(q(config.size_col) == 1)
    out = df.withColumns(cols) if cols else df
    return drop_existing(out, config.drop)

"""End-to-end preparation flows (survey 3.1 and 3.4) for the passenger schema.

``prepare`` returns *one* DataFrame per branch (tree / nn) with a ``split``
column (and ``fold`` in k-fold mode) instead of files per split; the fitted
states are returned alongside so they can be written (S6, S7) or reused.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import encode as enc
from ..operators import impute as imp
from ..operators import split as sp
from ..operators.features import CompositeConfig, split_composite, spend_features
from ..operators.reshape import drop_existing
from ..operators.state import freeze

CATEGORICAL = ("HomePlanet", "CryoSleep", "Destination", "VIP", "Deck", "Side")
KEY = "PassengerId"
TARGET = "Transported"


@dataclass
class Prepared:
    tree: DataFrame
    nn: DataFrame
    states: list = field(default_factory=list)


def _one_split(train: DataFrame, test: DataFrame, cfg: imp.ImputeConfig, drop_columns: Sequence[str],
               label: dict) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, object]:
    tr, te, state = imp.fit_apply(train, test, cfg)
    # the imputed train frame feeds the encoder fit and the output: computed once
    tr = freeze(spend_features(tr)).df
    te = spend_features(te)
    tree_tr, tree_te = enc.passthrough_encode(tr), enc.passthrough_encode(te)
    oh = enc.onehot_fit(tree_tr, CATEGORICAL)
    nn_tr = enc.onehot_apply(tree_tr, oh, drop_columns)
    nn_te = enc.onehot_apply(tree_te, oh, drop_columns)
    lit = {k: F.lit(v) for k, v in label.items()}
    return (tree_tr.withColumns({**lit, "split": F.lit(sp.TRAIN)}),
            tree_te.withColumns({**lit, "split": F.lit(sp.TEST)}),
            nn_tr.withColumns({**lit, "split": F.lit(sp.TRAIN)}),
            nn_te.withColumns({**lit, "split": F.lit(sp.TEST)}), (state, oh))


def prepare(train_raw: DataFrame, test_raw: DataFrame | None = None, mode: str = "holdout",
            test_size: float = 0.2, k: int = 5, seed: int = 42, exact: bool = False,
            group_key: str | None = None, drop_columns: Sequence[str] = (),
            impute_config: imp.ImputeConfig = imp.ImputeConfig()) -> Prepared:
    """Read-to-encoded preparation.

    ``holdout``: X1 on the train table; ``kfold``: X2, one imputation fit per
    fold (rows appear once per fold, tagged with ``fold``); ``full``: fit on
    the whole train table, apply to ``test_raw`` (X4).  The passenger id is
    kept as the row key throughout (D19).
    """
    both_raw = train_raw if test_raw is None else None
    comp = CompositeConfig()
    if mode == "full":
        if test_raw is None:
            raise ValueError("full mode needs the test table")
        # group sizes are counted per input table, as in the reference
        tr = split_composite(train_raw, is_train=True, config=comp, keep=[KEY])
        te = split_composite(test_raw, is_train=False, config=comp, keep=[KEY])
        a, b, c, d, st = _one_split(tr, te, impute_config, drop_columns, {})
        return Prepared(a.unionByName(b, allowMissingColumns=True),
                        c.unionByName(d, allowMissingColumns=True), [st])
    data = split_composite(both_raw if both_raw is not None else train_raw, is_train=True, config=comp,
                           keep=[KEY])
    if mode == "holdout":
        d = sp.holdout_split(data, KEY, test_size, seed, exact=exact, group_key=group_key)
        a, b, c, e, st = _one_split(d.where(F.col("split") == sp.TRAIN).drop("split"),
                                    d.where(F.col("split") == sp.TEST).drop("split"),
                                    impute_config, drop_columns, {})
        return Prepared(a.unionByName(b), c.unionByName(e, allowMissingColumns=True), [st])
    if mode == "kfold":
        # every fold reads the split rows twice: computed once
        d = freeze(sp.kfold(data, KEY, k, seed, exact=exact, group_key=group_key, col="__fold")).df
        trees, nns, states = [], [], []
        for i in range(k):
            a, b, c, e, st = _one_split(d.where(F.col("__fold") != i).drop("__fold"),
                                        d.where(F.col("__fold") == i).drop("__fold"),
                                        impute_config, drop_columns, {"fold": i})
            trees += [a, b]
            nns += [c, e]
            states.append(st)
        tree = trees[0]
        for t in trees[1:]:
            tree = tree.unionByName(t, allowMissingColumns=True)
        nn = nns[0]
        for t in nns[1:]:
            nn = nn.unionByName(t, allowMissingColumns=True)
        return Prepared(tree, nn, states)
    raise ValueError(f"unknown mode {mode}")


def model_frame(prepared: DataFrame, key: str = KEY, target: str = TARGET) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature columns of a prepared frame
    (the id, target, split and fold columns are never features)."""
    skip = {key, target, "split", "fold"}
    from pyspark.sql import types as T
    num = [f.name for f in prepared.schema.fields
           if f.name not in skip and isinstance(f.dataType, T.NumericType)]
    cat = [f.name for f in prepared.schema.fields
           if f.name not in skip and isinstance(f.dataType, T.StringType)]
    return num, cat


def drop_for_model(df: DataFrame, key: str = KEY) -> DataFrame:
    return drop_existing(df, [key])

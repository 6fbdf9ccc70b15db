"""Statistical imputation with fit-on-train / apply-anywhere state.

Physical shape of ``apply`` (C12):

1. one projection: boolean normalisation, domain rules, constant fills, the
   group key, and the post-Age rule set (its inputs are already final), written
   once; rows without a NULL to fill are done;
2. the modes of all filled columns from one unpivot and counts (``groups.py``),
   and the exact group medians of the cascade target by radix selection
   (``radix.py``), joined to the rows that have a NULL;
3. lookups of the fitted medians by key: equi-joins against frozen state tables,
   broadcast when their measured size allows it;
4. the optional zone model (Spark ML random forest), scored once per combination;
5. draws for the cells that were NULL: one equi-join with the alias tables of
   all features (``alias.py``), folded back by row key.

No rows are collected to the driver and no group is ever gathered in one
task, so a group holding a third of the rows is still split across tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hash_uniform, normalise_bool, q, split_part
from .alias import DICT_SEED, AliasState, alias_fill, fill_seed, fit_alias
from .forest import fit_counted_forest
from .groups import counted_modes, with_group_modes, with_group_stats
from .prefix import running_sums
from .radix import exact_medians
from .reshape import require_columns
from .rules import Rule, apply_rules, fill_constant, homeplanet_rules, passenger_pre_rules
from .state import DEFAULT_MAX_BROADCAST_ROWS, StateTable, freeze

RANGE_BUCKETS = 1024  # u-buckets per feature for the dictionary range lookup


# ---------------------------------------------------------------------- A4
DICT_BUCKETS = 1024  # hash buckets that order a feature's categories


def frequency_dictionary(df: DataFrame, features: Sequence[str], buckets: int = DICT_BUCKETS) -> DataFrame:
    """A4: relative frequencies of the non-null values of each feature.

    Columns ``feature, value, n, total, rel_freq, cum_lo, cum_hi``.  Values
    are compared as strings.  ``[cum_lo, cum_hi)`` are the value's integer
    slots in ``[0, total)`` used by the sampler; categories are laid out in
    the order ``(hash bucket of the value, n desc, value)``, so the running
    sums are bucketed prefix sums (``prefix.py``) and no task ever holds all
    categories of a feature, whatever its cardinality.  One scan;
    ``groupBy(feature, value)`` de-duplicates map-side.
    """
    long = (df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), q(f).cast(T.StringType()).alias("value"))
        for f in features])).alias("s")).select("s.*").where(F.col("value").isNotNull()))
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))  # one row per feature
    bucket = F.floor(hash_uniform(["value"], DICT_SEED) * F.lit(buckets)).cast("long")
    cum = running_sums(counts, bucket, [F.desc("n"), F.asc("value")], ["n"], prefix="cum_",
                       partition_by=["feature"], buckets=buckets)
    return (cum.join(F.broadcast(totals), "feature")
               .select("feature", "value", "n", "total", (F.col("n") / F.col("total")).alias("rel_freq"),
                       (F.col("cum_n") - F.col("n")).alias("cum_lo"), F.col("cum_n").alias("cum_hi")))


def _dictionary_buckets(dictionary: DataFrame, buckets: int = RANGE_BUCKETS) -> DataFrame:
    """Index each dictionary slot ``[cum_lo, cum_hi)`` by the u-buckets it may cover.

    A draw ``u`` picks slot ``r = floor(u * total)``; its u-bucket is
    ``floor(u * buckets)``.  The slot covers u in ``[lo/total, hi/total)``,
    i.e. buckets ``lo*B div total .. (hi*B - 1) div total``; one bucket of
    margin on each side absorbs floating-point rounding.  The range lookup
    becomes an equi-join on ``(feature, bucket)`` plus an exact filter on
    ``r``, with about ``entries + B`` index rows per feature whatever the
    number of categories.
    """
    b = F.lit(buckets)
    first = F.greatest(F.lit(0), F.floor(F.col("cum_lo") * b / F.col("total")) - 1)
    last = F.least(b - 1, F.floor((F.col("cum_hi") * b - 1) / F.col("total")) + 1)
    return dictionary.select(
        "feature", "value", "cum_lo", "cum_hi", "total",
        F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("bucket"))


def sample_fill(df: DataFrame, feature: str, dictionary: StateTable | DataFrame, row_key: Sequence[str],
                seed: int, buckets: int = RANGE_BUCKETS,
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Fill NULLs of ``feature`` by a draw from its frequency dictionary.

    The draw is ``u = hash_uniform(row_key, seed)``; the value is the first
    category (in dictionary order) whose slot contains ``floor(u * total)``.
    Reproducible, independent of partitioning, exact for any number of
    categories.  An empty dictionary leaves the column unchanged.
    """
    dic = dictionary.df if isinstance(dictionary, StateTable) else dictionary
    idx = _dictionary_buckets(dic.where(F.col("feature") == feature), buckets).select(
        F.col("bucket").alias("__ib"), F.col("value").alias("__iv"), F.col("cum_lo").alias("__ilo"),
        F.col("cum_hi").alias("__ihi"), F.col("total").alias("__itot"))
    n_idx = (dictionary.n_rows * 3 + buckets) if isinstance(dictionary, StateTable) else None
    if n_idx is not None and n_idx <= max_broadcast_rows:
        idx = F.broadcast(idx)
    # three transformations of the (possibly large) input plan: draw, join, replace
    u = F.when(q(feature).isNull(), hash_uniform(row_key, fill_seed(seed)))
    probe = df.select("*", u.alias("__u"))
    # rows that need no value match no bucket; numbers below 0 spread them over the tasks of the join
    spread = -F.pmod(F.xxhash64(*[q(k) for k in row_key]), F.lit(1 << 20)) - 1
    probe = probe.select("*", F.coalesce(F.floor(F.col("__u") * F.lit(buckets)).cast("long"), spread).alias("__b"))
    r = F.floor(F.col("__u") * F.col("__itot"))
    joined = probe.join(idx, (F.col("__b") == F.col("__ib")) & (r >= F.col("__ilo")) & (r < F.col("__ihi")),
                        "left")
    dtype = df.schema[feature].dataType
    return joined.select(*[F.coalesce(q(c), F.col("__iv").cast(dtype)).alias(c) if c == feature
                           else q(c) for c in df.columns])


# ---------------------------------------------------------------------- A5-A7
def global_mode(df: DataFrame, *cols: str) -> DataFrame:
    """One-row DataFrame with the mode of each column (the smallest on ties, NULL without values)."""
    return counted_modes(df, [], cols)


def medians_by_key(df: DataFrame, target: str, keys: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Exact medians of ``target`` per value of each key and overall, in one scan.

    Each row counts once for each of its keys and once overall; result
    ``key_name, key_value, median`` with ``key_name = '*'`` for the global
    median.  Keys whose median is NULL (all targets NULL) are dropped, as in the
    reference.  ``accuracy`` gives bounded-memory approximations instead.
    """
    pairs = [F.struct(F.lit(k).alias("key_name"), q(k).cast(T.StringType()).alias("key_value")) for k in keys]
    overall = F.struct(F.lit("*").alias("key_name"), F.lit("").alias("key_value"))
    long = df.select(F.explode(F.array(*pairs, overall)).alias("__key"), q(target).alias("__target"))
    long = long.select("__key.*", "__target").where(F.col("key_value").isNotNull())
    if accuracy is None:
        out = exact_medians(long, ["key_name", "key_value"], "__target")
    else:
        out = long.groupBy("key_name", "key_value").agg(median_expr("__target", accuracy).alias("median"))
    return out.where(F.col("median").isNotNull()).select(
        "key_name", F.when(F.col("key_name") != "*", F.col("key_value")).alias("key_value"), "median")


# ---------------------------------------------------------------------- C7
def resolve_group(df: DataFrame, group_col: str, id_col: str | None, id_sep: str,
                  out: str = "__group") -> DataFrame:
    """The group key: ``group_col`` if present, else the id prefix, else error."""
    if group_col in df.columns:
        return df.withColumn(out, q(group_col))
    if id_col and id_col in df.columns:
        return df.withColumn(out, split_part(q(id_col).cast(T.StringType()), id_sep, 0))
    raise ValueError(f"no group column: neither {group_col!r} nor {id_col!r} present")


# ---------------------------------------------------------------------- C8 / W2 / W3
def group_mode_fill(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """NULLs take the mode of their group (singleton groups are unchanged)."""
    out = with_group_modes(df, group, cols, lambda c: f"__mode_{c}")
    return out.withColumns({c: F.coalesce(q(c), q(f"__mode_{c}")) for c in cols}) \
              .drop(*[f"__mode_{c}" for c in cols])


def median_expr(target: str, accuracy: int | None = None) -> Column:
    """Exact median (interpolated, as pandas) or, with ``accuracy``, the
    bounded-memory ``percentile_approx`` for groups too large for the exact
    aggregate's per-value counts."""
    if accuracy is None:
        return F.median(q(target))
    return F.percentile_approx(q(target), 0.5, accuracy).cast(T.DoubleType())


def with_group_median(df: DataFrame, group: str, target: str, out: str = "__gmed", accuracy: int | None = None,
                      of: DataFrame | None = None) -> DataFrame:
    """``df`` with the median of ``target`` in the row's group (NULL groups have none).

    The median is of the rows ``of`` (by default ``df`` itself), exact or, with
    ``accuracy``, approximate.
    """
    rows = (df if of is None else of).where(q(group).isNotNull()).select(q(group).alias("__of"), q(target).alias("__target"))
    if accuracy is None:
        medians = exact_medians(rows, ["__of"], "__target", out)
    else:
        medians = rows.groupBy("__of").agg(median_expr("__target", accuracy).alias(out))
    return df.join(medians, q(group) == F.col("__of"), "left").drop("__of")


def group_median_fill(df: DataFrame, group: str, target: str, via: str = "join",
                      accuracy: int | None = None) -> DataFrame:
    """NULLs of ``target`` take the median of their group.

    By default from counts of values, which spreads a large group; ``via="window"``
    and ``accuracy`` (approximate) compute it per group instead, for small groups.
    """
    if via == "join":
        out = with_group_median(df, group, target, accuracy=accuracy)
    else:
        out = with_group_stats(df, group, {"__gmed": median_expr(target, accuracy)}, via=via)
    return out.withColumn(target, F.coalesce(q(target), F.col("__gmed"))).drop("__gmed")


def lookup_medians(df: DataFrame, target: str, medians: StateTable, keys: Sequence[str],
                   key_cols: Sequence[str] | None = None,
                   max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """C10 levels 2..n: NULL target <- fitted median of key 1, else key 2, ..., else global.

    ``key_cols`` names the row columns holding the key values (defaults to
    ``keys``), so a caller can look up with values saved before a later rule
    changed them.  One left join per key against the frozen median table.
    """
    key_cols = list(key_cols or keys)
    med = medians.for_join(max_broadcast_rows)
    out = df
    fills = []
    for i, (k, kc) in enumerate(zip(keys, key_cols)):
        alias = f"__med{i}"
        m = med.where(F.col("key_name") == k).select(
            F.col("key_value").alias(f"__kv{i}"), F.col("median").alias(alias))
        out = out.join(m, q(kc).cast(T.StringType()) == q(f"__kv{i}"), "left").drop(f"__kv{i}")
        fills.append(alias)
    # the global median is one value: a scalar subquery, evaluated once
    glob = medians.df.where(F.col("key_name") == "*").agg(F.first("median")).scalar()
    out = out.withColumn(target, F.coalesce(q(target), *[q(a) for a in fills], glob))
    return out.drop(*fills)


# ---------------------------------------------------------------------- C11 model
@dataclass(frozen=True)
class ZoneModelConfig:
    predictors: tuple[str, ...] = ("Deck", "Side", "HomePlanet", "Destination", "VIP")
    num_trees: int = 200
    max_depth: int = 8
    seed: int = 42
    max_memory_mb: int = 256  # node-histogram memory per task (Spark default)


def fit_zone_model(df: DataFrame, target: str, cfg: ZoneModelConfig):
    """Random forest predicting ``target`` (as a category) from ordinal-coded predictors.

    Trained on rows where the target and all predictors are non-null.  All of them are
    categories, so the forest grows on counted combinations (``forest.py``).
    Returns a ``PipelineModel`` or ``None`` when there is no training row.
    """
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    preds = list(cfg.predictors)
    cond = q(target).isNotNull()
    for p in preds:
        cond = cond & q(p).isNotNull()
    train = df.where(cond).select(*[q(p).cast(T.StringType()).alias(p) for p in preds],
                                  q(target).cast(T.StringType()).alias("__zone_label"))
    cells = train.groupBy(*[q(c) for c in train.columns]).agg(F.count(F.lit(1)).alias("__zone_n")).persist()
    try:
        # a split sees every category of a predictor and the slot for unseen ones
        n_cells, *sizes = cells.agg(F.count(F.lit(1)), *[F.count_distinct(q(p)) for p in preds]).first()
        if n_cells == 0:
            return None
        bins = max(32, *(n + 1 for n in sizes))
        stages = [StringIndexer(inputCol=p, outputCol=f"__ix_{p}", stringOrderType="alphabetAsc",
                                handleInvalid="keep") for p in preds]
        stages.append(StringIndexer(inputCol="__zone_label", outputCol="__zone_y", stringOrderType="alphabetAsc"))
        stages.append(VectorAssembler(inputCols=[f"__ix_{p}" for p in preds], outputCol="__zone_x"))
        return fit_counted_forest(cells, stages, train.columns, "__zone_n", n_cells, "__zone_x", "__zone_y", "__zone_pred",
                                  num_trees=cfg.num_trees, max_depth=cfg.max_depth, max_bins=bins, seed=cfg.seed,
                                  max_memory_mb=cfg.max_memory_mb)
    finally:
        cells.unpersist()


def apply_zone_model(df: DataFrame, target: str, model, cfg: ZoneModelConfig) -> DataFrame:
    """Fill NULL targets whose predictors are all non-null with the model's class.

    The predictors are categories, so each combination that occurs in a row to
    fill is scored once, and the answers join back by combination.
    """
    if model is None:
        return df
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import IndexToString

    preds = list(cfg.predictors)
    ok = q(target).isNull()
    for p in preds:
        ok = ok & q(p).isNotNull()
    labels = model.stages[len(preds)].labels
    combos = df.where(ok).select(*[q(p).cast(T.StringType()).alias(p) for p in preds]).distinct()
    # the label indexer is not needed at scoring time: run the other stages
    scoring = PipelineModel([s for i, s in enumerate(model.stages) if i != len(preds)])
    scored = IndexToString(inputCol="__zone_pred", outputCol="__zone_value", labels=labels).transform(
        scoring.transform(combos))
    answers = scored.select(*[q(p).alias(f"__of_{i}") for i, p in enumerate(preds)], "__zone_value")
    same = q(target).isNull()
    for i, p in enumerate(preds):
        same = same & (q(p).cast(T.StringType()) == F.col(f"__of_{i}"))
    filled = F.coalesce(q(target), F.col("__zone_value").cast(df.schema[target].dataType))
    return df.join(answers, same, "left").select(*[filled.alias(c) if c == target else q(c) for c in df.columns])


# ---------------------------------------------------------------------- C12
@dataclass(frozen=True)
class ImputeConfig:
    """Column roles of the imputation driver.  Defaults: the passenger schema."""
    row_key: tuple[str, ...] = ("PassengerId",)
    group_col: str = "Group"
    id_col: str | None = "PassengerId"
    id_sep: str = "_"
    bool_cols: tuple[str, ...] = ("CryoSleep", "VIP")
    pre_rules: Callable[[DataFrame], list[Rule]] | None = passenger_pre_rules
    zero_fill: tuple[str, ...] = ("RoomService", "FoodCourt", "ShoppingMall", "Spa", "VRDeck")
    cascade_target: str | None = "Age"
    cascade_keys: tuple[str, ...] = ("HomePlanet", "Deck")
    post_rules: Callable[[DataFrame], list[Rule]] | None = lambda df: homeplanet_rules()
    zone_col: str | None = "NumZone"
    zone_model: ZoneModelConfig | None = field(default_factory=ZoneModelConfig)
    sample_features: tuple[str, ...] = ("HomePlanet", "Destination", "CryoSleep", "VIP", "Deck", "Side")
    no_group_mode: tuple[str, ...] = ("Destination",)
    seed: int = 42
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS
    median_accuracy: int | None = None  # None: exact medians; else percentile_approx accuracy


@dataclass
class ImputeState:
    medians: StateTable | None
    dictionaries: StateTable | None
    zone_model: object | None
    zone_mode: object | None
    alias: AliasState | None = None  # tables of the dictionaries, for the draws


GROUP = "__group"


def _pre_key(k: str) -> str:
    return f"__pre_{k}"


def _prepare(df: DataFrame, cfg: ImputeConfig) -> DataFrame:
    """Row-local part of C12 (one projection): P11, C2-C5, F8, C7, C6."""
    out = df
    bools = [c for c in cfg.bool_cols if c in out.columns]
    if bools:
        out = out.withColumns({c: normalise_bool(out, c) for c in bools})
    if cfg.pre_rules is not None:
        out = apply_rules(out, cfg.pre_rules(out))
    out = fill_constant(out, cfg.zero_fill, 0.0)
    out = resolve_group(out, cfg.group_col, cfg.id_col, cfg.id_sep, GROUP)
    keys = [k for k in cfg.cascade_keys if k in out.columns]
    if keys:
        out = out.withColumns({_pre_key(k): q(k) for k in keys})
    if cfg.post_rules is not None:
        out = apply_rules(out, cfg.post_rules(out))
    return out


def _mode_columns(df: DataFrame, cfg: ImputeConfig) -> list[str]:
    cols = [c for c in cfg.sample_features if c in df.columns and c not in cfg.no_group_mode]
    return ([cfg.zone_col] if cfg.zone_col and cfg.zone_col in df.columns else []) + cols


def _with_group_statistics(df: DataFrame, of: DataFrame, cfg: ImputeConfig) -> DataFrame:
    """``df`` with the modes and the median of its rows' groups in ``of``."""
    out = with_group_modes(df, GROUP, _mode_columns(of, cfg), lambda c: f"__mode_{c}", of)
    if cfg.cascade_target and cfg.cascade_target in of.columns:
        out = with_group_median(out, GROUP, cfg.cascade_target, "__gmed", cfg.median_accuracy, of)
    return out


def fit(train: DataFrame, cfg: ImputeConfig = ImputeConfig()) -> tuple[ImputeState, DataFrame]:
    """Fit the imputation state on ``train``; returns ``(state, prepared_train)``.

    The prepared train frame (rules applied, before any statistical fill) feeds
    several fits and the caller: computed once, in the checkpoint folder.
    """
    require_columns(train, cfg.row_key, "imputation")
    base = freeze(_prepare(train, cfg)).df
    medians = None
    if cfg.cascade_target and cfg.cascade_target in base.columns:
        keys = [_pre_key(k) for k in cfg.cascade_keys if _pre_key(k) in base.columns]
        m = medians_by_key(base, cfg.cascade_target, keys, cfg.median_accuracy)
        m = m.withColumn("key_name", F.regexp_replace("key_name", "^__pre_", ""))
        medians = freeze(m)
    feats = [c for c in cfg.sample_features if c in base.columns]
    dictionaries = freeze(frequency_dictionary(base, feats)) if feats else None
    alias = fit_alias(dictionaries.df) if dictionaries else None
    zone_model, zone_mode = None, None
    if cfg.zone_col and cfg.zone_col in base.columns:
        # the group-filled train frame feeds the model's indexers, the forest
        # and the mode: computed once, released when the fit is done
        # (its predictors are still as they came: they are filled after it, from group and dictionary)
        z = cfg.zone_col
        grouped = group_mode_fill(base, GROUP, [z]).persist()
        try:
            if cfg.zone_model is not None and grouped.where(q(cfg.zone_col).isNull()).limit(1).count() > 0:
                zone_model = fit_zone_model(grouped, cfg.zone_col, cfg.zone_model)
                scored = apply_zone_model(grouped, cfg.zone_col, zone_model, cfg.zone_model)
            else:
                scored = grouped
            zone_mode = global_mode(scored, z).first()[0]
        finally:
            grouped.unpersist()
    return ImputeState(medians, dictionaries, zone_model, zone_mode, alias), base


def apply(df: DataFrame, state: ImputeState, cfg: ImputeConfig = ImputeConfig(),
          prepared: bool = False) -> DataFrame:
    """Impute ``df`` with a fitted ``state`` (C12 order of the reference).

    ``prepared`` says that ``df`` comes from :func:`fit` (rules applied, in the
    checkpoint folder); another frame is prepared and written there first.  Rows
    without a NULL to fill are done by then; statistics of groups are of all rows,
    but only the other rows are joined with anything.
    """
    base = df if prepared else freeze(_prepare(df, cfg)).df
    features = [f for f in cfg.sample_features if f in base.columns]
    filled = [c for c in dict.fromkeys([cfg.cascade_target, cfg.zone_col, *features]) if c and c in base.columns]
    open_ = F.lit(False)
    for c in filled:
        open_ = open_ | q(c).isNull()
    todo = base.where(open_)
    out = _with_group_statistics(todo, base, cfg)
    # cascade target: group median, then fitted medians by (pre-rule) key, then global
    tgt = cfg.cascade_target
    if tgt and tgt in out.columns:
        out = out.withColumn(tgt, F.coalesce(q(tgt), F.col("__gmed")))
        if state.medians is not None:
            keys = [k for k in cfg.cascade_keys if _pre_key(k) in out.columns]
            out = lookup_medians(out, tgt, state.medians, keys, [_pre_key(k) for k in keys],
                                 cfg.max_broadcast_rows)
    # zone: group mode -> model -> train mode
    z = cfg.zone_col
    if z and z in out.columns:
        out = out.withColumn(z, F.coalesce(q(z), q(f"__mode_{z}")))
        if state.zone_model is not None and cfg.zone_model is not None:
            out = apply_zone_model(out, z, state.zone_model, cfg.zone_model)
        if state.zone_mode is not None:
            out = out.withColumn(z, F.coalesce(q(z), F.lit(state.zone_mode).cast(out.schema[z].dataType)))
    # categorical features: group mode (except the listed ones), then one join with the alias tables of all
    out = out.withColumns({f: F.coalesce(q(f), q(f"__mode_{f}")) for f in features if f"__mode_{f}" in out.columns})
    if state.alias is not None and features:
        seeds = {f: cfg.seed + i for i, f in enumerate(cfg.sample_features) if f in features}
        out = alias_fill(out, seeds, state.alias, list(cfg.row_key), cfg.max_broadcast_rows, of=todo)
    kept = [c for c in base.columns if not c.startswith("__")]
    return base.where(~open_).select(*map(q, kept)).unionByName(out.select(*map(q, kept)))


def fit_apply(train: DataFrame, test: DataFrame | None = None,
              cfg: ImputeConfig = ImputeConfig()) -> tuple[DataFrame, DataFrame | None, ImputeState]:
    """Fit on ``train``, impute ``train`` and (optionally) ``test`` with the train state."""
    state, base = fit(train, cfg)
    tr = apply(base, state, cfg, prepared=True)
    te = apply(test, state, cfg) if test is not None else None
    return tr, te, state

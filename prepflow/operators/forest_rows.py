"""Forests of two classes grown over rows (M5, M8).

The learner is that of Spark ML: bins, Poisson(1) bootstraps, a random share of the features a
node, gini gain, least rows a node, leaves with the same decision joined.  Its work is laid out
by the size of the nodes.  Nodes of many rows are split by sums: each chunk of rows counts
(tree, node, feature, bin, class), the counts are added by a shuffle, and only the splits
reach the driver.  Rows of a node with at most ``ROWS_PER_NODE`` are sent to one task, once, and
the subtree is finished there.  So neither the histograms of small nodes nor whole trees' rows move.

A tree's splits do not depend on how deep it may grow nor on the trees after it: combinations of
a search that differ in depth or number of trees alone share the deepest, largest forest.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import radix

FEWEST_ROWS = 50          # with fewer a bootstrap may be empty
ROWS_PER_CHUNK = 4096     # several chunks a task of ``balanced_for_training``, while the rows are few
ROWS_PER_LARGE_CHUNK = 20_000
MANY_ROWS = 100_000
ROWS_PER_NODE = 100_000   # some 10 bytes a row
TREES_PER_BATCH = 20
SHARED = {"numTrees", "maxDepth", "minInstancesPerNode"}
KNOWN = SHARED | {"seed", "maxBins", "maxMemoryInMB", "cacheNodeIds", "featuresCol", "labelCol"}


@dataclass(frozen=True)
class Bins:
    """Per feature the number of categories (0: a number) and the upper ends of the bins."""

    arity: tuple[int, ...]
    ends: tuple[tuple[float, ...], ...]

    @property
    def width(self) -> int:
        return max(2, *(a or len(e) + 1 for a, e in zip(self.arity, self.ends)))

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(values.shape, np.uint8 if self.width <= 256 else np.uint16)
        for i, (a, e) in enumerate(zip(self.arity, self.ends)):
            out[:, i] = values[:, i] if a else np.searchsorted(np.array(e), values[:, i])
        return out


def fit_bins(rows: DataFrame, features: str, max_bins: int) -> Bins:
    """A bin for every value up to ``max_bins`` of them, else exact quantiles of all rows; categories are their own bins."""
    meta = rows.schema[features].metadata["ml_attr"]
    attrs = meta["attrs"]
    arity = {a["idx"]: len(a["vals"]) for a in attrs.get("nominal", [])} | {a["idx"]: 2 for a in attrs.get("binary", [])}
    n = meta["num_attrs"] if "num_attrs" in meta else sum(map(len, attrs.values()))
    numbers, array = [i for i in range(n) if i not in arity], vector_to_array(features)
    ends: list[tuple[float, ...]] = [()] * n
    if numbers:
        long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), array[i].alias("x")) for i in numbers])).alias("v")) \
                   .select("v.*")
        per = radix.counted(long, ["i"], "x", {"__n": F.count(F.lit(1))})
        few = {r[0] for r in per.rows.df.groupBy("__k0").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") <= max_bins).collect()}
        shares = [F.floor(c * max_bins / F.col("__all")) for c in (F.col("cum___n"), F.col("cum___n") - F.col("__n"))]
        cuts = radix.running(per).where(F.col("__k0").isin(few) | (shares[0] > shares[1])).select("__k0", "__value")
        values = defaultdict(list)
        for r in cuts.collect():  # at most ``max_bins`` a feature
            values[r[0]].append(r[1])
        for i, own in values.items():
            own.sort()
            ends[i] = tuple((a + b) / 2 for a, b in zip(own, own[1:])) if i in few else tuple(own[:-1])
    return Bins(tuple(arity.get(i, 0) for i in range(n)), tuple(ends))


def chunked(rows: DataFrame, features: str, label: str, bins: Bins, size: int) -> DataFrame:
    """``rows`` as chunks of bins; a chunk's number follows from its place in its partition."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [(bins.of(np.stack(b["x"].to_numpy())), b["y"].to_numpy().astype(np.uint8)) for b in batches if len(b)]
        if not kept:
            return
        x, y = (np.concatenate(k) for k in zip(*kept))
        first = TaskContext.get().partitionId() << 20
        for j, start in enumerate(range(0, len(y), size)):
            cut = slice(start, start + size)
            yield pd.DataFrame({"chunk": [first + j], "n": [len(y[cut])], "x": [x[cut].tobytes()], "y": [y[cut].tobytes()]})
    return rows.select(vector_to_array(features).alias("x"), F.col(label).alias("y")) \
               .mapInPandas(pack, "chunk long, n long, x binary, y binary")


# ---------------------------------------------------------------------- splits
@dataclass(frozen=True)
class Growth:
    """What every node of a forest must know."""

    bins: Bins
    per_node: int          # features tried a node
    max_depth: int
    seed: int
    bootstrap: bool = True

    @property
    def dtype(self):
        return np.uint8 if self.bins.width <= 256 else np.uint16

    def weights(self, tree: int, chunk: int, rows: int) -> np.ndarray:
        """How often the bootstrap of a tree draws each row of a chunk."""
        if not self.bootstrap:
            return np.ones(rows, int)
        return np.random.default_rng([self.seed, tree, chunk]).poisson(1.0, rows)

    def tried(self, rng: np.random.Generator, nodes: int) -> np.ndarray:
        p = len(self.bins.arity)
        return np.sort(np.argsort(rng.random((nodes, p)), axis=1)[:, :self.per_node], axis=1)


def histograms(slot: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, tried: np.ndarray, width: int) -> np.ndarray:
    """Weights by (node, tried feature, bin, class)."""
    nodes, k = tried.shape
    at, out = np.arange(len(slot)), np.empty((nodes, k, width, 2))
    for j in range(k):
        cell = (slot.astype(np.int64) * width + x[at, tried[slot, j]]) * 2 + y
        out[:, j] = np.bincount(cell, weights=w, minlength=nodes * width * 2).reshape(nodes, width, 2)
    return out


def _gini(c: np.ndarray) -> np.ndarray:
    n = np.maximum(c[..., 0] + c[..., 1], 1e-300)
    return 1.0 - (c[..., 0] / n) ** 2 - (c[..., 1] / n) ** 2


def best_splits(hist: np.ndarray, tried: np.ndarray, categorical: np.ndarray, least: int):
    """(gain, feature, bins that go left, weights that go left) of each node; no gain, no split."""
    nodes, k, width, _ = hist.shape
    # categories ascend by their weight of class 1, empty ones last, as Spark orders them
    order = np.broadcast_to(np.arange(width), (nodes, k, width))
    nominal = categorical[tried]
    if nominal.any():
        by = np.where(hist[..., 0] + hist[..., 1] > 0, hist[..., 1], np.inf)
        order = np.where(nominal[..., None], np.argsort(by, axis=-1, kind="stable"), order)
        hist = np.take_along_axis(hist, order[..., None], axis=2)
    left = np.cumsum(hist, axis=2)
    total = left[:, :1, -1:, :]
    left = left[:, :, :-1]
    right = total - left
    nl, nr, n = (c[..., 0] + c[..., 1] for c in (left, right, total))
    gain = _gini(total) - nl / n * _gini(left) - nr / n * _gini(right)
    gain[(nl < least) | (nr < least)] = -np.inf
    gain = gain.reshape(nodes, -1)
    best = gain.argmax(1)
    at, j, cut = np.arange(nodes), *np.divmod(best, width - 1)
    goes = np.zeros((nodes, width), bool)
    np.put_along_axis(goes, order[at, j], np.arange(width) <= cut[:, None], axis=1)
    return gain[at, best], tried[at, j], goes, left[at, j, cut]


# ---------------------------------------------------------------------- trees
FIELDS = {"feature": np.int32, "left": np.int32, "right": np.int32, "depth": np.int32, "gain": np.float64, "c": np.float64, "goes": np.bool_}


def _tree(width: int, counts: np.ndarray, depth: np.ndarray) -> dict[str, np.ndarray]:
    n = len(counts)
    return {"feature": np.full(n, -1, np.int32), "left": np.full(n, -1, np.int32), "right": np.full(n, -1, np.int32),
            "depth": depth.astype(np.int32), "gain": np.full(n, -1.0), "c": counts.astype(float), "goes": np.zeros((n, width), bool)}


def _open(tree: dict[str, np.ndarray], at: np.ndarray, max_depth: int) -> np.ndarray:
    return at[(tree["depth"][at] < max_depth) & (tree["c"][at] > 0).all(1)]


def _split(tree: dict[str, np.ndarray], at: np.ndarray, gain, feature, goes, left) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """``tree`` with children for those nodes ``at`` that gain, and the numbers of the children."""
    ok, n = gain > 0, len(tree["feature"])
    at = at[ok]
    first = n + 2 * np.arange(len(at))
    tree["feature"][at], tree["gain"][at], tree["goes"][at] = feature[ok], gain[ok], goes[ok]
    tree["left"][at], tree["right"][at] = first, first + 1
    counts = np.stack([left[ok], tree["c"][at] - left[ok]], 1).reshape(-1, 2)
    more = _tree(goes.shape[1], counts, np.repeat(tree["depth"][at] + 1, 2))
    return {k: np.concatenate([tree[k], more[k]]) for k in tree}, np.arange(n, n + len(counts))


def _step(tree: dict[str, np.ndarray], node: np.ndarray, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Children of inner nodes ``node``."""
    goes = tree["goes"][node, x[rows, tree["feature"][node]]]
    return np.where(goes, tree["left"][node], tree["right"][node])


def reached(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        rows = rows[tree["feature"][node[rows]] >= 0]
        node[rows] = _step(tree, node[rows], x, rows)
    return node


def grow(growth: Growth, x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """The subtree of rows that share a node at ``depth``, level by level."""
    width, categorical = growth.bins.width, np.array(growth.bins.arity) > 0
    tree = _tree(width, np.bincount(y, weights=w, minlength=2)[None], np.array([depth]))
    node, rows, level = np.zeros(len(y), np.int64), np.arange(len(y)), np.array([0])
    while len(level := _open(tree, level, growth.max_depth)):
        slots = np.full(len(tree["feature"]), -1, np.int64)
        slots[level] = np.arange(len(level))
        rows = rows[slots[node[rows]] >= 0]
        tried = growth.tried(rng, len(level))
        found = best_splits(histograms(slots[node[rows]], x[rows], y[rows], w[rows], tried, width), tried, categorical, least)
        tree, level = _split(tree, level, *found)
        rows = rows[tree["feature"][node[rows]] >= 0]
        node[rows] = _step(tree, node[rows], x, rows)
    return tree


def leaves(tree: dict[str, np.ndarray], depth: int) -> np.ndarray:
    """Which nodes are leaves at a greatest ``depth``; leaves of the same decision side by side are joined."""
    leaf, says = (tree["feature"] < 0) | (tree["depth"] >= depth), tree["c"][:, 1] > tree["c"][:, 0]
    for d in range(min(depth, int(tree["depth"].max())) - 1, -1, -1):
        at = np.flatnonzero((tree["depth"] == d) & ~leaf)
        a, b = tree["left"][at], tree["right"][at]
        leaf[at[leaf[a] & leaf[b] & (says[a] == says[b])]] = True
    return leaf


def _pack(tree: dict[str, np.ndarray]) -> dict[str, bytes]:
    return {k: (np.packbits(tree[k]) if k == "goes" else tree[k].astype(t)).tobytes() for k, t in FIELDS.items()}


def _unpack(r, width: int) -> dict[str, np.ndarray]:
    out = {k: np.frombuffer(r[k], t).copy() for k, t in FIELDS.items() if k != "goes"}
    goes = np.unpackbits(np.frombuffer(r["goes"], np.uint8), count=len(out["feature"]) * width)
    return {**out, "c": out["c"].reshape(-1, 2), "goes": goes.astype(bool).reshape(-1, width)}


PACKED = ", ".join(f"{k} binary" for k in FIELDS)


# ---------------------------------------------------------------------- Spark jobs
def _drawn(chunks: DataFrame, jobs: DataFrame, growth: Growth, tops: dict, each, schema: str, tasks: int) -> DataFrame:
    """``each(job, tree number, x, y, w, node)`` for every chunk and tree, over the rows that the bootstrap drew."""
    p, dtype = len(growth.bins.arity), growth.dtype

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                x, y = np.frombuffer(r.x, dtype).reshape(-1, p), np.frombuffer(r.y, np.uint8)
                out = []
                for t in range(r.start, r.stop):
                    if tops and (r.least, t) not in tops:
                        continue
                    w = growth.weights(t, r.chunk, len(y))
                    some = np.flatnonzero(w)
                    xs, top = x[some], tops.get((r.least, t))
                    out += each(r, t, xs, y[some], w[some], reached(top, xs) if top else np.zeros(len(some), np.int64))
                if out:
                    yield pd.DataFrame(out)
    return chunks.crossJoin(F.broadcast(jobs)).repartition(tasks, "chunk", "least", "start").mapInPandas(visit, schema)


def _top_levels(chunks: DataFrame, jobs: DataFrame, growth: Growth, variants: Sequence[int], trees: int, tasks: int) -> dict:
    """Splits of the nodes with more than ``ROWS_PER_NODE`` rows, a level at a time: {(least rows, tree): top of the tree}."""
    width, categorical = growth.bins.width, np.array(growth.bins.arity) > 0

    def roots(r, t, x, y, w, node):
        return [{"least": r.least, "tree": t, "c0": float(w[y == 0].sum()), "c1": float(w[y == 1].sum())}]
    found = _drawn(chunks, jobs, growth, {}, roots, "least int, tree int, c0 double, c1 double", tasks) \
        .groupBy("least", "tree").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).collect()
    tops = {(r["least"], r["tree"]): _tree(width, np.array([[r["c0"], r["c1"]]]), np.array([0])) for r in found}
    level = {k: np.array([0]) for k in tops}
    while True:
        big = {}
        for k, at in level.items():
            at = _open(tops[k], at, growth.max_depth)
            if len(at := at[tops[k]["c"][at].sum(1) > ROWS_PER_NODE]):
                big[k] = at
        if not big:
            return tops

        def tried(least: int, t: int) -> np.ndarray:
            return np.concatenate([growth.tried(np.random.default_rng([growth.seed, t, least, int(v)]), 1) for v in big[least, t]])

        def count(r, t, x, y, w, node):
            at = big[r.least, t]
            slots = np.full(node.max(initial=at.max()) + 1, -1, np.int64)
            slots[at] = np.arange(len(at))
            rows = np.flatnonzero(slots[node] >= 0)
            h = histograms(slots[node[rows]], x[rows], y[rows], w[rows], tried(r.least, t), width)
            return [{"least": r.least, "tree": t, "h": h.astype(np.int32).tobytes()}]

        def choose(b: pd.DataFrame) -> pd.DataFrame:
            least, t = int(b["least"].iloc[0]), int(b["tree"].iloc[0])
            h = reduce(np.add, (np.frombuffer(h, np.int32).astype(float) for h in b["h"])).reshape(-1, growth.per_node, width, 2)
            gain, feature, goes, left = best_splits(h, tried(least, t), categorical, least)
            return pd.DataFrame({"least": least, "tree": t, "node": big[least, t], "gain": gain, "feature": feature,
                                 "goes": [g.tobytes() for g in goes], "left": left.tolist()})
        live = {k: tops[k] for k in big}
        wanted = jobs.where(F.col("least").isin([k[0] for k in big]))
        counts = _drawn(chunks, wanted, growth, live, count, "least int, tree int, h binary", tasks)
        splits = counts.groupBy("least", "tree").applyInPandas(
            choose, "least int, tree int, node int, gain double, feature int, goes binary, left array<double>").collect()
        by = defaultdict(list)
        for r in splits:
            by[r["least"], r["tree"]].append(r)
        level = {}
        for k, rs in by.items():
            rs.sort(key=lambda r: r["node"])
            tops[k], level[k] = _split(tops[k], np.array([r["node"] for r in rs]), np.array([r["gain"] for r in rs]),
                                       np.array([r["feature"] for r in rs]), np.array([np.frombuffer(r["goes"], bool) for r in rs]),
                                       np.array([r["left"] for r in rs]))


def grown_trees(chunks: DataFrame, growth: Growth, variants: Sequence[int], trees: int, rows: int) -> DataFrame:
    """One row per least number of rows and tree: ``least, tree`` and the tree's arrays."""
    spark = chunks.sparkSession
    p, width, dtype = len(growth.bins.arity), growth.bins.width, growth.dtype
    small = rows <= ROWS_PER_NODE  # then the tops are bare roots, and the variants of a tree share its rows
    own = [(v if not small else 0, s, min(trees, s + TREES_PER_BATCH)) for v in (variants if not small else [0]) for s in range(0, trees, TREES_PER_BATCH)]
    jobs = spark.createDataFrame(own, "least int, start int, stop int")
    tasks = 4 * spark.sparkContext.defaultParallelism
    tops = {} if small else _top_levels(chunks, jobs, growth, variants, trees, tasks)

    def send(r, t, x, y, w, node):
        top, order = tops.get((r.least, t)), np.argsort(node, kind="stable")
        cuts = np.flatnonzero(np.diff(node[order])) + 1
        out = []
        for at in np.split(order, cuts) if len(order) else ():
            v = int(node[at[0]])
            if top is None or len(_open(top, np.array([v]), growth.max_depth)) and top["c"][v].sum() <= ROWS_PER_NODE:
                out.append({"least": r.least, "tree": t, "node": v, "chunk": r.chunk, "x": x[at].tobytes(), "y": y[at].tobytes(),
                            "w": w[at].astype(np.uint8).tobytes()})
        return out

    def finish(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("chunk")
        least, t, v = (int(b[c].iloc[0]) for c in ("least", "tree", "node"))
        x = np.frombuffer(b"".join(b["x"]), dtype).reshape(-1, p)
        y, w = (np.frombuffer(b"".join(b[c]), np.uint8).astype(int) for c in "yw")
        top = tops.get((least, t))
        depth = int(top["depth"][v]) if top else 0
        out = []
        for own in (variants if small else [least]):
            sub = grow(growth, x, y, w, depth, own, np.random.default_rng([growth.seed, t, own, v]))
            out.append({"least": own, "tree": t, "node": v, **_pack(sub)})
        return pd.DataFrame(out)

    sent = _drawn(chunks, jobs, growth, tops, send, "least int, tree int, node int, chunk long, x binary, y binary, w binary", tasks)
    parts = max(tasks, rows * trees * len(variants) // 10_000_000)
    subtrees = sent.repartition(parts, "least", "tree", "node").groupBy("least", "tree", "node") \
                   .applyInPandas(finish, f"least int, tree int, node int, {PACKED}")
    if small:
        return subtrees.drop("node")
    bare = spark.createDataFrame([(*k, -1, *_pack(top).values()) for k, top in tops.items()], f"least int, tree int, node int, {PACKED}")

    def assemble(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("node")
        least, t = int(b["least"].iloc[0]), int(b["tree"].iloc[0])
        whole, *subs = [_unpack(r, width) for r in b.to_dict("records")]
        parts, n = [whole], len(whole["feature"])
        for v, sub in zip(b["node"].iloc[1:], subs):  # the subtree's root takes its place in the top
            for side in ("left", "right"):
                sub[side] = np.where(sub[side] > 0, sub[side] + n - 1, -1)
            for k in FIELDS:
                whole[k][v] = sub[k][0]
            parts.append({k: sub[k][1:] for k in FIELDS})
            n += len(sub["feature"]) - 1
        tree = {k: np.concatenate([part[k] for part in parts]) for k in FIELDS}
        return pd.DataFrame([{"least": least, "tree": t, **_pack(tree)}])
    return subtrees.unionByName(bare).groupBy("least", "tree").applyInPandas(assemble, f"least int, tree int, {PACKED}")


# ---------------------------------------------------------------------- fits
def grows(classifier, rows: DataFrame, combinations: Sequence[dict] = (), folds: int = 1) -> bool:
    """Whether the forest is one of two classes, and nothing is set that is not known here."""
    named = {p.name for p in classifier.extractParamMap() if classifier.isSet(p)}
    if not named <= KNOWN or not all(set(c) <= SHARED for c in combinations):
        return False
    label = F.col(classifier.getLabelCol())
    zeros, ones, n = rows.agg(F.count_if(label == 0), F.count_if(label == 1), F.count(F.lit(1))).first()
    return zeros > 0 and ones > 0 and zeros + ones == n and n >= FEWEST_ROWS * (1 + (folds > 1))


def _prepared(pipeline: Pipeline, rows: DataFrame):
    *prepare, classifier = pipeline.getStages()
    features, label = classifier.getFeaturesCol(), classifier.getLabelCol()
    stages = Pipeline(stages=prepare).fit(rows)
    train = stages.transform(rows).select(features, label)
    bins = fit_bins(train, features, classifier.getMaxBins())
    return stages, train, bins


def _chunk(rows: int) -> int:
    return ROWS_PER_CHUNK if rows <= MANY_ROWS else ROWS_PER_LARGE_CHUNK


def _per_node(features: int, trees: int) -> int:
    return features if trees == 1 else int(np.ceil(np.sqrt(features)))


def fit_forest(pipeline: Pipeline, rows: DataFrame, params: dict | None = None) -> PipelineModel:
    """``pipeline``, whose last stage is a random forest of two classes, fitted on ``rows``; the forest stays in the shared folder."""
    clf = pipeline.getStages()[-1]
    clf = clf.copy({clf.getParam(k): v for k, v in (params or {}).items()})
    stages, train, bins = _prepared(pipeline, rows)
    growth = Growth(bins, _per_node(len(bins.arity), clf.getNumTrees()), clf.getMaxDepth(), clf.getSeed())
    n = train.count()
    chunks = chunked(train, clf.getFeaturesCol(), clf.getLabelCol(), bins, _chunk(n)).persist()
    try:
        trees = grown_trees(chunks, growth, [clf.getMinInstancesPerNode()], clf.getNumTrees(), n)
        return StoredForestModel(stages.stages, saved_model(clf, train, trees, growth))
    finally:
        chunks.unpersist()


class StoredForestModel(PipelineModel):
    """A fitted pipeline that ends with the forest saved at ``path``.

    The forest has as many nodes as rows and trees make, and Spark ML holds a model in the driver: it is
    loaded when the stages are first asked for (to score, save or look at them), not before.
    """

    def __init__(self, prepare: Sequence, path: str):
        self._prepare, self._forest, self.path = list(prepare), None, path
        super().__init__([])

    @property
    def stages(self) -> list:
        if self._forest is None:
            self._forest = RandomForestClassificationModel.load(self.path)
        return [*self._prepare, self._forest]

    @stages.setter
    def stages(self, own: Sequence) -> None:
        if own:
            *self._prepare, self._forest = own


def spark_model(clf, train: DataFrame, trees: DataFrame, growth: Growth) -> RandomForestClassificationModel:
    """``trees`` as a model of Spark ML, held by the driver."""
    return RandomForestClassificationModel.load(saved_model(clf, train, trees, growth))


def saved_model(clf, train: DataFrame, trees: DataFrame, growth: Growth) -> str:
    """Where ``trees`` lie as a saved model of Spark ML, in the shared checkpoint folder; the tasks write the nodes."""
    spark, bins, depth, width = train.sparkSession, growth.bins, growth.max_depth, growth.bins.width
    path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    stub = clf.copy({clf.numTrees: 1, clf.maxDepth: 0}).fit(train)
    stub.write().save(f"{path}/stub")
    node = "id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, rightChild int, " \
           "split struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>"

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                t = _unpack(r, width)
                leaf, keep = leaves(t, depth), np.zeros(len(t["feature"]), bool)
                keep[0] = True
                for i in np.argsort(t["depth"], kind="stable"):
                    if keep[i] and not leaf[i]:
                        keep[[t["left"][i], t["right"][i]]] = True
                order = np.argsort(t["depth"], kind="stable")
                order = order[keep[order]]
                number = np.full(len(keep), -1)
                number[order] = np.arange(len(order))
                gini, out = _gini(t["c"]), []
                for i in order:
                    f, inner = int(t["feature"][i]), not leaf[i]
                    goes = np.flatnonzero(t["goes"][i])
                    to = [] if not inner else goes.astype(float).tolist() if bins.arity[f] else [float(bins.ends[f][goes[-1]])]
                    out.append({"id": int(number[i]), "prediction": float(t["c"][i, 1] > t["c"][i, 0]), "impurity": float(gini[i]),
                                "impurityStats": t["c"][i].tolist(), "rawCount": int(t["c"][i].sum()), "gain": float(t["gain"][i]) if inner else -1.0,
                                "leftChild": int(number[t["left"][i]]) if inner else -1, "rightChild": int(number[t["right"][i]]) if inner else -1,
                                "split": {"featureIndex": f if inner else -1, "leftCategoriesOrThreshold": to,
                                          "numCategories": bins.arity[f] or -1 if inner else -1}})
                yield pd.DataFrame({"treeID": r["tree"], "nodeData": out})
    trees.mapInPandas(nodes, f"treeID int, nodeData struct<{_struct(node)}>").write.parquet(f"{path}/model/data")
    count = clf.getNumTrees()
    spark.range(count).select(F.col("id").cast("int").alias("_1")).crossJoin(
        spark.read.parquet(f"{path}/stub/treesMetadata").select("_2", "_3")).coalesce(1).write.parquet(f"{path}/model/treesMetadata")
    meta = json.loads(spark.read.text(f"{path}/stub/metadata").first()[0])
    meta["numTrees"], meta["paramMap"] = count, {**meta["paramMap"], "numTrees": count, "maxDepth": depth}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/model/metadata")
    return f"{path}/model"


def _struct(columns: str) -> str:
    head, split = columns.split(", split ")
    return ",".join(c.replace(" ", ":", 1) for c in head.split(", ")) + ",split:" + split


def fold_accuracies(data: DataFrame, pipeline: Pipeline, combinations: Sequence[dict], fold: str, folds: int, parallelism: int = 4) -> list[float]:
    """Mean accuracy of each combination over the folds of column ``fold``; one forest a fold and least number of rows."""
    clf = pipeline.getStages()[-1]
    combos = [tuple(c.get(k, clf.getOrDefault(k)) for k in ("numTrees", "maxDepth", "minInstancesPerNode")) for c in combinations]

    def one(i: int) -> list[float]:
        rows, test = data.where(F.col(fold) != i), data.where(F.col(fold) == i)
        stages, train, bins = _prepared(pipeline, rows)
        features, label = clf.getFeaturesCol(), clf.getLabelCol()
        n = train.count()
        chunks = chunked(train, features, label, bins, _chunk(n)).persist()
        out: list[float] = [0.0] * len(combos)
        try:
            held = chunked(stages.transform(test).select(features, label), features, label, bins, ROWS_PER_CHUNK)
            # a single tree tries all features, so it shares nothing with larger forests
            for single in {c[0] == 1 for c in combos}:
                mine = {j: c for j, c in enumerate(combos) if (c[0] == 1) == single}
                most = max(c[0] for c in mine.values())
                growth = Growth(bins, _per_node(len(bins.arity), most), max(c[1] for c in mine.values()), clf.getSeed())
                trees = grown_trees(chunks, growth, sorted({c[2] for c in mine.values()}), most, n)
                for j, right in zip(mine, shares_right(trees, held, growth, list(mine.values()))):
                    out[j] = right
            return out
        finally:
            chunks.unpersist()

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, folds))) as pool:
        results = list(pool.map(one, range(folds)))
    return [sum(r) / folds for r in zip(*results)]


def shares_right(trees: DataFrame, held: DataFrame, growth: Growth, combos: Sequence[tuple[int, int, int]]) -> list[float]:
    """Share of right decisions on ``held`` of each (trees, depth, least rows), from one pass of the rows through each tree."""
    p, width, dtype = len(growth.bins.arity), growth.bins.width, growth.dtype
    depths, cuts = sorted({c[1] for c in combos}), sorted({c[0] for c in combos})
    least = sorted({c[2] for c in combos})
    batch = sum((F.col("tree") >= c).cast("int") for c in cuts) * 1_000_000 + F.floor(F.col("tree") / TREES_PER_BATCH)
    spark = trees.sparkSession
    batches = sorted({sum(t >= c for c in cuts) * 1_000_000 + t // TREES_PER_BATCH for t in range(max(cuts))})
    keys = spark.createDataFrame([(v, b) for v in least for b in batches], "least int, batch long")
    tasks = 4 * spark.sparkContext.defaultParallelism
    by_batch = trees.withColumn("batch", batch.cast("long")).repartition(tasks, "least", "batch") \
                    .groupBy("least", "batch").agg(F.sort_array(F.collect_list(F.struct("tree", *FIELDS))).alias("trees"))
    pairs = by_batch.join(held.crossJoin(F.broadcast(keys)), ["least", "batch"])

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            for r in b.itertuples():
                x = np.frombuffer(r.x, dtype).reshape(-1, p)
                votes = np.zeros((len(depths), len(x)))
                for packed in r.trees:
                    t = _unpack(packed, width)
                    share = t["c"][:, 1] / t["c"].sum(1)
                    for k, d in enumerate(depths):
                        cut = {**t, "feature": np.where(leaves(t, d), -1, t["feature"])}
                        votes[k] += share[reached(cut, x)]
                yield pd.DataFrame({"least": [r.least], "batch": [r.batch], "chunk": [r.chunk], "y": [r.y], "votes": [votes.tobytes()]})

    def decide(b: pd.DataFrame) -> pd.DataFrame:
        y, v = np.frombuffer(b["y"].iloc[0], np.uint8), int(b["least"].iloc[0])
        sums = np.zeros((len(cuts), len(depths), len(y)))
        for r in b.sort_values("batch").itertuples():
            sums[r.batch // 1_000_000] += np.frombuffer(r.votes).reshape(len(depths), -1)
        sums = np.cumsum(sums, axis=0)
        out = [(j, int(((sums[cuts.index(n), depths.index(d)] > n / 2) == (y == 1)).sum()), len(y))
               for j, (n, d, own) in enumerate(combos) if own == v]
        return pd.DataFrame(out, columns=["combo", "ok", "n"])
    voted = pairs.mapInPandas(vote, "least int, batch long, chunk long, y binary, votes binary")
    found = voted.groupBy("least", "chunk").applyInPandas(decide, "combo int, ok long, n long") \
                 .groupBy("combo").agg((F.sum("ok") / F.sum("n")).alias("a")).collect()
    got = {r["combo"]: float(r["a"]) for r in found}
    return [got.get(j, float("nan")) for j in range(len(combos))]

"""Similarity self-join on word n-grams (exact Jaccard) with signature trees.

A document's set holds the 64-bit hashes of its distinct n-word shingles.  Equal
sets are one class, represented by the smallest id.  The join of the classes has
two parts.

Routing brings every pair that links into one group.  Two sets that link differ
in at most d elements, d following from their sizes; cut into more than d parts
by hash, they agree in some part.  So each set sends one signature per part,
separately for each pair of neighbouring size classes, and sets that share a
signature are candidates.  Elements that very many documents share (a fixed-size
bitmap of them is made first) would make parts agree by accident, so parts are
made of the other elements.  A set with too many empty parts for that to be
complete also sends parts of all its elements, and if even there too many are
empty, the empty ones.  Sharing a signature is transitive: candidates are the
components of that relation.

Inside a group, a signature tree finds the links.  Sets are sorted by size;
nodes hold the OR of their sets' token bitmaps, their range of sizes and the
largest number of elements hidden by collisions in one bitmap.  A dual traversal
drops pairs of nodes whose largest possible overlap is too small, and pairs of
sets that are already connected; what is left is compared exactly.  A group that
is too large for one task is cut into blocks by hash: each block is compared with
itself and the first block, and only if the group is not connected by then are
the other pairs of blocks compared.  Links come back as forests, never as all
pairs of a group.

Texts are read again where sets are needed again, so that sets are shuffled for
candidates only.

Where an id stands for several rows, rows are numbered first, and each goes with the
class of its own text; a component is named by its smallest id all the same.

Defined results: NULL or empty texts have an empty set and link with nothing;
rows with NULL ``doc_id`` link with nothing and have a NULL component; rows that
repeat a ``doc_id`` go each with the class of its own text; very long texts are one
set like others (a task holds one text at a time, and the sets of one block); an
empty table gives no rows; other columns are ignored by the join and kept by
``keep_first``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from .common import Recent, frozen, ids_name_rows, packed, small_side, unpacked
from .components import components
from .membership import near, staying

HOT_BITS = 22
HOT_BUFFER = 6_000_000  # elements counted together in a task
HOT_IN_BUFFER = 2
SIGNATURE_BUFFER = 1_000_000
LEAF, FANOUT = 16, 8


@dataclass(frozen=True)
class Similarity:
    """Sets link when 100 * intersection >= ``percent`` * union; sets are of ``words``-word shingles."""

    words: int = 4
    percent: int = 85
    block_elements: int = 2_000_000  # of a group; a task holds two blocks at most
    block_sets: int = 2048

    def linked(self, a: int, b: int, common: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    @cached_property
    def _bounds(self) -> list[int]:
        """Where size classes start: a class spans the square of the largest ratio of sizes that link."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, -(-out[-1] * 10_000 // self.percent ** 2)))
        return out

    def parts(self, size: int) -> list[tuple[int, int, int]]:
        """For a set size, the (size class, parts, parts that agree at least) it sends signatures for."""
        i = int(np.searchsorted(self._bounds, size, side="right")) - 1
        out = []
        for c in (i, i - 1):
            if c < 0:
                continue
            top = self._bounds[c + 1] - 1  # of the smaller set
            partner = top * 100 // self.percent
            if size > max(top, partner):
                continue
            differ = (top + max(top, partner)) * (100 - self.percent) // (100 + self.percent)
            agree = 2 + differ // 4
            out.append((c, differ + agree, agree))
        return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text (A-Z lower-cased)."""

    def __init__(self, words: int):
        self.words = words
        self.hash = Recent(xxhash.xxh64_intdigest)

    def __call__(self, text: bytes) -> np.ndarray:
        w = np.array(list(map(self.hash.__getitem__, text.lower().split())), dtype=np.uint64)
        k = self.words
        if len(w) == 0:
            return w
        if len(w) < k:
            h = np.uint64(len(w)).reshape(1)
            for x in w:
                h = _mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + x)
            return h
        n = len(w) - k + 1
        h = w[:n]
        for j in range(1, k):
            h = _mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + w[j:j + n])
        return np.unique(_mix(h))


def _texts(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(column)), (t.as_py() or b"" for t in b.column(column)))


def _flat(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


# ------------------------------------------------------------------ first reading: classes and common elements
FACTS = "doc_id long, n long, print binary, element long, times long"


def _facts(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """A row per document (size and print of its set), and rows of elements that are frequent in the task."""
    shingles, rows, held, size, seen = Shingler(words), [], [], 0, set()
    names = ["doc_id", "n", "print", "element", "times"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def frequent() -> list[tuple]:
        elements, times = np.unique(np.concatenate(held), return_counts=True)
        often = times >= HOT_IN_BUFFER
        return [(None, None, None, e, t) for e, t in zip(elements[often].view(np.int64).tolist(), times[often].tolist())]

    for doc_id, text in _texts(batches, 1):
        s = shingles(text)
        mark = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
        rows.append((doc_id, len(s), mark, None, None))
        if mark is not None and mark not in seen:
            seen.add(mark)
            held.append(s)
            size += len(s)
            if size >= HOT_BUFFER:
                rows += frequent()
                held, size = [], 0
                seen.clear()
        if len(rows) >= 20_000:
            yield _flat(names, types, rows)
            rows = []
    if held:
        rows += frequent()
    yield _flat(names, types, rows)


def _common_elements(facts: DataFrame, documents: int) -> np.ndarray:
    """Bitmap over the top ``HOT_BITS`` bits of elements: those that many documents share (2 ** 16 words at most)."""
    least = max(16, documents // 16384)
    slot = F.shiftrightunsigned("element", 64 - HOT_BITS)
    words = (facts.where(F.col("element").isNotNull()).groupBy("element").agg(F.sum("times").alias("times"))
             .where(F.col("times") >= least)
             .groupBy(F.shiftright(slot, 6).cast("int").alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")))
                  .alias("bits"))).collect()
    bitmap = np.zeros(1 << (HOT_BITS - 6), dtype=np.int64)
    for r in words:
        bitmap[r["word"]] = r["bits"]
    return bitmap.view(np.uint64)


# ------------------------------------------------------------------ second reading: signatures
def signatures(s: np.ndarray, similarity: Similarity, common: np.ndarray) -> np.ndarray:
    """Signatures of a sorted set; sets that link share at least one.

    Where fewer parts are empty than agree, as many of the last ones are spared as leave one sure to agree: of two sets,
    the one that spares more agrees in more of the parts before than it has empty ones there, and the other sends those too.
    """
    slot = s >> np.uint64(64 - HOT_BITS)
    own = s[(common[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 0]
    out = []
    for size_class, parts, agree in similarity.parts(len(s)):
        for scheme, elements in ((0, own), (1, s)):
            cuts = np.searchsorted((elements >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32),
                                   np.arange(parts + 1, dtype=np.uint64))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(elements))))
            sums = sums[cuts[1:]] - sums[cuts[:-1]]
            empty = cuts[1:] == cuts[:-1]
            name = np.uint64((size_class * 2 + scheme) << 32) + np.arange(parts, dtype=np.uint64)
            all_parts = _mix(sums + _mix(name + np.uint64(1)))
            spare = agree - 1 - int(empty.sum())
            out.append(all_parts if spare < 0 and scheme else all_parts[~empty])
            if spare >= 0:
                out[-1] = out[-1][:len(out[-1]) - spare]
                break
    return np.concatenate(out)


def _signature_rows(batches: Iterable[pa.RecordBatch], similarity: Similarity, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(signature, doc_id), combined in the task: of the documents of a buffer that share a signature, the first
    alone sends it, and the others share a signature of their own with the first."""
    shingles, sigs, docs, size, seen = Shingler(similarity.words), [], [], 0, set()

    def combined() -> pa.RecordBatch:
        sig = np.concatenate(sigs)
        doc = np.repeat(np.array(docs, dtype=np.int64), [len(x) for x in sigs])
        unique, first, back = np.unique(sig, return_index=True, return_inverse=True)
        leader = doc[first]
        pairs = np.unique(np.stack((doc, leader[back]), axis=1)[doc != leader[back]], axis=0)
        own = lambda x: _mix(_mix(x.astype(np.uint64)) + np.uint64(0xD6E8FEB86659FD93))
        leaders = np.unique(pairs[:, 1])
        sig = np.concatenate((unique, own(pairs[:, 1]), own(leaders))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.concatenate((leader, pairs[:, 0], leaders)))],
                                          ["signature", "doc_id"])

    for doc_id, text in _texts(batches, 1):
        s = shingles(text)
        if doc_id is None or len(s) == 0:
            continue
        mark = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        sigs.append(signatures(s, similarity, common))
        docs.append(doc_id)
        size += len(sigs[-1])
        if size >= SIGNATURE_BUFFER:
            yield combined()
            sigs, docs, size = [], [], 0
    if sigs:
        yield combined()


# ------------------------------------------------------------------ inside a group: signature trees
class Forest:
    """Union-find over places, the smallest id at the root."""

    def __init__(self, ids: list[int]):
        self.ids, self.up = ids, list(range(len(ids)))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            low, high = (i, j) if self.ids[i] < self.ids[j] else (j, i)
            self.up[high] = low


class SignatureTree:
    """Levels of nodes over sets sorted by size, leaves of ``LEAF`` sets first."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        bits = 64
        while bits < 4 * self.sizes[-1] and bits < 1 << 16:
            bits *= 2
        self.maps = np.empty((len(sets), bits // 64), dtype=np.uint64)
        self.hidden = np.empty(len(sets), dtype=np.int64)
        for i, s in enumerate(sets):
            flags = np.zeros(bits, dtype=bool)
            flags[(s & np.uint64(bits - 1)).astype(np.int64)] = True
            self.maps[i] = np.packbits(flags).view(np.uint64)
            self.hidden[i] = len(s) - flags.sum()
        self.levels = []  # (maps, smallest, largest, most hidden)
        maps, low, high, hidden, step = self.maps, self.sizes, self.sizes, self.hidden, LEAF
        while True:
            at = np.arange(0, len(maps), step)
            maps, low = np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at)
            high, hidden = np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at)
            self.levels.append((maps, low, high, hidden))
            if len(maps) == 1:
                return
            step = FANOUT

    @staticmethod
    def open_pairs(a: tuple, i: slice, j: slice, percent: int) -> np.ndarray:
        """Which pairs of nodes (or sets) may still overlap enough."""
        maps, low, high, hidden = a
        common = np.bitwise_count(maps[i, None] & maps[None, j]).sum(axis=2, dtype=np.int64)
        most = np.minimum(common + np.minimum(hidden[i, None], hidden[None, j]),
                          np.minimum(high[i, None], high[None, j]))
        return (100 + percent) * most >= percent * (low[i, None] + low[None, j])


def link(ids: list[int], known: list[int], sets: list[np.ndarray], similarity: Similarity) -> list[tuple[int, int]]:
    """Edges (id, smaller id) that connect what links; ``known`` are components found before."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, known, sets = [ids[i] for i in order], [known[i] for i in order], [sets[i] for i in order]
    forest, first = Forest(ids), {}
    for i, c in enumerate(known):
        forest.join(first.setdefault(c, i), i)

    def compare(i: int, j: int) -> None:
        a, b = sets[i], sets[j]
        if forest.root(i) != forest.root(j) and 100 * len(a) >= similarity.percent * len(b):
            if similarity.linked(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))):
                forest.join(i, j)

    if len(ids) <= 4:
        for j in range(len(ids)):
            for i in range(j):
                compare(i, j)
    else:
        tree = SignatureTree(sets)
        leaf = (tree.maps, tree.sizes, tree.sizes, tree.hidden)
        stack = [(len(tree.levels) - 1, 0, 0)]
        while stack:
            level, x, y = stack.pop()
            step = FANOUT if level else LEAF
            i, j = slice(x * step, (x + 1) * step), slice(y * step, (y + 1) * step)
            if level:
                near = tree.open_pairs(tree.levels[level - 1], i, j, similarity.percent)
            else:
                roots = [np.array([forest.root(k) for k in range(*s.indices(len(ids)))]) for s in (i, j)]
                near = roots[0][:, None] != roots[1][None]
                if near.any():
                    near &= tree.open_pairs(leaf, i, j, similarity.percent)
            for p, r in zip(*np.nonzero(near)):
                p, r = int(p) + x * step, int(r) + y * step
                if p > r:
                    continue
                if level:
                    stack.append((level - 1, p, r))
                elif p < r:
                    compare(p, r)
    return [(ids[i], ids[forest.root(i)]) for i in range(len(ids)) if forest.root(i) != i]


def _set_rows(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """``group, part, doc_id, known, elements`` from ``group, part, doc_id, known, text``."""
    shingles, rows, held = Shingler(words), [], 0
    names = ["group", "part", "doc_id", "known", "elements"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for *keys, text in _texts(batches, 4):
        rows.append((*keys, shingles(text).tobytes()))
        held += len(rows[-1][-1])
        if held >= 8 << 20:
            yield _flat(names, types, rows)
            rows, held = [], 0
    yield _flat(names, types, rows)


def _link_groups(batches: Iterable[pa.RecordBatch], similarity: Similarity) -> Iterator[pa.RecordBatch]:
    """Edges of each (group, part); rows come sorted by them, and one at a time is held."""
    key, ids, known, sets, edges = None, [], [], [], []
    types = [pa.int64(), pa.int64()]
    for b in batches:
        for group, part, doc_id, k, elements in zip(*(b.column(i) for i in range(5))):
            this = group.as_py(), part.as_py()
            if this != key:
                edges += link(ids, known, sets, similarity)
                key, ids, known, sets = this, [], [], []
            ids.append(doc_id.as_py())
            known.append(k.as_py())
            sets.append(np.frombuffer(elements.as_py(), dtype=np.uint64))
        if len(edges) >= 10_000:
            yield _flat(["u", "v"], types, edges)
            edges = []
    edges += link(ids, known, sets, similarity)
    yield _flat(["u", "v"], types, edges)


def _links(texts: DataFrame, members: DataFrame, rows: int, similarity: Similarity) -> DataFrame:
    """Edges inside the groups of ``members`` (``group, part, member, known``); texts are read again for their sets."""
    placed = near(texts, F.col("doc_id"), members.select("member"), rows).join(small_side(members, rows), F.col("doc_id") == F.col("member")).select(
        "group", "part", "doc_id", "known", "text")
    sets = placed.mapInArrow(lambda b: _set_rows(b, similarity.words),
                             "group long, part long, doc_id long, known long, elements binary")
    dealt = sets.repartition("group", "part").sortWithinPartitions("group", "part")
    return dealt.mapInArrow(lambda b: _link_groups(b, similarity), "u long, v long")


def near_duplicates(docs: DataFrame, similarity: Similarity = Similarity(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (smallest id reachable by links) of every row."""
    rows = docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).cast("binary").alias("text"))
    if ids_name_rows(rows, "doc_id", allow_null=True):
        return _classes(rows, similarity).select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    rows = _numbered(rows)
    classes = frozen(_classes(rows.select(F.col("number").alias("doc_id"), "text"), similarity))
    named = classes.join(rows.select(F.col("number").alias("number_"), F.col("doc_id").alias("id_")),
                         F.col("doc_id") == F.col("number_"))
    smallest = named.groupBy(F.col("root").alias("root_")).agg(F.min("id_").alias("component_id"))
    found = named.join(smallest, F.col("root") == F.col("root_")).select(F.col("id_").alias("doc_id"), "n_shingles", "component_id")
    nobody = classes.where(F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    return found.unionAll(nobody)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a ``number`` of their own, written once; NULL where ``doc_id`` is."""
    number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    return frozen(rows.withColumn("number", number))


def _classes(texts: DataFrame, similarity: Similarity) -> DataFrame:
    """``doc_id, n_shingles, root`` of rows ``doc_id, text`` whose ids do not repeat: the smallest id reachable."""
    facts = frozen(texts.mapInArrow(lambda b: _facts(b, similarity.words), FACTS))
    sizes = facts.where(F.col("element").isNull()).select("doc_id", "n", "print")
    common = _common_elements(facts, sizes.count())

    # classes of equal sets
    named = sizes.where(F.col("doc_id").isNotNull() & F.col("print").isNotNull())
    classes = named.groupBy("print").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    reps = frozen(named.select("doc_id", "print").distinct().join(classes, "print").select("doc_id", "print", "rep", "n"))
    rep_of = reps.groupBy("doc_id").agg(F.min("rep").alias("rep"))

    # candidates: components of sharing a signature
    sent = texts.mapInArrow(lambda b: _signature_rows(b, similarity, common), "signature long, doc_id long")
    lowest = F.min("doc_id").over(Window.partitionBy("signature"))
    shared = (sent.withColumn("low", lowest).where(F.col("doc_id") != F.col("low")).select("doc_id", "low").distinct())
    edges = (shared.join(rep_of.select("doc_id", F.col("rep").alias("u")), "doc_id")
             .join(rep_of.select(F.col("doc_id").alias("low"), F.col("rep").alias("v")), "low").select("u", "v"))
    groups = components(edges).select(F.col("node").alias("member"), F.col("root").alias("group"))
    weight = classes.select(F.col("rep").alias("member"), "n").groupBy("member").agg(F.max("n").alias("n"))
    members = groups.join(weight, "member")
    blocks = members.groupBy("group").agg(F.greatest(
        F.ceil(F.sum("n") / similarity.block_elements), F.ceil(F.count(F.lit(1)) / similarity.block_sets)).alias("blocks"))
    members = frozen(members.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("member"), "blocks"))
                     .select("group", "member", "blocks", "block"))
    # links: each block with itself and the first block; then, where a group is still in pieces, the rest
    others = F.sequence(F.lit(1).cast("long"), F.greatest(F.col("blocks") - 1, F.lit(1)))
    first = frozen(members.withColumn("part", F.explode(F.when(F.col("block") == 0, others).otherwise(F.array("block"))))
                   .select("group", "part", "member", F.col("member").alias("known")))
    links = frozen(_links(texts, first, first.count(), similarity))
    if members.where(F.col("blocks") > 2).limit(1).count():
        found = components(links).select(F.col("node").alias("member"), F.col("root").alias("known"))
        state = frozen(members.where(F.col("blocks") > 2).join(found, "member", "left")
                       .withColumn("known", F.coalesce("known", "member")))
        split = state.groupBy("group").agg(F.min("known").alias("a"), F.max("known").alias("b")).where("a <> b")
        rest = state.where(F.col("block") > 0).join(split.select("group"), "group")
        partner = F.filter(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("block"))
        pairs = rest.withColumn("partner", F.explode(partner)).withColumn(
            "part", F.least("block", "partner") * F.col("blocks") + F.greatest("block", "partner"))
        pairs = frozen(pairs.select("group", "part", "member", "known"))
        known = state.where(F.col("member") != F.col("known")).select(F.col("member").alias("u"), F.col("known").alias("v"))
        links = links.union(known).union(_links(texts, pairs, pairs.count(), similarity))
    roots = components(links).select(F.col("node").alias("rep"), "root")
    where = reps.join(roots, "rep", "left").select(F.col("doc_id").alias("doc_"), F.col("print").alias("print_"),
                                                   F.coalesce("root", "rep").alias("root"))
    out = sizes.join(where, (F.col("doc_id") == F.col("doc_")) & (F.col("print") == F.col("print_")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("root"))


def keep_first(docs: DataFrame, similarity: Similarity = Similarity(5, 80)) -> DataFrame:
    """One row of ``docs`` per component: that of the smallest id, and of these the smallest hash of all columns.

    Rows without an id or a text are components of their own, and all stay.
    """
    if ids_name_rows(docs, "doc_id", allow_null=True):
        found = near_duplicates(docs, similarity).where(F.col("doc_id").isNotNull())
        verdicts = frozen(found.select(F.col("doc_id").alias("id"), (F.col("component_id") == F.col("doc_id")).alias("stays")))
        return staying(docs, q("doc_id").cast("long"), verdicts)
    hashed = F.xxhash64(*[q(c).cast("string") for c in docs.columns])
    rows = _numbered(packed(docs, q("doc_id").cast("long").alias("doc_id"), hashed.alias("hash")))
    texts = rows.select(F.col("number").alias("doc_id"), F.col("row")["text"].cast("binary").alias("text"))
    classes = frozen(_classes(texts, similarity).select(F.col("doc_id").alias("number_"), "root"))
    order = F.struct("doc_id", "hash", "number")
    placed = rows.select("doc_id", "hash", "number").join(classes, F.col("number") == F.col("number_"))
    best = placed.groupBy("root").agg(F.min(order)["number"].alias("best")).select("best")
    verdicts = frozen(classes.where(F.col("number_").isNotNull()).join(best, F.col("number_") == F.col("best"), "left")
                      .select(F.col("number_").alias("id"), F.col("best").isNotNull().alias("stays")))
    return unpacked(staying(rows, F.col("number"), verdicts), docs.columns)

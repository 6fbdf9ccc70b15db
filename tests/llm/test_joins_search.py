"""Vector join, Merkle manifest and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepflow.llm import ranked_search as rs
from prepflow.llm.manifest import FIELDS, fold, leaf_digest, manifest, path_digest
from prepflow.llm.vector_join import Pivots, VectorSimilarity, near_vectors


# ------------------------------------------------------------------ vectors
def linked_rows(rows, cosine):
    """(n_links, component) per row, by all pairs."""
    def able(v, label, i):
        return (i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)
                and any(v))

    n = len(rows)
    up, links = list(range(n)), [0] * n

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            (a, v, x), (b, w, y) = rows[i], rows[j]
            if able(v, x, a) and able(w, y, b) and x == y and len(v) == len(w):
                p, s = max(map(abs, v)), max(map(abs, w))
                v, w = [c / p for c in v], [c / s for c in w]
                near = math.fsum(c * d for c, d in zip(v, w)) / math.sqrt(math.fsum(c * c for c in v) * math.fsum(d * d for d in w))
                if near >= cosine:
                    links[i] += 1
                    links[j] += 1
                    up[root(i)] = root(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[root(i)] = min(low.get(root(i), rows[i][0]), rows[i][0])
    return Counter((rows[i][0], links[i], low.get(root(i))) for i in range(n))


def vector_rows():
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for label, many in ((0, 150), (1, 60), (2, 3), (None, 10)):
        centres = rng.normal(size=(6, 8))
        for _ in range(many):
            x = centres[rng.integers(6)] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.3, 1.5])
            rows.append((i, [float(np.float32(c)) for c in x], label))
            i += 1
    rows += [rows[0], (1000, rows[0][1], 0), (1001, [c * 4 for c in rows[0][1]], 0), (rows[5][0], rows[9][1], 0),
             (None, rows[0][1], 0), (1002, None, 0), (1003, [], 0), (1004, [0.0] * 8, 0), (1005, [1.0] + [None] * 7, 0),
             (1006, [1.0] + [float("nan")] * 7, 0), (1007, [float("inf")] + [1.0] * 7, 0), (1008, [1.0, 2.0], 0),
             (1009, [1e300] * 8, 1), (1010, [1e-300] * 8, 1), (1011, [-0.0] * 7 + [1.0], 2), (1012, [0.0] * 7 + [2.0], 2)]
    random.Random(2).shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [VectorSimilarity(), VectorSimilarity(cell_nodes=16, tile_rows=7),
                                 VectorSimilarity(cosine=0.8, cell_nodes=9, tile_rows=5, most_pivots=4),
                                 VectorSimilarity(cosine=0.99, cell_nodes=8, pivot_bytes=1)])
def test_near_vectors_brute_force(spark, how):
    rows = vector_rows()
    given = spark.createDataFrame([(*r, 7, 8) for r in rows],
                                  "vec_id long, embedding array<double>, label int, node int, mark int").repartition(5)
    found = near_vectors(given, how).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in found) == linked_rows(rows, how.cosine)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_near_vectors_empty_and_float(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors(empty).collect() == []
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "a"), (3, [1.0, 0.1], "b")],
                                 "vec_id long, embedding array<float>, label string")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(rows).collect()) == [
        (1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_group_of_copies_stays_small(spark):
    """One label holds one dense group: links are counted, edges come back as a forest."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=16) + rng.normal(size=(700, 16)) * 0.01
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = near_vectors(rows, VectorSimilarity(cell_nodes=64, tile_rows=50)).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(699, 0)}


def test_reach_keeps_every_partner():
    """Whatever the pivots, a partner's cell is among those that a vector is copied to."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for cosine in (0.93, 0.5, -0.2):
        p = Pivots(x[:20], math.acos(cosine))
        home, reach = p.cells(x)
        near = x @ x.T >= cosine
        assert all(reach[i, home[j]] for i, j in zip(*np.nonzero(near)))
    assert Pivots(x[:20], math.acos(0.99)).cells(x)[1].mean() < 0.5  # and in few dimensions most cells are left out


# ------------------------------------------------------------------ manifest
def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def proof_of(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        run = level[i // fanout * fanout:(i // fanout + 1) * fanout]
        out.append((run[:i % fanout], run[i % fanout + 1:]))
        i //= fanout
    return out


def manifest_by_hand(rows, fanout):
    def digest(r):
        return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), digest(r), r))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {}
    for t in order:
        trees[t].sort(key=lambda x: x[:2])
        built[t] = levels_of([x[1] for x in trees[t]], fanout)
    top = levels_of([built[t][-1][0] for t in order], fanout)
    out = Counter()
    for k, t in enumerate(order):
        for i, (_, leaf, r) in enumerate(trees[t]):
            proof = proof_of(built[t], i, fanout) + proof_of(top, k, fanout)
            lowered = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                lowered = digest([*r[:4], None if r[4] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[4])])
            folded = lowered
            for before, after in proof:
                folded = h([*before, folded, *after])
            out[r[0], leaf, built[t][-1][0], top[-1][0], h(x for b, a in proof for x in b + a), folded] += 1
    return out


@pytest.mark.parametrize("rows,fanout,keep_every", [(200, 8, 3), (200, 2, 2), (90, 3, 1), (5, 8, 3), (1, 8, 3)])
def test_manifest_brute_force(spark, rows, fanout, keep_every):
    rng = random.Random(rows)
    given = [(rng.choice([None, *range(2 * rows)]) if rng.random() < 0.1 else i, rng.choice([None, "s", "ß"]),
              rng.choice([None, "en", "en", "en", "de", "ü"]), rng.choice([None, i]),
              rng.choice([None, "", "Straße ABC", "x" * 3000, "Q"])) for i in range(rows)]
    given += given[:3] if rows > 10 else []
    df = spark.createDataFrame([(*g, 1, 2, 3) for g in given],
                               "doc_id long, source string, lang string, n_chars long, text string, tree int, key int, node int")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = leaf_digest([F.lower(c) if c == "text" else F.col(c) for c in FIELDS])
    proved = manifest(df.repartition(4), fanout=fanout, keep_every=keep_every, payload={"tampered": F.when(hit, lowered)})
    found = proved.select("key", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof"),
                          fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded")).collect()
    assert Counter(map(tuple, found)) == manifest_by_hand(given, fanout)


def test_manifest_empty(spark):
    assert manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).count() == 0


# ------------------------------------------------------------------ ranked search
def ranked_by_hand(docs, items, k):
    find = lambda t: [w.translate(LOWER) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    LOWER = {c: c + 32 for c in range(65, 91)}
    held = [(i, find(t)) for i, t in docs]
    held = [(i, w, Counter(w)) for i, w in held if w]
    total, df = sum(len(w) for _, w, _ in held), Counter(t for _, _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * len(held) + 2) / (2 * n + 1))) for t, n in df.items()}
    out = Counter()
    for item, text in items:
        scores = []
        for i, w, tf in held:
            m = 75 + 25 * len(w) * len(held) // total
            s = sum(weight[t] * (10 ** 9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in find(text) if t in tf)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, i, -s] += 1
    return out


@pytest.mark.parametrize("how", [rs.Search(), rs.Search(k=3, block_items=2, tile_items=1, tile_cells=64, tile_columns=2),
                                 rs.Search(k=1, block_terms=3, tile_documents=16)])
def test_ranked_search_brute_force(spark, odd_documents, odd_texts, how):
    items = [(i, odd_texts[j]) for i, j in enumerate((0, 1, 3, 7, 20, 21, 22, 40, 41, 60))]
    items += [(3, "the the the MIT Straße"), (None, "license"), (77, "no such terms zzz"), (78, "THE " * 5000)]
    given = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, item int").repartition(2)
    found = rs.ranked_search(odd_documents, given, how).collect()
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in found) == ranked_by_hand(docs, items, how.k)


def test_ranked_search_empty(spark, odd_documents):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert rs.ranked_search(odd_documents.limit(0), items).collect() == []
    assert rs.ranked_search(odd_documents, items.limit(0)).collect() == []


def test_products_stay_below_the_bound():
    """Counts beyond the bound are spread over columns, and no product can pass 2^53."""
    search, block = rs.Search(tile_items=2), rs.Block()
    block.add(1, b"a b c")
    block.items.append((2, Counter({0: 10 ** 6, 1: 3})))
    weights = {0: 25_000, 1: 1, 2: 9000}
    (tile,) = rs.tiles(block, weights, search)
    assert len(tile.parts) > 1 and sum(tile.counts[1][tile.columns == 0]) == 10 ** 6
    for part in tile.parts:
        assert max(tile.counts[:, part] @ tile.weights[part] * search.largest_impact) < rs.EXACT


def test_long_text_is_cut_at_separators(monkeypatch):
    text = ("Wörter und " * 50 + "z" * 300 + ", end").encode()
    whole = [w for part in rs.terms(text) for w in part]
    monkeypatch.setattr(rs, "STRETCH", 16)
    assert [w for part in rs.terms(text) for w in part] == whole and len(whole) == 102

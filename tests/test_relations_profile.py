"""Rule mining (R1-R3) against brute force; profile reports (Q1-Q5)."""

from itertools import combinations, product

from pyspark.sql import functions as F

from prepflow.operators import profile as prof
from prepflow.operators import relations as rel

ROWS = [("a", "x", 1), ("a", "y", 1), ("b", "x", 2), ("c", None, 2), (None, "z", 3), ("c", "z", 3)]
SCHEMA = "p string, q string, r int"


def brute_exclusions(rows, cols):
    out = set()
    for i, j in combinations(range(len(cols)), 2):
        both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        da, db = {a for a, _ in both}, {b for _, b in both}
        for a, b in product(da, db):
            if (a, b) not in both:
                out.add((cols[i], str(a), cols[j], str(b)))
    return out


def test_exclusion_rules_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {tuple(r) for r in rel.exclusion_rules(df, ["p", "q", "r"]).collect()}
    assert got == brute_exclusions(ROWS, ["p", "q", "r"])


def test_cohesion(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "c"), (4, None), (4, "d")],
                               "g int, t string")
    r = rel.cohesion(df, [("g", "t")]).first()
    assert (r["n_groups"], r["n_pure"]) == (2, 1) and r["pct_pure"] == 50.0


def test_profile_reports(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, "y"), (3, 4.0, None)], "a int, b double, c string")
    nc = {r["column"]: (r["n_missing"], r["n_non_missing"]) for r in prof.null_counts(df).collect()}
    assert nc == {"a": (1, 2), "b": (2, 1), "c": (1, 2)}
    per_row = {r["n_missing"]: r["n_rows"] for r in prof.missing_per_row(df).collect()}
    assert per_row == {1: 2, 2: 1}
    combos = {r["missing_columns"]: r["n_rows"] for r in prof.missing_combinations(df).collect()}
    assert combos == {"b": 1, "a | b": 1, "c": 1}
    pairs = {(r["column_a"], r["column_b"]): r["both_missing"] for r in prof.co_missing(df).collect()}
    assert pairs[("a", "b")] and not pairs[("a", "c")]
    ov = {r["feature"]: r["unique_non_null_values"] for r in prof.column_overview(df).collect()}
    assert ov == {"a": 2, "b": 1, "c": 2}


def test_spending_checks(spark):
    df = spark.createDataFrame([(True, 0.0, None, 30.0), (True, 10.0, 0.0, 8.0), (False, 5.0, 5.0, 10.0)],
                               "cryo boolean, a double, b double, age double")
    r = rel.spending_checks(df, ["a", "b"], F.col("cryo"), F.col("age") < 13).first()
    assert r["mean_spend_flagged"] == 5.0 and r["flagged_spend_violation"]
    assert r["mean_spend_children"] == 10.0


def test_reports_of_many_columns_share_one_table(spark):
    """More columns than one word of a mask has bits; every report against a count by hand."""
    import random
    rng = random.Random(3)
    names = [f"c{i}" for i in range(130)]
    rows = [tuple(None if rng.random() < (0.5 if i in (0, 61, 62, 129) else 0.01) else i for i in range(130)) for _ in range(150)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names)).repartition(4)
    m = prof.null_masks(df, keep=True)
    missing = [{c for c, v in zip(names, r) if v is None} for r in rows]
    assert {r["column"]: r["n_missing"] for r in prof.null_counts(m).collect()} == {c: sum(c in x for x in missing) for c in names}
    per_row = {r["n_missing"]: r["n_rows"] for r in prof.missing_per_row(m).collect()}
    assert per_row == {k: sum(len(x) == k for x in missing) for k in {len(x) for x in missing}}
    combos = {r["missing_columns"]: r["n_rows"] for r in prof.missing_combinations(m).collect()}
    assert sum(combos.values()) == 150 and all(
        n == sum(x == set(label.split(" | ")) - {prof.NO_MISSING_LABEL} for x in missing) for label, n in combos.items())
    pairs = {(r["column_a"], r["column_b"]): r["both_missing"] for r in prof.co_missing(m).collect()}
    assert pairs == {(a, b): any(a in x and b in x for x in missing) for a in names for b in names}


def test_summary_reads_once_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, None), (None, None)], "a int, b int").write.parquet(str(tmp_path / "t"))
    parts = prof.summary(spark.read.parquet(str(tmp_path / "t")))
    assert all("FileScan" not in d._jdf.queryExecution().executedPlan().toString() for d in parts.values())
    assert parts["top_combinations"].first()["missing_columns"] in ("b", "a | b")
    empty = prof.summary(spark.createDataFrame([], "a int, b int"))
    assert empty["shape"].first()["n_rows"] == 0 and empty["missing_per_row"].collect() == []
    assert {r["n_missing"] for r in empty["missing_per_column"].collect()} == {0}


def test_distinct_counts_without_expand_and_merged_sketches(spark):
    df = spark.range(40_000).select(F.col("id").alias("a"), (F.col("id") % 300).cast("string").alias("b"),
                                    F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(1.5).alias("c"))
    overview = prof.column_overview(df)
    assert "Expand" not in overview._jdf.queryExecution().executedPlan().toString()
    assert {r["feature"]: r["unique_non_null_values"] for r in overview.collect()} == {"a": 40_000, "b": 300, "c": 1}
    stored = prof.distinct_sketches(df.where("id < 25000"), F.lit("first"))  # an earlier run
    later = prof.distinct_sketches(df.where("id >= 20000"), F.lit("second"))  # overlaps it
    merged = {r["column"]: r for r in prof.merged_sketches(stored.unionByName(later)).collect()}
    assert abs(merged["a"]["n_distinct"] - 40_000) <= prof.sketch_error() * 40_000
    assert (merged["b"]["n_distinct"], merged["c"]["n_distinct"], merged["c"]["n_missing"]) == (300, 1, 22_500)


def test_exclusion_rules_of_large_domains(spark):
    """Domains beyond a chunk, on either side."""
    n = 5000
    df = spark.range(n).select(F.col("id").cast("string").alias("a"), (F.col("id") % 4).cast("string").alias("b"))
    for cols in (["a", "b"], ["b", "a"]):
        got = rel.exclusion_rules(df, cols, chunk=300)
        assert got.count() == 3 * n and got.distinct().count() == 3 * n
        seen = df.select(*[F.col(c).alias(f"value_{x}") for c, x in zip(cols, "ab")])
        assert got.join(seen, ["value_a", "value_b"], "left_semi").count() == 0

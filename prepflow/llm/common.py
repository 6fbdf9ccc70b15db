"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import ensure_checkpoint_dir

#: A word: a run of characters other than space, tab, LF, VT, FF and CR (same text for Java, RE2 and Python).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: Above this many rows a table is no longer broadcast but joined by a shuffle.
BROADCAST_ROWS = 400_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def frozen(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: lineage is cut, and lost executors do not lose rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(q(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words (long); NULL text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_side(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when its counted rows are within ``bound``; beyond it joins shuffle."""
    return F.broadcast(df) if rows <= bound else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ids_name_rows(df: DataFrame, id_col: str, allow_null: bool = False) -> bool:
    """Whether each id stands for one row (reads the ids alone); NULL ids do not, unless allowed."""
    ids = df.select(q(id_col).alias("id"))
    many = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(
        F.when(F.col("id").isNull(), F.lit(not allow_null)).otherwise(F.col("n") > 1))
    return many.limit(1).count() == 0


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """``df`` as one column ``row``, so that names made on the way cannot clash with its columns."""
    return df.select(F.struct(*[q(c) for c in df.columns]).alias("row"), *more)


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``row`` again, some of them changed."""
    return df.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often (or in whatever lambda) it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


PREFIX_BLOCK = 512


def prefixes(values: Column, zero: int, combine) -> Column:
    """Per element of an array of longs, ``combine`` over all elements before it, from ``zero``.

    Done in blocks: appending to an array copies it, so one running aggregate over n
    elements would take n^2 steps.
    """
    start_at = F.lit(zero).cast("long")
    empty = F.array().cast("array<bigint>")

    def running(array: Column, start: Column) -> Column:
        return F.aggregate(array, F.struct(start.alias("at"), empty.alias("out")), lambda acc, x: F.struct(
            combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def of_blocks(blocks: Column) -> Column:
        starts = running(F.transform(blocks, lambda b: F.aggregate(b, start_at, lambda x, y: combine(x, y))), start_at)
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: running(b, s)))

    def whole(array: Column) -> Column:
        last = F.floor((F.size(array) - 1) / PREFIX_BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(array, i * PREFIX_BLOCK + 1, PREFIX_BLOCK))
        return F.when(F.size(array) > 0, let(blocks, of_blocks)).otherwise(empty)

    return let(values, whole)


class Recent(dict):
    """Values made by ``make`` for the keys seen last: two generations of at most ``size`` keys."""

    def __init__(self, make, size: int = 250_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

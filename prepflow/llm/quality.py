"""Quality rules with cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space to one space, numbers to 0 unless
digits are half of the line, as in tables and logs) and hashed; per host (the ``source`` column) the distinct documents with each
line are counted, copies of a text counting once (and with ``alike_percent``
below 100 near copies, too, so a family of them is not its own boilerplate).  Lines in more than
``max(min_documents, share * documents of the host)`` are boilerplate.  A
document that keeps less than ``min_left`` of its words, or fewer than
``min_words`` of them, without its boilerplate is depleted and rejected, as is
one that fails the rules on its own text: too few words, or too many words in
five-word windows that occur again in the text.  ``cleaned`` gives the kept rows
with the boilerplate lines taken out of their texts.

All is DataFrame expressions.  Counting shuffles one narrow row per distinct line
of a document, combined before the shuffle, so a line in a third of all documents
is one row per task.  Only lines above the limit go back to the documents.

Defined results: NULL or empty text has no words and is rejected; NULL ``source``
is a host of its own; NULL ``doc_id`` passes through; repeated rows get equal
results each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from .common import BROADCAST_ROWS, SPACES, WORD, frozen, packed, small_side, text_or_empty, unpacked
from .components import components

SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    window: int = 5
    min_words: int = 10
    max_repeat_percent: int = 20  # of words in repeated windows
    min_documents: int = 20  # a line in no more documents of a host is never boilerplate
    share: float = 0.01  # of the host's distinct documents
    min_left: float = 0.2  # of the words, without boilerplate lines
    alike_percent: int = 100  # texts with so many of their windows in common count once per line; 100: equal texts


BINS, BIN_SHIFT, BAND = 64, 58, 4


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    inner = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(inner) > 0, F.split(inner, SPACES)).otherwise(F.array().cast("array<string>"))


def text_measures(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` (with ``text`` and any other columns kept) plus the measures of each text on its own."""
    k = rules.window
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("words", words_of(text))
    hashes = F.transform(F.sequence(F.lit(1), F.size("words") - (k - 1)),
                         lambda i: F.xxhash64(F.slice("words", i, k)))
    d = d.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "windows": F.when(F.size("words") >= k, hashes).otherwise(F.array().cast("array<long>")),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
    }).drop("words")
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    # windows that occur again: sorted by hash, equal neighbours; then the words that their positions cover
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("sorted", F.when(again, F.sort_array(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    near = lambda j: F.get("sorted", j)["h"]
    repeated = F.filter("sorted", lambda s, j: F.coalesce(s["h"] == near(j - 1), F.lit(False))
                        | F.coalesce(s["h"] == near(j + 1), F.lit(False)))
    d = d.withColumn("starts", F.sort_array(F.transform(repeated, lambda s: s["i"]))).drop("sorted")
    covered = F.aggregate(
        "starts", F.struct(F.lit(-k).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(k), p - acc["last"])).alias("n")),
        lambda acc: acc["n"])
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line with a word: ``doc_id, source, content`` (hash of the text), ``place, line`` (hash), ``words``."""
    lines = docs.select("doc_id", "source", F.xxhash64("text").alias("content"),
                        F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    digits = F.length("raw") - F.length(F.translate("raw", "0123456789", ""))
    numbers = digits * 2 >= F.length(F.regexp_replace("raw", SPACES, ""))
    words = F.when(numbers, F.col("raw")).otherwise(F.regexp_replace("raw", "[0-9]+", "0"))
    plain = F.translate(F.btrim(F.regexp_replace(words, SPACES, " ")),
                        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (lines.withColumn("words", F.regexp_count("raw", F.lit(WORD))).where(F.col("words") > 0)
            .select("doc_id", "source", "content", "place", F.xxhash64(plain).alias("line"), "words"))


def boilerplate_lines(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(``source``, ``line``, ``limit``) of lines in more distinct texts than the host's limit."""
    lines = lines_of(docs).select("source", "line", "content").distinct()
    counts = lines.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))
    hosts = (docs.select(F.col("source").alias("host"), F.xxhash64("text").alias("content")).distinct()
             .groupBy("host").agg(F.greatest(F.lit(float(rules.min_documents)),
                                             F.count(F.lit(1)) * F.lit(rules.share)).alias("limit")))
    counts = counts.where(F.col("n") > rules.min_documents)
    return (counts.join(hosts, F.col("source").eqNullSafe(F.col("host"))).where(F.col("n") > F.col("limit"))
            .select("source", "line", "limit"))


def _sketches(rows: DataFrame, rules: Rules) -> DataFrame:
    """``content`` and ``sketch`` of every row: the smallest window hash in each of ``BINS`` ranges of hashes.

    Windows are of lower-case words; a text shorter than one is one window.
    """
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    d = rows.withColumn("words", words_of(plain))
    d = d.withColumn("hashes", F.sort_array(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("words") - (rules.window - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice("words", i, rules.window)))))
    bin_of = lambda x: F.shiftright(x, BIN_SHIFT)
    first = F.filter("hashes", lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get("hashes", i - 1))))
    return d.select(F.xxhash64("text").alias("content"), first.alias("sketch"))


def _families(rows: DataFrame, contents: DataFrame, rules: Rules) -> DataFrame:
    """(``node``, ``root``): texts among ``contents`` alike in ``alike_percent`` of their windows, linked in chains.

    Sketches with an equal band of bins are compared with one of them, chosen anew
    for each band; the share of equal bins estimates the share of common windows.
    """
    n = contents.count()
    named = contents.withColumnRenamed("content", "content_")
    if n <= BROADCAST_ROWS:  # only their texts are read; else sketches of all texts are shuffled, not the texts
        rows = rows.join(F.broadcast(named), F.xxhash64("text") == F.col("content_"), "left_semi")
        own = _sketches(rows, rules)
    else:
        own = _sketches(rows, rules).join(named, F.col("content") == F.col("content_"), "left_semi")
    own = frozen(own.dropDuplicates(["content"]))
    band_of = lambda x: F.shiftright(x, BIN_SHIFT + 2)
    bands = F.filter(F.transform(
        F.sequence(F.lit(-BINS // BAND // 2).cast("long"), F.lit(BINS // BAND // 2 - 1).cast("long")),
        lambda b: F.filter("sketch", lambda x: band_of(x) == b)), lambda x: F.size(x) > 0)
    sent = own.select("content", F.explode(bands).alias("band")).select("content", F.xxhash64("band").alias("band"))
    heads = (sent.groupBy(F.col("band").alias("band_"))
             .agg(F.min_by("content", F.xxhash64("content", "band")).alias("head"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("band_", "head"))
    pairs = (sent.join(heads, F.col("band") == F.col("band_")).where(F.col("content") != F.col("head"))
             .select(F.least("content", "head").alias("u"), F.greatest("content", "head").alias("v")).distinct())
    a = own.select(F.col("content").alias("u"), F.col("sketch").alias("a"))
    b = own.select(F.col("content").alias("v"), F.col("sketch").alias("b"))
    bins = lambda x: F.transform(x, lambda h: F.shiftright(h, BIN_SHIFT))
    alike = (F.size(F.array_intersect("a", "b")) * 100
             >= F.size(F.array_union(bins("a"), bins("b"))) * rules.alike_percent)
    return components(pairs.join(a, "u").join(b, "v").where(alike).select("u", "v"))


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """Measures and verdict of every document, one row per input row.

    Columns: ``doc_id``, ``content`` (a hash of the text), ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``n_boilerplate`` (words in boilerplate lines), ``base_failed``, ``kept``.
    """
    rows = docs.select(q(id_col).cast("long").alias("doc_id"), q(source_col).alias("source"),
                       text_or_empty(text_col).alias("text"))
    return _judged(rows, rules).select(
        "doc_id", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate",
        "base_failed", "kept")


def _frequent_hits(rows: DataFrame, rules: Rules) -> DataFrame:
    """The lines of documents that are boilerplate: ``doc_id, source, content, place, line, words``, each place once."""
    frequent = frozen(boilerplate_lines(rows, rules))
    frequent = small_side(frequent, frequent.count()).withColumnsRenamed({"source": "host", "line": "line_"})
    on = F.col("source").eqNullSafe(F.col("host")) & (F.col("line") == F.col("line_"))
    # repeated rows of a document list the same places
    hit = (lines_of(rows).join(frequent, on).select("doc_id", "source", "content", "place", "line", "words", "limit")
           .distinct())
    if rules.alike_percent >= 100:
        return hit.drop("limit")
    hit = frozen(hit)
    families = _families(rows, hit.select("content").distinct(), rules)
    counted = (hit.select("source", "line", "limit", "content").distinct()
               .join(families, F.col("content") == F.col("node"), "left")
               .select("source", "line", "limit", F.coalesce("root", "content").alias("one")).distinct()
               .groupBy("source", "line", "limit").agg(F.count(F.lit(1)).alias("n")))
    still = frozen(counted.where(F.col("n") > F.col("limit")).select(F.col("source").alias("host"),
                                                                     F.col("line").alias("line_")))
    return hit.drop("limit").join(small_side(still, still.count()), on, "left_semi")


def _judged(rows: DataFrame, rules: Rules) -> DataFrame:
    """``judge`` with ``source`` and ``places`` (of boilerplate lines, NULL without any), from ``doc_id, source, text``."""
    lost = (_frequent_hits(rows, rules).groupBy("doc_id", "source", "content")
            .agg(F.sum("words").alias("n_boilerplate"), F.collect_set("place").alias("places"))
            .withColumnsRenamed({"doc_id": "doc_", "source": "source_", "content": "content_"}))
    measured = text_measures(rows.withColumn("content", F.xxhash64("text")), rules).drop("text")
    joined = measured.join(lost, F.col("doc_id").eqNullSafe(F.col("doc_")) & (F.col("content") == F.col("content_"))
                           & F.col("source").eqNullSafe(F.col("source_")), "left")
    failed = ((F.col("n_words") < rules.min_words)
              | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent))
    left = F.col("n_words") - F.col("n_boilerplate")
    depleted = (left < rules.min_words) | (left < F.col("n_words") * F.lit(rules.min_left))
    return joined.withColumn("n_boilerplate", F.coalesce("n_boilerplate", F.lit(0)).cast("long")).select(
        "doc_id", "source", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_boilerplate", "places", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` (``doc_id``, ``text``, ``source`` and other columns) whose documents are kept."""
    # rows of one doc_id and text may be judged differently by source: a row stays if any is kept
    bad = (judge(docs, rules).groupBy(F.col("doc_id").alias("id_"), F.col("content").alias("content_"))
           .agg(F.max("kept").alias("any_")).where(~F.col("any_")).select("id_", "content_"))
    bad = frozen(bad)
    on = docs["doc_id"].eqNullSafe(bad["id_"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["content_"])
    return docs.join(small_side(bad, bad.count()), on, "left_anti")


def cleaned(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept rows of ``docs``, their ``text`` without its boilerplate lines and ``n_chars`` (if there) renewed.

    Every row is judged with its own source.  Texts without boilerplate stay as they are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", text_or_empty("text").alias("text"))
    changed = (_judged(rows, rules).where(~F.col("kept") | F.col("places").isNotNull())
               .select(F.col("doc_id").alias("id_"), F.col("source").alias("source_"), F.col("content").alias("content_"),
                       F.col("kept").alias("kept_"), F.when(F.col("kept"), F.col("places")).alias("places_"))
               .dropDuplicates(["id_", "source_", "content_"]))
    changed = frozen(changed)
    weight = changed.agg(F.sum(1 + F.greatest(F.size("places_"), F.lit(0)))).first()[0] or 0
    d = packed(docs, F.col("doc_id").cast("long").alias("id"), F.col("source").alias("host"), text_or_empty("text").alias("text"))
    on = (F.col("id").eqNullSafe(F.col("id_")) & F.col("host").eqNullSafe(F.col("source_"))
          & (F.xxhash64("text") == F.col("content_")))
    d = d.join(small_side(changed, weight), on, "left").where(F.coalesce("kept_", F.lit(True)))
    cut = F.col("places_").isNotNull()
    d = d.withColumn("lines", F.when(cut, F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places_"))
    d = d.withColumn("rest", F.when(cut, F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")))
    new = {"text": F.when(cut, F.col("rest")).otherwise(F.col("row")["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("rest").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return unpacked(d, docs.columns, **new)

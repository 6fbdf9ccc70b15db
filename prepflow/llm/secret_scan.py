"""Secret scans: fixed forms, and character Markov models of random strings and ordinary identifiers.

The fixed forms are assignments to secret names, access keys and long hex runs.
Beyond them, a string of ``least_length`` or more key characters that holds both
letters and digits (``Training`` has both rules) is a ``random`` secret when its mean log-likelihood ratio per character step, between a first-order
Markov model of random strings and one of ordinary identifiers, is above a threshold.

The models are trained on labelled samples: random strings are digests of the
numbers below ``samples``, in hex and base64; ordinary ones are the words of the
``sample_documents`` documents with the smallest hashed ids, alone and joined the
ways identifiers are joined.  Both bounds are parameters; the result is one
number per pair of characters of a fixed alphabet.

Positions come from the text between matches: a match starts after all text
between and all matches before it, by running sums that do not grow with the square
of the number of matches.  All is DataFrame expressions.

Defined results: NULL text counts as empty and has no spans; positions are code
points, end exclusive; texts and strings of any length are scanned whole; spans that
start together go by kind as listed; repeated rows are scanned each; an empty table gives no
rows (models are then trained on random strings alone); other columns are
ignored by the scan and kept by ``redact``.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from .common import SPACES, let, packed, prefixes, text_or_empty, unpacked

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"
MARK = "[secret]"

#: The forms of the base kinds, in the order in which they are listed.
ASSIGN = (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run of hex digits is taken whole; shorter ones fail
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")


@dataclass(frozen=True)
class Training:
    samples: int = 4096
    sample_documents: int = 2000
    smoothing: float = 0.5
    threshold: float = 1.5  # mean log-likelihood ratio (nats) per character step
    least_length: int = 20  # of a string to be judged
    holds: tuple[str, ...] = ("[0-9]", "[A-Za-z]")  # patterns it must contain: rules of one sign are no secrets

    @property
    def random(self) -> str:
        """Strings to be judged."""
        return rf"[A-Za-z0-9+/_=-]{{{self.least_length},}}"


def _steps(strings: DataFrame, kind: str) -> DataFrame:
    """Counts of neighbouring characters of the strings in column ``s``."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substr("s", i, F.lit(2)))
    return (strings.where(F.length("s") >= 2).select(F.explode(pairs).alias("pair"))
            .groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind)))


def random_strings(spark, samples: int) -> DataFrame:
    digest = F.sha2(F.col("id").cast("string"), 256)
    raw = F.base64(F.unhex(digest))
    return spark.range(samples).select(F.explode(F.array(
        F.substr(digest, F.lit(1), F.lit(40)), F.substr(raw, F.lit(1), F.lit(40)),
        F.translate(F.substr(raw, F.lit(1), F.lit(40)), "+/", "-_"), F.upper(F.substr(raw, F.lit(1), F.lit(20)))))
        .alias("s"))


def ordinary_strings(docs: DataFrame, sample_documents: int) -> DataFrame:
    """Words of the sampled documents, alone and joined: snake case, camel case, with a number."""
    rank = F.xxhash64(F.col("doc_id"))
    last = docs.select(rank.alias("r")).orderBy("r").limit(sample_documents).agg(F.max("r")).first()[0]
    words = F.filter(F.split("text", SPACES), lambda w: w.rlike("^[A-Za-z]{2,}$"))
    w = docs.where(rank <= F.lit(last)).select(words.alias("w")).where(F.size("w") >= 2)
    joined = F.transform("w", lambda x, i: F.element_at(F.array(
        x, F.concat(x, F.lit("_"), F.coalesce(F.get("w", i + 1), F.lit("id"))),
        F.concat(x, F.initcap(F.coalesce(F.get("w", i + 1), F.lit("id")))),
        F.concat(x, (i % 100).cast("string")), F.concat(x, F.lit("-"), (i % 100).cast("string"))), i % 5 + 1))
    return w.select(F.explode(joined).alias("s"))


def train(docs: DataFrame, training: Training = Training()) -> list[float]:
    """Log-likelihood ratios, random over ordinary, by (first, second) character of ``ALPHABET``."""
    counts = (_steps(random_strings(docs.sparkSession, training.samples), "random")
              .unionByName(_steps(ordinary_strings(docs, training.sample_documents), "ordinary")))
    known = set(ALPHABET)
    table: dict[tuple[str, str], float] = {}
    total: dict[tuple[str, str], float] = {}
    # at most two rows per pair of characters of the alphabet
    letters = F.col("pair").rlike(r"^[A-Za-z0-9+/_=.-]{2}$")
    for r in counts.where(letters).collect():
        if set(r["pair"]) <= known:
            table[r["kind"], r["pair"]] = r["n"]
            total[r["kind"], r["pair"][0]] = total.get((r["kind"], r["pair"][0]), 0) + r["n"]
    a = training.smoothing

    def log_p(kind: str, x: str, y: str) -> float:
        return math.log((table.get((kind, x + y), 0) + a) / (total.get((kind, x), 0) + a * len(ALPHABET)))

    return [log_p("random", x, y) - log_p("ordinary", x, y) for x in ALPHABET for y in ALPHABET]


def mean_ratio(s: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio per character step of a string over ``ALPHABET``."""
    table = F.split(F.lit(",".join(f"{x:.3f}" for x in ratios)), ",").cast("array<double>")
    letters = F.transform(F.split(s, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    total = let(letters, lambda x: F.aggregate(
        F.zip_with(x, F.slice(x, 2, F.size(x)), lambda a, b: F.coalesce(F.get(table, a * len(ALPHABET) + b), F.lit(0.0))),
        F.lit(0.0), lambda acc, y: acc + y))
    return total / (F.length(s) - 1)


SPAN = "struct<start:long,rank:int,end:long,kind:string,value:string>"


def _matches(text: Column, kind: str, pattern: str, value_group: int, good) -> Column:
    """Spans of the leftmost non-overlapping matches whose value is ``good``; NULL where the text has none."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    parts = F.slice(F.arrays_zip(F.split(text, pattern, -1).alias("before"), whole.alias("whole"),
                                 value.alias("value")), F.lit(1), F.size(whole))
    rank = KINDS.index(kind)

    def placed(found: Column) -> Column:
        at = prefixes(F.transform(found, lambda x: (F.length(x["before"]) + F.length(x["whole"])).cast("long")), 0, lambda a, b: a + b)
        return F.zip_with(found, at, lambda x, a: F.struct(
            (a + F.length(x["before"])).cast("long").alias("start"), F.lit(rank).alias("rank"),
            (a + F.length(x["before"]) + F.length(x["whole"])).cast("long").alias("end"), F.lit(kind).alias("kind"),
            x["value"].alias("value")))

    return F.filter(let(parts, placed), lambda m: good(m["value"]))


def _free(spans: Column) -> Column:
    """Of sorted spans, per span whether no base span overlaps it (for ``random`` spans)."""
    base = lambda m: m["rank"] < len(BASE_KINDS)
    before = prefixes(F.transform(spans, lambda m: F.when(base(m), m["end"]).otherwise(F.lit(-1)).cast("long")), -1, lambda a, b: F.greatest(a, b))
    far = (1 << 62)
    starts = F.reverse(F.transform(spans, lambda m: F.when(base(m), m["start"]).otherwise(F.lit(far)).cast("long")))
    after = F.reverse(prefixes(starts, far, lambda a, b: F.least(a, b)))
    return F.zip_with(F.zip_with(spans, before, lambda m, x: F.struct(m["start"].alias("start"), m["end"].alias("end"), x.alias("x"))),
                      after, lambda m, y: (m["x"] <= m["start"]) & (y >= m["end"]))


def with_spans(rows: DataFrame, ratios: list[float], training: Training) -> DataFrame:
    """``rows`` (with ``text``) plus ``spans`` (start, rank, end, kind), by start, then kind as listed."""
    none = F.array().cast(f"array<{SPAN}>")
    either = lambda test, found: F.when(test, found).otherwise(none)
    t = F.col("text")
    d = rows.withColumns({
        "found_assign": either(t.rlike(ASSIGN), _matches(t, "assign", ASSIGN, 2, lambda v: F.length(v) >= 6)),
        "found_access": either(t.contains("AKIA"), _matches(t, "access", ACCESS, 0, lambda v: F.length(v) >= 20)),
        "found_hex": either(t.rlike(HEX), _matches(t, "hex", HEX, 0, lambda v: F.lit(True))),
        "found_random": either(t.rlike(training.random), _matches(
            t, "random", training.random, 0, lambda v: functools.reduce(
                lambda a, b: a & b, [v.rlike(x) for x in training.holds], F.lit(True))
            & (mean_ratio(v, ratios) > F.lit(training.threshold)))),
    })
    d = d.withColumn("found", F.sort_array(F.concat("found_assign", "found_access", "found_hex", "found_random")))
    some = (F.size("found_random") > 0) & (F.size("found") > F.size("found_random"))
    free = F.when(some, let(F.col("found"), _free)).otherwise(F.transform("found", lambda m: F.lit(True)))
    kept = F.filter(F.zip_with("found", free, lambda m, ok: F.struct(m.alias("m"), ok.alias("ok"))),
                    lambda x: x["ok"] | (x["m"]["rank"] < len(BASE_KINDS)))
    spans = F.transform(kept, lambda x: F.struct(
        x["m"]["start"].alias("start"), x["m"]["rank"].alias("rank"), x["m"]["end"].alias("end"), x["m"]["kind"].alias("kind")))
    return d.withColumn("spans", spans).select(*rows.columns, "spans")


def find_secrets(docs: DataFrame, training: Training = Training(), ratios: list[float] | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (start, rank, end, kind) of every text, one row per input row.

    ``ratios`` takes a table trained before; without it, one is trained on ``docs``.
    """
    rows = docs.select(q(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ratios = train(rows, training) if ratios is None else ratios
    return with_spans(rows, ratios, training).select("doc_id", "spans")


def redact(docs: DataFrame, training: Training = Training(), ratios: list[float] | None = None) -> DataFrame:
    """``docs`` with each stretch of secrets in ``text`` replaced by a mark and ``n_chars`` (if there) renewed."""
    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    ratios = train(rows, training) if ratios is None else ratios
    d = with_spans(packed(docs, text_or_empty("text").alias("text")), ratios, training)
    hit = F.size("spans") > 0

    def masked(x: Column) -> Column:
        cut = lambda a, b: F.array_join(F.slice(x["chars"], (a + 1).cast("int"), (b - a).cast("int")), "")
        pieces = F.zip_with(x["spans"], x["upto"], lambda m, end: F.when(
            m["start"] >= end, F.concat(cut(end, m["start"]), F.lit(MARK))).otherwise(F.lit("")))
        last = F.array_max(F.transform(x["spans"], lambda m: m["end"]))
        return F.concat(F.array_join(pieces, ""), cut(last, F.size(x["chars"]).cast("long")))

    upto = prefixes(F.transform("spans", lambda m: m["end"]), 0, lambda a, b: F.greatest(a, b))  # where masked stretches end
    d = d.withColumn("masked", F.when(hit, let(
        F.struct(F.split("text", "").alias("chars"), F.col("spans").alias("spans"), upto.alias("upto")), masked)))
    changed = {"text": F.coalesce("masked", F.col("row")["text"])}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return unpacked(d, docs.columns, **changed)

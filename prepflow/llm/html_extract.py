"""Main text of web pages by equivalence-class template deduction.

Tokens are tags and words.  A container opening is a token by its path of open
containers, the first, second and so on of a path told apart; a word is one by the
path of its block.  Per host, tokens that occur in the same pages, equally often,
form an equivalence class: their occurrence vectors are compared by page count, total
and two sums of page hashes.  A class is valid if it occurs in enough of the host's
pages and holds an opening; its words then come with that piece of the frame.  Paths
nest the classes: the openings of valid classes are the template's regions, each
inside the region of the nearest open container that is in the template.

What is left are slots.  A block all of whose words are the template's is no slot.  A
slot's place decides what it is: the regions that hold at least ``main_part`` of the
host's words that are not frequent lie inside each other; the innermost is the main
region.  Slots in it, or directly in a region around it, are main text; slots of regions
beside it (menus, adverts, footers) are not.  A page without any main slot keeps all.

Names add to this: slots inside navigation, notices, adverts, forms, comments and the
like, by element or by the words of class, id and role, are no main text; if the page has
an ``article`` or ``main`` element, only slots inside it are, wherever the regions lie.
``names=False`` leaves all to the template.

A token in half of a host's pages is in half of its pages in some group of pages, so
tasks first send the tokens frequent in their own pages, with a bound of what they keep
back; only tokens that can still be frequent are then counted, exactly, over all pages.
A host's template has at most as many tokens as its pages share, whatever the number of
pages; it goes to the pages by broadcast when small, otherwise by a join salted by page.

Defined results: NULL or empty html gives an empty text; a URL that is NULL or
has no host gets no template; repeated rows are extracted each; long texts are read
whole; a tie of regions cannot be, as two that hold more than half of the words are
nested; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from .common import frozen, small_side

TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
CONTAINERS = frozenset("html head body article main section div nav header footer aside form ul ol dl table thead tbody "
                       "tfoot tr figure blockquote details dialog menu button select svg fieldset center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption caption summary legend option "
                                "optgroup".split())
APART = frozenset("head nav footer aside form dialog menu button select svg fieldset".split())
MAIN = frozenset(("article", "main"))
NOT_MAIN = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies "
                     "consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription "
                     "share sharing social related recommended recommendations sidebar aside menu nav navbar navigation "
                     "breadcrumb breadcrumbs pagination pager comment comments reply replies disqus login signup search "
                     "toolbar widget footer copyright contentinfo complementary alert".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())

# what a tag does; a name that is not here does nothing
SPACE, SKIPS, NESTS, BREAKS = range(4)
DOES = (dict.fromkeys(BLOCKS, BREAKS) | dict.fromkeys(CONTAINERS, NESTS) | dict.fromkeys(RAW, SKIPS)
        | dict.fromkeys(("br", "td", "th"), SPACE))

TAGS, OUTSIDE, INSIDE, PAGES = 0, 1, 2, 3  # kinds of tokens: openings, blocks outside and inside the main element
COUNTED = "host string, token long, kind int, depth int, pages long, times long, r1 long, r2 long, words long"
FLUSH_TOKENS = 400_000
KNOWN_OPENINGS = 20_000  # openings and paths whose words and hashes are kept between pages
KNOWN_WORDS = 200_000  # hashes of (path, word) kept between pages


@dataclass(frozen=True)
class Deduction:
    min_pages: int = 4
    share: float = 0.5  # of the host's pages, for openings and for words outside the main element
    main_pages: int = 10
    main_share: float = 0.8  # for words inside it
    main_part: float = 0.75  # of the host's words that are not frequent, for the main region


@dataclass(frozen=True)
class Template:
    words: frozenset[int] = frozenset()
    openings: frozenset[int] = frozenset()
    around: frozenset[int] = frozenset()  # openings of the main region and of those around it
    main: int | None = None


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "replace")) - (1 << 63)


def _not_main(word: str) -> bool:
    """Whether a class, id or role names something beside the main text ("no-sidebar" does not)."""
    first, *rest = re.split(r"[^a-z]+", word)
    return first not in ("no", "has", "with", "without") and not NOT_MAIN.isdisjoint((first, *rest))


@lru_cache(KNOWN_OPENINGS)
def _opening(name: str, attributes: str, inside: bool, names: bool) -> tuple[str, bool]:
    """The words of class, id and role of a container's opening, and whether its own name, words or state set it apart."""
    words = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower()
    own = bool(attributes and HIDDEN.search(attributes))
    if names:
        own = own or name in APART or name == "header" and not inside
        own = own or name not in ("html", "body") and any(_not_main(w) for w in words.split())
    return words, own


@lru_cache(KNOWN_OPENINGS)
def _path_token(path: str) -> int:
    return _hash(path)


def blocks_of(html: str, names: bool = True) -> Iterator[tuple[int, str, str, bool, bool, tuple[int, ...]]]:
    """(kind, path, text, apart, inside main, open) of openings (text empty) and blocks, in page order.

    ``open`` holds the tokens of the open containers, an opening's own last."""
    stack: list[tuple[str, str, bool, bool, tuple[int, ...]]] = [("", "", False, False, ())]  # tag, path, apart, inside, open
    times: dict[str, int] = {}
    pieces: list[str] = []
    tag, at, end = "", 0, len(html)
    find, match = html.find, TAG.match

    def block() -> tuple[int, str, str, bool, bool, tuple[int, ...]] | None:
        text = " ".join(unescape("".join(pieces)).split())
        pieces.clear()
        if not text:
            return None
        _, path, apart, inside, opened = stack[-1]
        return (INSIDE if inside else OUTSIDE), f"{path}/{tag}", text, apart, inside, opened

    while at < end:
        less = find("<", at)
        if less < 0:
            pieces.append(html[at:])
            break
        if less > at:
            piece = html[at:less]
            if pieces or not piece.isspace():  # white space before a block's text is trimmed
                pieces.append(piece)
        m = match(html, less)
        if m is None:
            if html.startswith("<!--", less):
                at = find("-->", less + 4) + 3
                if at < 3:
                    break
            elif html.startswith(("<!", "<?"), less):
                at = find(">", less) + 1
                if at < 1:
                    break
            else:
                pieces.append("<")
                at = less + 1
            continue
        at = m.end()
        closing, name, attributes = m.group(1, 2, 3)
        if name is None:
            closing, name, attributes = m.group(4, 5, 6)
        name = name.lower()
        does = DOES.get(name)
        if does is None:
            continue
        if does == SPACE:
            pieces.append(" ")
            continue
        if does == SKIPS and not closing:
            close = re.compile(f"</{name}\\b", re.I).search(html, at)
            at = end if close is None else close.start()
            continue
        if name not in BLOCKS:
            continue
        if pieces and (found := block()):
            yield found
        tag = "" if closing else name
        if does != NESTS:
            continue
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
            continue
        _, path, apart, inside, opened = stack[-1]
        words, own = _opening(name, attributes, inside, names)
        path = f"{path}/{name}" + (f".{words}" if words else "")
        times[path] = n = times.get(path, 0) + 1
        path = f"{path}#{n}"
        opened = (*opened, _path_token(path))
        if not attributes.endswith("/") or name not in VOID:
            stack.append((name, path, apart or own, inside or names and name in MAIN, opened))
        yield TAGS, path, "", apart or own, inside, opened
    if pieces and (found := block()):
        yield found


class _Tokens(dict):
    """Tokens of the words at one path, made when first asked for."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.seed = _hash(path) + (1 << 63)

    def __missing__(self, word: str) -> int:
        token = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), self.seed) - (1 << 63)
        return token


class _Words:
    """Tokens of the words of blocks; kept until there are too many (looked at now and then)."""

    def __init__(self) -> None:
        self.known: dict[str, _Tokens] = {}
        self.n = 0  # words seen since the last look

    def _at(self, path: str, words: int) -> _Tokens:
        self.n += words
        if self.n > KNOWN_WORDS and sum(map(len, self.known.values())) > KNOWN_WORDS / 2:
            self.known.clear()
        if self.n > KNOWN_WORDS:
            self.n = words
        known = self.known.get(path)
        if known is None:
            known = self.known[path] = _Tokens(path)
        return known

    def of(self, path: str, text: str) -> list[int]:
        words = text.split(" ")
        return list(map(self._at(path, len(words)).__getitem__, words))

    def all_in(self, tokens: frozenset[int], path: str, text: str) -> bool:
        """Whether all words are among ``tokens``; reads no further than the first that is not."""
        known = self._at(path, 1)
        return all(known[word] in tokens for word in text.split(" "))


def main_text(html: str, template: Template = Template(), names: bool = True, words: _Words | None = None) -> str:
    words = words or _Words()
    slots = []  # text, inside the main element, in or around the main region
    for kind, path, text, apart, inside, opened in blocks_of(html, names):
        if kind == TAGS or apart or template.words and words.all_in(template.words, path, text):
            continue
        region = next((o for o in reversed(opened) if o in template.openings), None)
        slots.append((text, inside, template.main is None or region is None or region in template.around
                      or template.main in opened))
    inner = [text for text, inside, _ in slots if inside]
    return "\n\n".join(inner or [text for text, _, main in slots if main] or [text for text, _, _ in slots])


# ------------------------------------------------------------------ Spark
def _frequent_here(names: bool, share: float):
    """Per host and group of pages: the tokens in ``share`` of the group's pages, with the most pages that a token
    kept back can have (``slack``); token 0 stands for the group itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # host: counts by path of its words, as they stand, and at "" of its openings' tokens and of the pages (0)
        groups: dict[str, dict[str, Counter]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for host, counts in groups.items():
                least = share * counts[""][0]
                slack = math.ceil(least) - 1
                for path, own in counts.items():
                    often = [(key, n) for key, n in own.items() if n >= least]
                    if path:  # only these words are hashed
                        token = _Tokens(path)
                        often = [(token[word], n) for word, n in often]
                    rows += [(host, token, n, slack) for token, n in often]
            groups.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["host", "token", "n", "slack"])

        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(2)):
                seen: dict[str, set] = {"": {0}}
                for kind, path, text, _, _, opened in blocks_of(html.as_py() or "", names):
                    if kind == TAGS:
                        seen[""].add(opened[-1])
                    else:
                        seen.setdefault(path, set()).update(text.split(" "))
                counts = groups.setdefault(host, {})
                for path, keys in seen.items():
                    own = counts.setdefault(path, Counter())
                    size -= len(own)
                    own.update(keys)
                    size += len(own)
                if size >= FLUSH_TOKENS:
                    yield flush()
                    size = 0
        if groups:
            yield flush()

    return run


def _count_tokens(names: bool):
    """Occurrence vectors of the candidates of each host, and the words inside openings that are none; token 0 is the page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[int]] = {}
        words, last, known = _Words(), None, frozenset()
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5]

        def flush() -> pa.RecordBatch:
            rows = [(*key, *values) for key, values in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                              [c.split()[0] for c in COUNTED.split(", ")])

        for b in batches:
            for host, page, html, candidates in zip(*(b.column(i) for i in range(4))):
                host, html, page = host.as_py(), html.as_py() or "", page.as_py()
                if host != last:
                    last, known = host, frozenset(candidates.as_py())
                r1, r2 = page & 0x7FFFFFFF, page >> 31 & 0x7FFFFFFF
                seen: dict[int, list[int]] = {0: [PAGES, 0, 1, 0]}  # kind, depth, times, words that are not frequent
                for kind, path, text, _, _, opened in blocks_of(html, names):
                    if kind == TAGS:
                        if opened[-1] in known:
                            seen[opened[-1]] = [TAGS, len(opened), 1, 0]
                        continue
                    tokens = words.of(path, text)
                    often = [t for t in tokens if t in known]
                    for token in often:
                        seen.setdefault(token, [kind, 0, 0, 0])[2] += 1
                    rare = len(tokens) - len(often)
                    for o in (0, *opened):
                        if o in seen:
                            seen[o][3] += rare
                for token, (kind, depth, n, rare) in seen.items():
                    s = sums.setdefault((host, token), [kind, depth, 0, 0, 0, 0, 0])
                    s[2] += 1
                    s[3] += n
                    s[4] += n * r1
                    s[5] += n * r2
                    s[6] += rare
                if len(sums) >= FLUSH_TOKENS:
                    yield flush()
        if sums:
            yield flush()

    return run


def _page_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [_hash("", "\n".join([f"{kind} {path} {text}" for kind, path, text, *_ in blocks_of(html.as_py() or "")]))
                for html in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64())], ["host", "page", "key"])


def _distinct_pages(pages: DataFrame) -> DataFrame:
    """``host, page, html`` with one page of each sequence of blocks on a host; ``page`` is a hash of host and html."""
    pages = pages.where(F.col("host").isNotNull()).select("host", F.xxhash64("host", F.coalesce("html", F.lit(""))).alias("page"), "html")
    keys = frozen(pages.mapInArrow(_page_keys, "host string, page long, key long").groupBy("host", "key", "page")
                  .agg(F.count(F.lit(1)).alias("n")))
    low = keys.groupBy("host", "key").agg(F.min("page").alias("low"), F.sum("n").alias("all")).where(F.col("all") > 1)
    copies = frozen(keys.join(low, ["host", "key"]).select(F.col("page").alias("page_"), (F.col("page") == F.col("low")).alias("first"))
                    .distinct())
    copies = small_side(copies, copies.count())
    same = F.col("page") == F.col("page_")
    single = pages.join(copies, same, "left_anti")
    # only the html of pages that are copied is shuffled
    return single.unionByName(pages.join(copies.where("first"), same, "left_semi").dropDuplicates(["host", "page"]))


def _by_host(rows: DataFrame, state: DataFrame, tokens: int, salts: int, page: str, how: str) -> DataFrame:
    """``rows`` with the state (``host_``, ...) of their host: broadcast when small, else joined salted by page."""
    same = F.col("host") == F.col("host_")
    if tokens <= 400_000:
        return rows.join(small_side(state, tokens), same, how).drop("host_")
    spread = state.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(page), F.lit(salts)))
    return salted.join(spread, same & (F.col("salt") == F.col("salt_")), how).drop("host_", "salt", "salt_")


def templates(pages: DataFrame, deduction: Deduction = Deduction(), names: bool = True, salts: int = 32) -> DataFrame:
    """(``host_``, ``words``, ``openings``, ``around``, ``main``): each host's template, from ``host, html``; copies of a
    page count once."""
    distinct = _distinct_pages(pages)
    local = frozen(distinct.mapInArrow(_frequent_here(names, deduction.share), "host string, token long, n long, slack long")
                   .groupBy("host", "token").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack")))
    whole = local.where("token = 0").select(F.col("host").alias("host_"), F.col("n").alias("of"), F.col("slack").alias("all"))
    least = F.greatest(F.lit(float(deduction.min_pages)), F.col("of") * F.lit(deduction.share))
    known = frozen(local.where("token != 0").join(whole, F.col("host") == F.col("host_"))
                   .where(F.col("n") + F.col("all") - F.col("slack") >= least)
                   # at most some multiple of the tokens of a page can be frequent
                   .groupBy("host_").agg(F.collect_list("token").alias("known")))
    n = known.agg(F.sum(F.size("known"))).first()[0] or 0
    counted = _by_host(distinct, known, n, salts, "page", "inner").select("host", "page", "html", "known")
    tokens = frozen(counted.mapInArrow(_count_tokens(names), COUNTED).groupBy("host", "token").agg(
        F.max("kind").alias("kind"), F.max("depth").alias("depth"),
        *(F.sum(c).alias(c) for c in ("pages", "times", "r1", "r2", "words"))))
    hosts = tokens.where(F.col("kind") == PAGES).select(F.col("host").alias("h"), F.col("pages").alias("of"),
                                                        F.col("words").alias("all"))
    shared = (tokens.where(F.col("kind") != PAGES).join(hosts, F.col("host") == F.col("h"))
              .where((F.col("pages") >= deduction.min_pages) & (F.col("pages") >= F.col("of") * F.lit(deduction.share))))
    vector = ("host", "pages", "times", "r1", "r2")
    valid = shared.groupBy(*vector).agg(F.max((F.col("kind") == TAGS).cast("int")).alias("tags")).where("tags = 1")
    opening = F.col("kind") == TAGS
    inner = ((F.col("of") >= deduction.main_pages) & (F.col("pages") >= F.col("of") * F.lit(deduction.main_share)))
    word = (F.col("kind") == OUTSIDE) | (F.col("kind") == INSIDE) & inner
    around = opening & (F.col("all") > 0) & (F.col("words") >= F.col("all") * F.lit(deduction.main_part))
    token = F.col("token")
    # a token is in half of the pages at least, so there are at most twice as many as on a page
    return shared.join(valid.drop("tags"), list(vector)).groupBy(F.col("host").alias("host_")).agg(
        F.collect_list(F.when(word, token)).alias("words"), F.collect_list(F.when(opening, token)).alias("openings"),
        F.collect_list(F.when(around, token)).alias("around"),
        F.max_by(F.when(around, token), F.when(around, F.col("depth"))).alias("main"))


def _extract(names: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = {}, _Words()
        for b in batches:
            texts = []
            for html, host, *state in zip(*(b.column(i) for i in range(2, 8))):
                host = host.as_py()
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    tokens, openings, around, main = (x.as_py() for x in state)
                    known[host] = Template(*(frozenset(x or ()) for x in (tokens, openings, around)), main)
                texts.append(main_text(html.as_py() or "", known[host], names, words))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])

    return run


def extract_main_text(pages: DataFrame, deduction: Deduction = Deduction(), salts: int = 32, id_col: str = "page_id",
                      url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """``page_id``, ``url`` and ``text`` (blocks joined by an empty line) of every page."""
    host = F.lower(F.regexp_extract(q(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(q(id_col).cast("long").alias("page_id"), q(url_col).alias("url"), q(html_col).alias("html"),
                        F.when(host != "", host).alias("host"))
    found = frozen(templates(rows, deduction, names, salts))
    n = found.agg(F.sum(F.size("words") + F.size("openings"))).first()[0] or 0
    return (_by_host(rows, found, n, salts, "url", "left")
            .select("page_id", "url", "html", "host", "words", "openings", "around", "main")
            .mapInArrow(_extract(names), "page_id long, url string, text string"))

"""Mixing, n-gram join, quality rules, main text and the pipeline against brute force."""


import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from prepflow.llm.html_extract import blocks_of, extract_main_text, main_text
from prepflow.llm.mixing import SCHEDULES, Schedule, mix, mixed_documents
from prepflow.llm.ngram_join import Similarity, keep_first, near_duplicates
from prepflow.llm.quality import Rules, cleaned, judge, keep_good

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ mixing
def water_filled(sizes, weights, budget, cap):
    """Targets by resharing the excess until none is above."""
    left, targets = budget * sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    free = dict(weights)
    while free and left > 1e-9:
        unit = left / sum(free.values())
        left = 0.0
        for s in list(free):
            targets[s] += unit * free[s]
            if targets[s] >= cap * sizes[s]:
                left += targets[s] - cap * sizes[s]
                targets[s] = cap * sizes[s]
                del free[s]
    return targets


def test_mix_targets_and_limits(odd_documents):
    rows = mix(odd_documents, bucket_rows=10).collect()
    assert len(rows) == odd_documents.count()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in rows) == sorted(
        (r.doc_id if r.doc_id is not None else -1, len(WORD.findall(r.text or ""))) for r in odd_documents.collect())
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    order = sorted((s for s in sizes if s is not None)) + [None]
    expected = water_filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(c["take"] for c in r.copies)
        assert all(0 <= c["position"] <= 1 for c in r.copies)
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    again = mix(odd_documents.repartition(7), bucket_rows=1000)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(map(key, again.collect())) == sorted(map(key, rows))
    assert mix(odd_documents.limit(0)).count() == 0 and mixed_documents(odd_documents.limit(0)).count() == 0


@pytest.mark.parametrize("schedule", [*SCHEDULES, Schedule(((0.0, 0.0), (0.25, 2.0), (0.5, 2.0), (1.0, 0.0)))])
def test_schedule_inverse(spark, schedule):
    """The integral up to the position that a share gives is that share."""
    from pyspark.sql import functions as F

    def integral(t):
        total = 0.0
        for (t0, v0), (t1, v1) in zip(schedule.knots, schedule.knots[1:]):
            if t > t0:
                x = min(t, t1)
                total += (x - t0) * (v0 + v0 + (v1 - v0) * (x - t0) / (t1 - t0)) / 2
        return total

    shares = spark.range(21).select((F.col("id") / 20.0).alias("x"))
    for r in shares.select("x", schedule.inverse(F.col("x")).alias("t")).collect():
        assert integral(r.t) == pytest.approx(r.x * integral(1.0), abs=1e-9)


def test_mixed_documents_are_in_training_order(odd_documents):
    rows = mixed_documents(odd_documents).collect()
    assert rows and rows[0].asDict().keys() == set(odd_documents.columns)
    assert max(Counter((r.doc_id, r.text) for r in rows).values()) <= 4  # twice, and repeated rows


# ------------------------------------------------------------------ n-gram join
def components(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, b in enumerate(ids):
        for a in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.fixture(scope="module")
def families():
    """Near copies around texts of many lengths, and a passage that many of them share."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    bases = [[rng.choice(words) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 6, 8, 12, 20, 30, 40, 60, 90, 140) * 2]
    passage = [rng.choice(words) for _ in range(30)]
    out = []
    for i in range(420):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        out.append((3 * i + 1, " ".join(w + passage * (rng.random() < 0.3))))
    return [*out, (2, None), (5, " \n")]


@pytest.mark.parametrize("similarity", [Similarity(), Similarity(3, 70, block_elements=1500, block_sets=10)])
def test_components_equal_all_pairs(spark, families, similarity):
    docs = spark.createDataFrame(families, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, similarity).collect()}
    assert found == components(families, similarity.words, similarity.percent)


def test_join_of_odd_rows(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (None, "a b c d e", "x"), (2, None, "y"), (3, "", "y"),
            (4, "A b c d e", "z"), (5, "q", "z"), (6, "Q", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    found = Counter(tuple(r) for r in near_duplicates(docs).collect())
    assert found == Counter({(1, 2, 1): 2, (None, 2, None): 1, (2, 0, 2): 1, (3, 0, 3): 1, (4, 2, 1): 1, (5, 1, 5): 1, (6, 1, 5): 1})
    kept = keep_first(docs).collect()
    assert sorted((r.doc_id or 0, r.n) for r in kept) == [(0, "x"), (1, "x"), (2, "y"), (3, "y"), (5, "z")]
    assert near_duplicates(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ quality rules
def measures(t):
    w = WORD.findall(t)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality_measures(odd_documents):
    texts = {r.doc_id: r.text or "" for r in odd_documents.collect()}
    rows = judge(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    assert judge(odd_documents.limit(0)).count() == 0 and keep_good(odd_documents.limit(0)).count() == 0


def test_boilerplate_depletes_documents(spark):
    """A line on most pages of a host goes; copies of one text count once; other hosts are not concerned."""
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    own = lambda i: " ".join(f"{letters(i)}x{letters(j)}" for j in range(30))
    rows = [(i, f"Please accept  our cookies {i}\n{own(i)}", "a") for i in range(40)]
    rows += [(100, "please accept our cookies 7\nplease ACCEPT our cookies 8\n" + own(100)[:20], "a")]
    rows += [(101, "please accept our cookies 7\n" * 4 + "few words of its own here now", "b")]
    rows += [(200 + i, own(999) + "\n" + own(998), "a") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in judge(docs, Rules(max_repeat_percent=100)).collect()}
    assert {i for i, r in found.items() if not r.kept} == {100}
    assert all(found[i].n_boilerplate == 5 for i in range(40)) and found[100].n_boilerplate == 10
    assert found[101].n_boilerplate == 0 and found[210].n_boilerplate == 0
    assert keep_good(docs, Rules(max_repeat_percent=100)).count() == len(rows) - 1


def test_boilerplate_leaves_the_texts(spark):
    """Kept texts lose their frequent lines and nothing else; the others stay byte for byte."""
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    own = lambda i: " ".join(f"{letters(i)}x{letters(j)}" for j in range(30))
    rows = [(i, f"Please accept  our cookies {i}\n{own(i)}\n\n {own(1000 + i)} \nplease accept our COOKIES 1", "a", 1)
            for i in range(40)]
    rows += [rows[3], (None, rows[4][1], "a", 1), (3, rows[3][1], "b", 1), (4, rows[4][1], None, 1)]
    rows += [(100, "please accept our cookies 7\n" + own(100)[:20], "a", 1), (101, " \n" + own(101) + "\n", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").repartition(3)
    found = cleaned(docs, Rules(max_repeat_percent=100))
    assert found.schema == docs.schema
    short = {i: f"{own(i)}\n\n {own(1000 + i)} " for i in range(40)}
    expected = Counter((i, short[i], "a", len(short[i])) for i in (*range(40), 3))
    expected.update([(None, short[4], "a", len(short[4])), rows[42], rows[43], rows[45]])
    assert Counter(tuple(r) for r in found.collect()) == expected
    assert cleaned(docs.limit(0)).count() == 0
    stage = dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, "")
    assert not stage.where("source = 'a' and lower(text) like '%cookies%'").count()


@pytest.mark.parametrize("n, edits", [(30, 1), (120, 1), (60, 3)])
def test_near_copies_are_not_their_own_boilerplate(spark, n, edits):
    """Of a family of near copies one member comes through two stages, whole; a shared frame still goes."""
    rng = random.Random(n)
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    own = lambda i: " ".join(f"{letters(i)}x{letters(j)}" for j in range(40))
    base = [[f"{letters(i)}w{letters(j)}" for j in range(12 * edits)] for i in range(10)]

    def copy(i):
        lines = [list(x) for x in base]
        for e, at in enumerate(rng.sample(range(10), edits)):
            lines[at][rng.randrange(12 * edits)] = f"edit{letters(i)}x{letters(e)}"
        return "\n".join(map(" ".join, lines))

    rows = [(i, copy(i), "a") for i in range(n)]
    rows += [(1000 + i, f"All our offers of the day\n{own(1000 + i)}\nImprint and terms", "a") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_rules"](spark, docs, "")
    texts = {r.doc_id: r.text for r in good.collect()}
    assert texts == {i: t if i < 1000 else own(i) for i, t, _ in rows}
    left = [r.doc_id for r in stage["near_duplicates"](spark, good, "").collect()]
    assert [i for i in left if i < 1000] == [0] and len(left) == 61


# ------------------------------------------------------------------ main text
def test_main_text_of_one_page():
    page = ('<html><body class="x no-sidebar"><header><h1>Site</h1></header><main><article><header><h1>T &amp; U</h1></header>'
            '<p>one  two<br>three&nbsp;4</p><div class="share">x</div><ul><li>a<li>b</ul><section id="comments"><p>c</p></section>'
            '<pre> z\n y</pre><form>f<input></form><p hidden>h</article></main><aside>s</aside><footer>f</footer></body>')
    assert main_text(page) == "T & U\n\none two three 4\n\na\n\nb\n\nz y\n\nh"
    assert main_text("<p>a<b>b</b> < c &lt;d<script>if(a<b)</script><p>e<!-- x") == "ab < c <d\n\ne"
    assert main_text("") == "" and main_text("<" * 3000 + "a='>").startswith("<")


def test_template_is_deduced(spark):
    """Without any telling names, blocks that come with the same frame on a host's pages go."""
    page = lambda i: (f"<div><p>Our shop of good things<p>Home and more</div><div><p>Text {i} of its own "  # noqa: E731
                      f"&amp; more</p><p>Second {i * i}</div><div><p>All prices in euro</div>")
    rows = [(i, f"https://shop.example/{i}", page(i), "x") for i in range(30)]
    rows += [(50, "https://other.example/", page(3), "x"), (51, None, page(4), "x"), (52, "https://shop.example/z", None, "x"),
             (None, "https://shop.example/3", page(3), "x"), (3, "https://shop.example/3", page(3), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract_main_text(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.url and "shop" in r.url and not r.url.endswith("z"):
            i = int(r.url.rsplit("/", 1)[1])
            assert r.text == f"Text {i} of its own & more\n\nSecond {i * i}"
        elif r.page_id == 52:
            assert r.text == ""
        else:
            assert r.text.startswith("Our shop") and r.text.count("\n\n") == 4
    assert extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["div", "article"])
def test_copies_of_a_page_are_no_template(spark, tag):
    """12 equal pages, repeated rows and pages that differ outside their blocks keep their text."""
    page = lambda i, more="": (f"<body{more}><div><p>Our shop of good things</div><{tag}><p>Text {i} of its own</p></{tag}>"  # noqa: E731
                               "<div><p>All prices in euro</div></body>")
    whole = lambda i: f"Our shop of good things\n\nText {i} of its own\n\nAll prices in euro"
    rows = [(i, f"https://one.example/{i}", page(1)) for i in range(12)]
    rows += [(20, "https://two.example/", page(2))] * 12
    rows += [(30 + i, f"https://three.example/{i}", page(3, f" data-url='/{i}'")) for i in range(12)]
    rows += [(60 + i, f"https://four.example/{i}", page(max(0, i - 20))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = extract_main_text(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        i = 1 if r.page_id < 20 else 2 if r.page_id < 30 else 3 if r.page_id < 60 else max(0, r.page_id - 80)
        own = f"Text {i} of its own"
        assert r.text == (own if r.page_id >= 60 or tag == "article" else whole(i))


def brute_force_texts(rows, names):
    """Whole occurrence vectors, one entry per distinct page of a host; classes by equal vectors."""
    hosts = defaultdict(list)
    for page_id, url, html in rows:
        hosts[url.split("/")[2] if url else None].append((page_id, list(blocks_of(html or "", names))))
    for host, pages in hosts.items():
        distinct = list({str([b[:3] for b in blocks]): blocks for _, blocks in pages}.values()) if host else []
        counts = [Counter(t for kind, path, text, *_, o in blocks for t in
                          ([("open", o[-1], len(o))] if kind == 0 else [("word", path, w, kind) for w in text.split(" ")]))
                  for blocks in distinct]
        vectors, classes = {}, defaultdict(list)
        for token in set().union(*counts):
            vectors[token] = tuple(c[token] for c in counts)
            classes[vectors[token]].append(token)
        n = len(distinct)
        often = {t for t, v in vectors.items() if sum(x > 0 for x in v) >= max(4, n / 2)}
        valid = {t for t in often if any(u[0] == "open" for u in classes[vectors[t]])}
        template = {t for t in valid if t[0] == "open" or t[3] == 1 or n >= 10 and sum(x > 0 for x in vectors[t]) >= 0.8 * n}
        rare = Counter()
        for blocks in distinct:
            for kind, path, text, *_, o in blocks:
                for w in text.split(" ") if kind else ():
                    rare.update([0, *o] if ("word", path, w, kind) not in often else [])
        openings = {t[1]: t[2] for t in template if t[0] == "open"}
        around = {o for o in openings if rare[0] and rare[o] >= 0.75 * rare[0]}
        main = max(around, key=openings.get, default=None)
        for page_id, blocks in pages:
            slots = []
            for kind, path, text, apart, inside, o in blocks:
                if kind and not apart and not all(("word", path, w, kind) in template for w in text.split(" ")):
                    region = [x for x in o if x in openings][-1:]
                    slots.append((text, inside, main is None or not region or region[0] in around or main in o))
            inner = [t for t, inside, _ in slots if inside]
            yield page_id, "\n\n".join(inner or [t for t, _, here in slots if here] or [t for t, *_ in slots])


@pytest.mark.parametrize("names", [True, False])
def test_templates_match_brute_force(spark, names):
    """Pages whose words are shared by chance, by about half of a host's pages; inserts; hosts of 1 to 40 pages."""
    rng = random.Random(7)
    some = lambda n, of: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()[:of]) for _ in range(n))
    rows = []
    for host, n in enumerate((1, 3, 4, 9, 12, 40)):
        for i in range(n):
            advert = f"<div class='x'><p>{some(2, 3)}</div>" if rng.random() < 0.55 else ""
            items = "".join(f"<li>{some(1, 8)}</li>" for _ in range(rng.randrange(4)))
            own = "".join(f"<p>{some(5, 8)} w{rng.randrange(60)} v{i}" for _ in range(rng.randrange(5)))
            tag = "article" if host % 2 else "div"
            rows.append((len(rows), f"http://h{host}.example/{i}", f"<nav>Home shop<ul>{items}</ul></nav>{advert}<{tag}><h1>The {some(2, 2)}</h1>"
                         f"{own}<table><tr><td>price {rng.randrange(3)}</table></{tag}><div>\u00a9 all {some(1, 2)}</div>"))
        rows += [(len(rows) + j, f"http://h{host}.example/again", rows[-1][2]) for j in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in extract_main_text(pages, names=names).collect()} == dict(brute_force_texts(rows, names))


def test_places_decide_without_names(spark):
    """Menus, adverts and footers that differ from page to page go by their place in the template alone."""
    rng = random.Random(3)
    some = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    texts = {i: "\n\n".join([some(6), *(some(30) for _ in range(1 + i % 4))]) for i in range(24)}
    page = lambda i: ("<div class='a'>" + "".join(f"<li>{some(1)}</li>" for _ in range(5)) + f"</div><div class='b'>{some(7)}</div>"  # noqa: E731
                      "<div class='c'>" + "".join(f"<p>{p}</p>" for p in texts[i].split("\n\n")) + f"</div><div class='d'>\u00a9 us {some(6)}</div>")
    pages = spark.createDataFrame([(i, f"https://h.example/{i}", page(i)) for i in range(24)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_main_text(pages, names=False).collect()} == texts


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "secrets", "mix_sources", "packing"]
    own = lambda i: " ".join(f"word{i}n{j}" for j in range(25 + i % 7))
    rows = [(i, own(i) + (" token = abcdefgh1234" if i == 3 else ""), "en", f"s{i % 2}", 0) for i in range(20)]
    rows += [(50, own(5), "en", "s0", 0), (51, "too short", "en", "s0", 0), (52, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_rules"](spark, docs, "")
    assert {r.doc_id for r in good.collect()} == {*range(20), 50} and good.columns == docs.columns
    single = stage["near_duplicates"](spark, good, "")
    assert {r.doc_id for r in single.collect()} == set(range(20)) and single.columns == docs.columns
    clean = stage["secrets"](spark, single, "")
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts == {i: own(i) + (" [secret]" if i == 3 else "") for i in range(20)}
    mixed = stage["mix_sources"](spark, clean, "")
    assert mixed.columns == docs.columns and mixed.count() > 20
    pieces = stage["packing"](spark, mixed, "").collect()
    copies = Counter(r.doc_id for r in mixed.collect())
    by = defaultdict(int)
    for p in pieces:
        by[p.doc_id] += p.length
    assert by == {p.doc_id: copies[p.doc_id] * p.doc_tokens for p in pieces}


def test_first_count_hashes_frequent_words_alone(monkeypatch):
    import pyarrow as pa
    from prepflow.llm import html_extract as he
    made, hashed = [], he._Tokens.__missing__
    monkeypatch.setattr(he._Tokens, "__missing__", lambda self, word: (made.append(word), hashed(self, word))[1])
    pages = [f"<body><nav>Home About</nav><p>Only {i} here{i} &amp; there{i}</p>\n <p>Home</p></body>" for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(["h"] * 40), pa.array(range(40)), pa.array(pages)], ["host", "page", "html"])
    rows = [tuple(r.values()) for b in he._frequent_here(True, 0.5)(iter([batch])) for r in b.to_pylist()]
    assert len(made) < 10
    seen = {}
    for page in pages:
        tokens = {0}
        for kind, path, text, _, _, opened in he.blocks_of(page):
            tokens |= {opened[-1]} if kind == he.TAGS else {he._Tokens(path)[w] for w in text.split()}
        for t in tokens:
            seen[t] = seen.get(t, 0) + 1
    assert sorted(rows) == sorted(("h", t, n, 19) for t, n in seen.items() if n >= 20)


def test_rounds_of_few_edges_take_few_tasks(spark, monkeypatch):
    from prepflow.llm import components as co
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts, write = [], co.frozen
    monkeypatch.setattr(co, "frozen", lambda df: (out := write(df), parts.append(out.rdd.getNumPartitions()))[0])
    try:
        rng = random.Random(4)
        pairs = [(i, i + 1) for i in range(1, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
        for per_task, tasks in ((100_000, 1), (40, 16)):
            monkeypatch.setattr(co, "EDGES_PER_TASK", per_task)
            parts.clear()
            edges = spark.createDataFrame(pairs, "u long, v long").repartition(16)
            found = {r["node"]: r["root"] for r in co.components(edges).collect()}
            assert len(parts) > 2 and max(parts[1:]) <= tasks
            up = {x: x for p in pairs if p[0] != p[1] for x in p}
            for _ in up:
                for u, v in pairs:
                    if u != v:
                        up[u] = up[v] = min(up[u], up[v])
            assert found == up
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)

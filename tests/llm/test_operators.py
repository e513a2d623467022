"""Operators on small fixtures with the awkward cases, against brute force."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import common, decontaminate, hashing, html_text, language_model, line_dedup, near_dedup, packing, quality, queries, secrets, suffix_dedup, warc
from lodestrata.llm.common import read, shared_dir

from .. import oracle
from . import brute

SF = "/root/testdata/sf0.001"
#: Names that operators use inside, and which documents may have too.
CLASHING = (
    "d t r h k ws row kind text_hash gone bad bad_id _bad a b m n i j l s e x key rep comp band bands prints bottom set hub leaf chunk part task side item item_id shard rows kept score doc of at "
    "hash hot first last place pos col value line lines runs keep n_lines n_dropped keep_runs word words n_words bucket c f g o p q u v w z label quality toxic trusted target size length start piece offset sequence_id"
).split()
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def rows_of(texts):
    """Documents with columns whose names clash with those that operators use inside."""
    return [(d, t, "en", "s", len(t or ""), *(None if c in ("k", "text_hash") else "x" for c in CLASHING)) for d, t in texts]


def awkward():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, line = words(120), "A line that many documents share, Éa"
    near = base.split(" ")
    near[7] = "changed"
    passage = words(60)
    texts = [
        (1, None), (2, ""), (3, "   \n\t\n "), (4, "one"), (5, "one two three"), (6, base), (7, base), (8, " ".join(near)), (8, " ".join(near)),  # a row twice
        (9, base.upper()), (10, f"{words(30)}\n{line}\n{words(30)}"), (11, f"{words(30)}\n  {line.upper().replace('É', 'é')} \n{line}\n"), (12, f"{line}\n{words(40)}\n{line}"), (13, f"{words(10)}\n{line}"),
        (14, words(200) + " " + passage + " " + words(100)), (15, passage + " " + words(90)), (15, "another text of the same id " + passage), (None, "no id here " + words(30)), (None, base),
        (16, "x" * 5000), (17, "ab" * 3000), (18, "La " * 900), (19, words(4000)), (20, "\x1c" + words(12) + "\x85\xa0" + words(5)), (21, "token = " + "a1" * 12 + " password: 'short' AKIA" + "Z9" * 10),
        (22, "K K İ i " * 8), (23, "token = token = abcdefghijklmnop"), (24, "🙂 secret=" + "Q" * 15 + " é user: bob key=hunter22hunter22"),
        (25, "one two three"), (26, passage), (27, "<|endoftext|> and don't I'LL 12 ½ " + words(3)),
    ]
    return texts


@pytest.fixture(scope="module")
def texts():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), EXTRA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


def bag(rows):
    return collections.Counter(map(tuple, rows))


# -- hashing -------------------------------------------------------------------------------------


def test_word_hashes_do_not_depend_on_chunks(monkeypatch, texts):
    arrow = pa.array([t for _, t in texts], pa.string())
    whole, at = hashing.word_hashes(arrow)
    assert np.diff(at).tolist() == [len(brute.WORD.findall(t or "")) for _, t in texts]
    monkeypatch.setattr(hashing, "CHUNK", 64)
    monkeypatch.setattr(hashing, "_tables", {})
    again, _ = hashing.word_hashes(arrow)
    assert (whole == again).all()
    by_word = {}
    for w, h in zip((w for _, t in texts for w in brute.WORD.findall(brute.low(t))), whole.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert list(hashing.shingle_sets(pa.array([], pa.string()))) == []


# -- quality -------------------------------------------------------------------------------------


def test_quality(spark, docs, texts, empty):
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (14, 1, 1), (19, 0, 0), (None, 1, 0), (99, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs, labels)
    want = brute.scores(texts, {6, 14}, quality.BUCKETS, quality.SMOOTHING)
    expected = bag((d, *(b := brute.base_rules(t)), not b[-1] and round(s, 6) >= quality.THRESHOLD) for (d, t), s in zip(texts, want))
    assert bag(got.drop("score").collect()) == expected
    by_id = {d: s for (d, _), s in zip(texts, want) if d in (6, 14, 19)}
    assert {r["doc_id"]: r["score"] for r in got.where("doc_id in (6, 14, 19)").collect()} == pytest.approx(by_id, abs=2e-6)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    none = quality.quality_rules(docs, labels.where("false"))
    assert none.where("score <> 0").count() == 0
    assert quality.quality_rules(empty, labels).count() == 0


def test_quality_targets_are_bounded(spark):
    labels = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.trusted_ids(labels, 10).count() == 10


# -- secrets -------------------------------------------------------------------------------------


def test_secrets(docs, texts, empty):
    got = secrets.digest(secrets.scan_secrets(docs))
    assert bag((r["doc_id"], r["base_sha256"]) for r in got.collect()) == bag((d, hashlib.sha256(brute.base_spans(t).encode()).hexdigest()) for d, t in texts)
    assert secrets.scan_secrets(empty).count() == 0


def test_weak_parts_are_reported_only_together(spark):
    opaque, far = "key=hunter22hunter22", " word" * 60
    texts = [(1, opaque), (2, f"user: bob {opaque}"), (3, f"user: bob{far} {opaque}"), (4, "https://example.com/x"), (5, f"https://example.com/x user=bob {opaque}"), (6, "user: bob"), (7, "user: bob password=abcdefghijkl")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    names = [k[0] for k in secrets.KINDS]
    got = {r["doc_id"]: [names[s["kind"]] for s in r["spans"]] for r in secrets.scan_secrets(df).collect()}
    assert got == {1: [], 2: ["user", "opaque"], 3: [], 4: [], 5: ["endpoint", "user", "opaque"], 6: [], 7: ["user", "assign"]}


def test_short_passwords_are_weak_parts(spark):
    alone = ["password=hunter2", "passwd: S3cret99", "pwd=hunter2", "secret=Ab12Cd34", "token: abcd1234ef", "api_key = 'k3y9'", "auth=abcd"]
    texts = [(i, x) for i, x in enumerate(alone)] + [(10 + i, f"login=bob {x}") for i, x in enumerate(alone)]
    texts += [(20, "user=admin password=hunter2 https://db.example.com"), (21, "login=bob password=abc"), (22, "login=bob password=abcdefghijkl")]
    names = [k[0] for k in secrets.KINDS]
    got = {r["doc_id"]: [(names[s["kind"]], s["s"], s["e"]) for s in r["spans"]] for r in secrets.scan_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = {i: [] for i in range(len(alone))} | {10 + i: [("user", 0, 9), ("opaque", 10, 10 + len(x.rstrip("'")))] for i, x in enumerate(alone)}
    assert got == want | {20: [("user", 0, 10), ("opaque", 11, 27), ("endpoint", 28, 50)], 21: [], 22: [("user", 0, 9), ("assign", 10, 31)]}


# -- near duplicates -----------------------------------------------------------------------------


def test_near_duplicates(docs, texts, empty):
    comp = brute.near_duplicates(texts)
    got = near_dedup.near_duplicates(docs)
    assert bag(got.collect()) == bag((d, len(brute.shingles(t)), comp.get(d), d is None or comp[d] == d) for d, t in texts)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({d for d in comp if comp[d] == d}) and ids.count(None) == 2
    assert near_dedup.near_duplicates(empty).count() == 0


def test_links_that_stars_miss(spark):
    """A chain: each text is linked to its neighbours only, so no star centre sees all links."""
    words = [f"w{i}" for i in range(400)]
    texts = [(100 - i, " ".join(words[i * 8 : i * 8 + 120])) for i in range(30)]
    random.Random(1).shuffle(texts)
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute.near_duplicates(texts)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MEMBERS", 4)
    monkeypatch.setattr(near_dedup, "AT_ONCE", 7)
    monkeypatch.setattr(near_dedup, "KEPT", 32)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute.near_duplicates(texts)


def test_hot_groups_of_copies(spark, monkeypatch):
    """Keys, buckets, centres and components with more members than a task is meant to hold."""
    monkeypatch.setattr(common, "HOT", 3)
    for name, value in (("CHUNK", 4), ("DEALT", 8), ("AT_ONCE", 5), ("MEMBERS", 6)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = [(1000 + i, " ".join(base)) for i in range(30)]
    for i in range(50):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        texts.append((i * 7, " ".join(w)))
    texts += [(5000 + i, f"lone text number {i} of no group at all") for i in range(10)] + [(5000, " ".join(base)), (0, ""), (3, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute.near_duplicates(texts)


def test_links_at_the_threshold_are_found(spark):
    """Pairs of exactly 75 %: 120 of 160 shingles."""
    texts, pairs = [], 300
    for p in range(pairs):
        shared = [f"s{p}x{i}" for i in range(124)]  # 120 shingles
        a, b = [f"a{p}x{i}" for i in range(20)], [f"b{p}x{i}" for i in range(20)]  # 20 more on either side
        texts += [(2 * p, " ".join(shared + a)), (2 * p + 1, " ".join(shared + b))]
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sum(r["component_id"] == r["doc_id"] - 1 for r in got.where("doc_id % 2 = 1").collect()) == pairs


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:2400], rng.integers(0, 1 << 63, 600, dtype=np.uint64)]))
    same = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15
    assert (near_dedup.signature(a[:3]) == near_dedup.signature(a[:3])).all()


def test_components_of_few_links(spark):
    """Few links take a few jobs, not rounds of shuffles that the driver has to keep track of; both ways agree."""
    rng = np.random.default_rng(5)
    ends = rng.integers(-300, 300, (400, 2))
    ends = [(int(a), int(b)) for a, b in ends] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    links = common.cut(spark.createDataFrame(ends, "a long, b long"))
    want: dict[int, int] = {x: x for e in ends for x in e}
    while any(want[a] != want[b] for a, b in ends):
        for a, b in ends:
            want[a] = want[b] = min(want[a], want[b])
    spark.sparkContext.setJobGroup("few-links", "")
    got = {r["d"]: r["comp"] for r in near_dedup.components(links).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")
    spark.sparkContext.setJobGroup("other", "")
    assert got == want
    assert len(jobs) <= 8
    assert {r["d"]: r["comp"] for r in near_dedup.components(links, here=100).collect()} == want
    none = common.cut(spark.createDataFrame([], "a long, b long"))
    assert near_dedup.components(none).count() == 0


# -- suffixes ------------------------------------------------------------------------------------


def test_suffix_dedup(docs, texts, empty):
    got = suffix_dedup.digest(docs)
    assert bag(got.collect()) == bag((d, *x) for (d, _), x in zip(texts, brute.remove_repeats([t for _, t in texts])))
    assert suffix_dedup.digest(empty).count() == 0


def test_suffix_dedup_hot_classes(spark, monkeypatch):
    """A passage in every document, so that its classes are dealt by context and compared by fingerprints."""
    monkeypatch.setattr(suffix_dedup, "HOT_COUNT", 3)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(8))
    passage = "".join(word() for _ in range(60))
    texts = ["".join(word() for _ in range(40)) + passage[: rng.randint(150, 480)] + "".join(word() for _ in range(30)) for _ in range(25)] + [passage * 3, "z" * 900, passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert [tuple(r)[1:] for r in suffix_dedup.digest(df).orderBy("doc_id").collect()] == brute.remove_repeats(texts)


def test_difference_cover():
    covered = {(a - b) % suffix_dedup.V for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert covered == set(range(suffix_dedup.V))


def test_kept_bytes_are_given(spark, tmp_path):
    twice = "".join(chr(97 + i * i % 26) for i in range(260))
    df = spark.createDataFrame([(1, "head " + twice), (2, twice + " tail é")], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix_dedup.remove_repeats(df, f"file://{tmp_path}/s").collect()}
    assert got == {1: "head ", 2: " tail é"}


# -- pages ---------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div class="wrap sidebar-left"><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><article><h1>Title &amp; more</h1><p>One<br>two <b>bold<p>Three&nbsp;&#233;
<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><blockquote>quote</blockquote><div id="comments"><article class="comment"><p>reader</p></article></div><form>f</form><aside>x</aside></article></div><footer>end</footer>"""


def test_main_text():
    assert html_text.Page(PAGE).text() == "Title & more\n\nOne two bold\n\nThree é\n\na\n\nb\n\nc\n\nd\n\nquote"
    assert html_text.Page("plain &lt;text&gt; <b>x").text() == "plain <text> x"
    assert html_text.Page("<p>a<!-- open").text() == "a"
    assert html_text.Page("<div>" * 5000 + "deep").text() == "deep"
    assert html_text.Page('<main><p>m</p></main><div class="content"><p>c</p></div>').text() == "m"
    assert html_text.Page('<div class="post-body"><p>c</p></div><p>other</p>').text() == "c"
    assert html_text.Page("<p hidden>x<p aria-hidden=true>y<p>z").text() == "z"


def test_templates_are_deleted_by_recurrence(spark, tmp_path):
    plain = lambda i: f"<body><div><span>Menu of this site</span></div><div class='z'><p>Story number {i} is told here.</p></div><div><p>Imprint</p></div></body>"
    rows = [(i, "http://a.example/x", plain(i)) for i in range(12)] + [(50, "http://b.example/x", plain(50)), (60, None, None), (61, "", ""), (62, "http://a.example/art", f"<article><p>Imprint</p><div><span>Menu of this site</span></div><p>Own.</p></article>{plain(1)}")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df, f"file://{tmp_path}/t").collect()}
    assert all(got[i] == f"Story number {i} is told here." for i in range(12))
    assert got[50].startswith("Menu") and got[60] == got[61] == ""
    assert got[62] == "Imprint\n\nOwn."  # in an article only containers can be templates
    assert html_text.extract(df.where("false")).count() == 0


def test_copies_of_an_article_are_no_template(spark, tmp_path):
    story = "<div><p>A long story is told here.</p><p>It goes on for a while.</p></div>"
    parts = "<section><p>A first part of some length.</p></section><section><p>A second part of some length.</p></section><section><p>A third part of some length.</p></section>"
    page = lambda host, i, html: (i, f"http://{host}.example/{i}", html)
    rows = [page("equal", i, f"<article>{story}</article>") for i in range(5)] + [page("bare", i, f"<body>{story}</body>") for i in range(10, 15)]
    rows += [page("near", i, f"<article>{story}<p>Seen {i}</p></article>") for i in range(20, 25)] + [page("parts", i, f"<body>{parts}<p>Seen {i}</p></body>") for i in range(30, 35)]
    rows += [page("mixed", i, f"<body>{story}<div><p>Imprint of the site</p></div></body>") for i in range(40, 46)]
    rows += [page("mixed", i, f"<body><div><p>Quite another story, number {i}.</p></div><div><p>Imprint of the site</p></div></body>") for i in range(50, 55)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/t").collect()}
    told = "A long story is told here.\n\nIt goes on for a while."
    assert all(got[i] == told for i in (*range(5), *range(10, 15), *range(40, 46)))
    assert all(got[i] == f"{told}\n\nSeen {i}" for i in range(20, 25))
    assert all(got[i].startswith("A first part") and got[i].endswith(f"A third part of some length.\n\nSeen {i}") for i in range(30, 35))
    assert all(got[i] == f"Quite another story, number {i}." for i in range(50, 55))


def test_templates_by_brute_force(spark, tmp_path):
    """Random trees without any mark: counted, deleted and joined by plain recursion over the trees."""
    rng = random.Random(11)
    shared = [("div", [("span", [f"menu {i}"]), ("ul", [("li", [f"entry {i} {j}"]) for j in range(3)])]) for i in range(12)]
    host = lambda i: "ab"[i % 3 == 0]

    def tree(i):
        own = [("p", [f"paragraph {i} {j} " + "of some more words " * rng.randint(1, 9)]) for j in range(rng.randint(1, 5))]
        parts = own + rng.sample(shared, rng.randint(0, 4)) + [("div", [("p", [f"notice of the day {rng.randrange(3)}"])])]
        rng.shuffle(parts)
        return ("body", [("section", parts[:3]), ("div", parts[3:])])

    render = lambda x: x if isinstance(x, str) else f"<{x[0]}>{''.join(map(render, x[1]))}</{x[0]}>"

    def nodes(x):
        if not isinstance(x, str):
            yield render(x)
            for y in x[1]:
                yield from nodes(y)

    def blocks(x, gone):
        if isinstance(x, str):
            return [" ".join(x.split())]
        return [] if render(x) in gone else [b for y in x[1] for b in blocks(y, gone)]

    trees = [tree(i) for i in range(60)]
    trees += trees[:4] * 6  # copies
    count, bodies = collections.defaultdict(set), collections.defaultdict(set)
    for i, x in enumerate(trees):
        whole = "\n\n".join(blocks(x, ()))
        bodies[host(i)].add(whole)
        for y in nodes(x):
            if not y.startswith(("<body", "<span")):
                count[host(i), y].add(whole)
    want, changed = {}, 0
    for i, x in enumerate(trees):
        gone = {y for (h, y), n in count.items() if h == host(i) and len(n) >= 5 and 100 * len(n) >= 5 * len(bodies[h])}
        whole, rest = "\n\n".join(blocks(x, ())), "\n\n".join(blocks(x, gone))
        want[i] = rest if 100 * len(rest) >= 25 * len(whole) else whole
        changed += want[i] != whole
    df = spark.createDataFrame([(i, f"https://{host(i)}.example/{i}", render(x)) for i, x in enumerate(trees)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.main_text(df.repartition(4), f"file://{tmp_path}/t").collect()}
    assert {i: r["text"] for i, r in got.items()} == want and changed > 30
    assert sum(r["n_template"] > 0 for r in got.values()) >= changed and all(r["n_ruled"] == 0 for r in got.values())


def test_templates_go_before_rules(spark, tmp_path):
    page = lambda i: f"<nav><ul><li>Home</ul></nav><main><h1>Head {i}</h1><article><p>Story {i} is long enough.</p><div class='related'><p>Related {i}</p></div></article></main><footer>Imprint {i}</footer>"
    df = spark.createDataFrame([(i, "http://a.example/x", page(i)) for i in range(9)], "page_id long, url string, html string")
    for r in html_text.main_text(df, f"file://{tmp_path}/t").collect():
        i = r["page_id"]
        assert r["text"] == f"Head {i}\n\nStory {i} is long enough.\n\nRelated {i}"
        assert (r["n_template"], r["n_ruled"]) == (len("Home"), len(f"Imprint {i}"))


def test_any_html_takes_linear_time():
    import time

    n = 30_000
    odd = ['<a "' * n, "<a '\"" * n, '<a ">"' * n, "<" * n, "<!" * n, "<b>" * n + "<p>" * n, "<div>" * n + "</x>" * n, "<p><b>" * n, "<b>" * n + "<li>" * n, "</b>" * n, "<div><span>" * n + "</div>" * n, "&" * n, "<script>" * n, "<!--" * n, "<a =" * n + ">"]
    for html in odd:
        began = time.perf_counter()
        tree = html_text.Page(html + "end")
        tree.text()
        assert time.perf_counter() - began < 5, html[:12]
    assert html_text.Page("<p>before<a title=\"x>one</a> <b>two</b>").text() == "beforeone two"
    assert html_text.Page("<p>a</p><main><p>m</p></main><article><p>x<button>no</button>y</p></article>").text() == "m\n\nx y"


# -- benchmark -----------------------------------------------------------------------------------


def test_decontamination(spark, docs, texts, empty, monkeypatch):
    items = [(1, texts[15][1][: len(texts[15][1]) // 2]), (2, next(t for d, t in texts if d == 26)), (3, "one two three"), (4, None), (5, "   "), (6, "not in any of them at all, it isn't"), (2, "a second text of item two here")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n string")
    want = {}
    for d, t in texts:
        for i, x in items:
            s, r = brute.shingles(t), brute.shingles(x)
            if r and 100 * len(s & r) >= 75 * len(r):
                want[(d, i)] = max(want.get((d, i), 0), len(s & r))
    for block in (decontaminate.BLOCK_HASHES, 40):  # 40: several blocks
        got = decontaminate.contained_items(docs, bench, block)
        assert {(r["doc_id"], r["item_id"]): r["n_shared"] for r in got.collect()} == want
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and bag((r["doc_id"], r["text"]) for r in clean.collect()) == bag((d, t) for d, t in texts if d not in {x for x, _ in want})
    assert decontaminate.contained_items(empty, bench).count() == 0 and decontaminate.contained_items(docs, bench.where("false")).count() == 0


def test_short_items_inside_long_documents(spark):
    filler = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{filler} Paris is big {filler}"), (2, f"{filler} Paris"), (3, f"is big {filler}"), (4, "see Paris is"), (5, "a b"), (6, None), (7, "yes")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "paris is big"), (2, "paris"), (3, "a b c d"), (4, "yes"), (5, "w38 w39 paris is big w0")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in decontaminate.contained_items(docs, bench).collect()}
    assert got == {(1, 1, 1, 1), (1, 2, 1, 1), (2, 2, 1, 1), (4, 2, 1, 1), (7, 4, 1, 1), (1, 5, 2, 2)}


# -- language model --------------------------------------------------------------------------------


def test_language_model(docs, texts, empty):
    scores, _ = language_model.train_and_score(docs)
    held = [zlib.crc32(str("" if d is None else d).encode()) % 5 == 1 for d, _ in texts]
    want, total = brute.kneser_ney([t for (_, t), h in zip(texts, held) if not h], [t for _, t in texts])
    got = sorted(scores.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect(), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[3], r[6]))
    expected = sorted(((d, h, w[2], w[3], total, w[1], w[0]) for (d, _), h, w in zip(texts, held, want)), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[3], r[6]))
    for g, e in zip(got, expected):
        assert tuple(g)[:5] == e[:5] and g[5] == pytest.approx(e[5], rel=1e-9) and g[6] == pytest.approx(e[6], rel=1e-9)
    assert language_model.train_and_score(empty)[0].count() == 0


def test_language_model_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = language_model.train_and_score(spark.createDataFrame([(held, "a b")], "doc_id long, text string"))[0].first()
    assert (got["n_tokens"], got["n_known"], got["train_tokens"], got["score"]) == (3, 0, 0, 0.0)


def test_shards_of_the_model_are_bounded_whatever_the_partitions(spark, tmp_path, monkeypatch):
    texts = [" ".join(f"w{(i * 7 + j * j) % 90}" for j in range(60)) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    whole = language_model.train(df, f"file://{tmp_path}/whole").open()
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 50)
    model = language_model.train(df, f"file://{tmp_path}/parts").open()
    sizes = [len(np.asarray(common.map_shared(f"{n}.key", "<u8"))) for n in model.pairs.values()]
    assert sum(sizes) == whole.spread and max(sizes) <= 2 * 50 and len(sizes) >= model.total // 100
    ids, at = np.array([i % 91 - 1 for i in range(300)]), np.arange(0, 301, 10)
    assert (model.log10(ids, at) == whole.log10(ids, at)).all() and (model.discounts, model.uni_discounts) == (whole.discounts, whole.uni_discounts)


def test_stores_share_one_bound(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(common.StoreArray, "BLOCK", 80)
    monkeypatch.setattr(common.StoreArray, "KEPT", 3)
    arrays = []
    for i in range(5):
        (tmp_path / str(i)).write_bytes(np.arange(i, i + 100).astype("<i8").tobytes())
        arrays.append(common.StoreArray(fs.LocalFileSystem().open_input_file(str(tmp_path / str(i))), "<i8"))
    assert all((a[:] == np.arange(i, i + 100)).all() for i, a in enumerate(arrays))
    assert len({(id(a._blocks), k) for a in arrays for k in a._blocks}) <= 3


def test_probabilities_sum_to_one(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a b c", "b c d", "a a a", "", "d e f g a"])], "doc_id long, text string")
    model = language_model.train(df, f"file://{tmp_path}/m").open()
    words = sorted(range(model.size))
    for context in [*words, model.size]:
        ids = np.array([x for w in [*words, -1] for x in (context, w)])
        at = np.arange(0, len(ids) + 1, 2)
        # a text of two tokens each: the second one's probability in the context
        p = 10 ** model.log10(ids, at)[1::2] if context != model.size else 10 ** model.log10(ids[1::2], np.arange(len(words) + 2))
        assert p.sum() == pytest.approx(1.0, abs=1e-9)


# -- WARC ------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 2)
    monkeypatch.setattr(warc, "RUN_ROWS", 4)
    monkeypatch.setattr(common, "HOT", 5)
    rng = random.Random(4)
    rows = [(i, rng.choice(["http://b.example/p?x=1", "https://www.a.example:8080/", "http://a.example/q#frag", None, "not a url", "http://[bad"]), rng.choice([None, "", "<p>é</p>", f"<p>{i}</p>", "<p>same</p>"])) for i in range(60)] + [(None, "http://n.example/", "<p>same</p>"), (70, "http://t.example/\t\r\nx", "<p>tab</p>"), (5, "http://again.example/", "<p>dup id</p>"), (1_000_000_003, "http://a.example/q", "<p>same</p>"), (-5, "http://a.example/q", "early"), (2**62, "http://a.example/q", "late"), (-(2**62), "http://a.example/q", "never")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string").repartition(7)
    files = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_archives(files).drop("task")
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h in rows:
        raw, f = (h or "").encode(), first.get(h or "")
        later = f is not None and p != f
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if later else "response", f if later else None))
    assert bag(got.collect()) == bag(want)
    history = warc.merge_index(files, f"file://{tmp_path}/w", parts=4).orderBy("part", "place").collect()
    order = [(r["url_key"], r["timestamp"], (r["page_id"] is None, r["page_id"] or 0)) for r in history]
    assert order == sorted(order) and len(order) == len(rows)
    assert len({r["part"] for r in history}) == 4
    seen = collections.Counter()
    for r in history:
        seen[r["url_key"]] += 1
        assert r["number"] == seen[r["url_key"]]
    dates = {r["page_id"]: r["timestamp"] for r in history}
    assert [dates[i] for i in (-(2**62), -5, 1_000_000_003, 2**62)] == ["10000101000000", "20231231235955", "20550909014643", "99991231235959"]
    timed = warc.write_archives(pages.withColumn("seen", F.timestamp_seconds(F.lit(86400))), f"file://{tmp_path}/c", captured="seen")
    assert {r["timestamp"] for r in warc.merge_index(timed, f"file://{tmp_path}/c").collect()} == {"19700102000000"}
    kept = warc.write_archives(pages, f"file://{tmp_path}/v", min_revisit=5)
    assert warc.read_archives(kept).where("record_type = 'revisit' and payload_bytes < 5").count() == 0
    none = warc.write_archives(pages.where("false"), f"file://{tmp_path}/e")
    assert warc.read_archives(none).count() == 0 and warc.merge_index(none, f"file://{tmp_path}/e").count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(50), i) for _ in range(rng.randrange(30))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([])) == []


# -- lines -----------------------------------------------------------------------------------------


def test_line_dedup(spark, docs, texts, empty, monkeypatch):
    want = brute.line_dedup(texts)
    expected = bag((d, *x) for (d, _), x in zip(texts, want))
    assert bag(line_dedup.dedup_lines(docs).collect()) == expected
    monkeypatch.setattr(line_dedup, "hot_hashes", lambda occ: [r["h"] for r in occ.select("h").distinct().collect()])
    assert bag(line_dedup.dedup_lines(docs).collect()) == expected
    again = line_dedup.rewrite(docs)
    assert again.columns == docs.columns
    assert bag((r["doc_id"], r["text"], r["n_chars"]) for r in again.collect()) == bag((d, x[2] if x[1] else t, len(x[2]) if x[1] else None if t is None else len(t)) for (d, t), x in zip(texts, want))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_keep_bitmaps_are_runs(spark):
    line = "a line of twenty characters"
    df = spark.createDataFrame([(1, f"{line}\n{line}\nown\n{line}"), (2, line), (3, line)], "doc_id long, text string")
    got = {r["doc_id"]: r["keep_runs"] for r in line_dedup.keep_bitmaps(df).collect()}
    assert got == {1: [0, 2, 1, 1, 0], 2: [0, 1, 0], 3: [1]}


# -- packing ---------------------------------------------------------------------------------------


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_packing(rows, length):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(bins)


def test_packing(docs, texts, empty):
    length = 512
    got = packing.pack(docs, length=length).collect()
    want = []
    for (d, _), ids in zip(texts, reference_ids([t for _, t in texts])):
        want += [(d, k, a, len(p := ids[a : a + length]), zlib.crc32(p.tobytes())) for k, a in enumerate(range(0, len(ids), length))]
    assert bag(tuple(r)[:5] for r in got) == bag(want)
    total = sum(w[3] for w in want)
    assert check_packing(got, length) <= -(-total // length) + 2
    whole = packing.sequences(docs, length=length).collect()
    assert sum(len(r["ids"]) // 4 for r in whole) == total and len(whole) == len({r["sequence_id"] for r in got})
    assert packing.pack(empty).count() == 0


def test_packing_rises_through_the_tree(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    df = spark.createDataFrame([(i, "word " * (i * 37 % 90)) for i in range(300)], "doc_id long, text string").repartition(16)
    got = packing.pack(df, length=128).collect()
    total = sum(r["length"] for r in got)
    assert check_packing(got, 128) <= -(-total // 128) + 16  # at most a bin for each of the tiny partitions


def test_best_fit():
    where, offset, fills = packing.best_fit([60, 50, 40, 30, 20], 100)
    assert sorted(fills) == [100, 100] and where[0] == where[2]
    assert packing.best_fit([], 10) == ([], [], [])


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    alphabet = "aBcÉèßÿ×÷'stredvml_-!<|>#09²½ŒœΣσİıḰ \x1c漢字🙂 \n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|>x", "a<|startoftext|>b", "don't I'll we'VE", "'S", ""]
    encoder = packing.Encoder(packing.tokenizer_path(), remembered=500)
    for i in range(0, len(texts), 100):
        for own, ids in zip(encoder.encode(texts[i : i + 100]), reference_ids(texts[i : i + 100])):
            assert own == ids[:-1].tobytes()


# -- registered queries and the pipeline -------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_against_sql(spark, name):
    oracle.check(queries.QUERIES[name](spark, SF), oracle.connect(SF).sql(queries.oracles()[name]))


def test_query_suffix_dedup(spark):
    rows = read(spark, SF, "documents").select("doc_id", "text").collect()
    got = queries.op4_suffix_dedup(spark, SF).collect()
    assert bag(got) == bag((r["doc_id"], *x) for r, x in zip(rows, brute.remove_repeats([r["text"] for r in rows])))


def test_query_suffix_dedup_of_many(spark):
    """At sf0.1, against the repeated hashes of all windows."""
    sf, span = SF.replace("0.001", "0.1"), suffix_dedup.SPAN
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    windows = [brute.window_hashes(text, span) for _, text in docs]
    _, of, n = np.unique(np.concatenate(windows), return_inverse=True, return_counts=True)
    repeated = np.split(n[of] > 1, np.cumsum([len(w) for w in windows])[:-1])
    got = queries.op4_suffix_dedup(spark, sf).collect()
    assert bag(got) == bag((doc_id, *brute.without(text, np.flatnonzero(starts), span)) for (doc_id, text), starts in zip(docs, repeated))


def test_query_language_model(spark):
    rows = read(spark, SF, "documents").select("doc_id", "text").collect()
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in rows]
    want, total = brute.kneser_ney([r["text"] for r, h in zip(rows, held) if not h], [r["text"] for r in rows])
    got = {r["doc_id"]: r for r in queries.op7_language_model(spark, SF).collect()}
    for r, w in zip(rows, want):
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (w[2], w[3], total)
        assert g["score"] == pytest.approx(w[0], rel=1e-9) and g["base_score"] == pytest.approx(w[1], rel=1e-9)
    out = [g for g in got.values() if g["held_out"]]
    assert sum(g["score"] for g in out) > sum(g["base_score"] for g in out)  # better than the base on what it has not seen


def test_query_html_text(spark):
    import html
    import re

    got = {r["page_id"]: r["text"] for r in queries.op5_html_text(spark, SF).collect()}
    for r in read(spark, SF, "pages").collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_pipeline(spark):
    import corpus_pipeline

    rows = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    trusted = {r["doc_id"] for r in read(spark, SF, "labels").where("quality = 1").collect()}
    scores = brute.scores(rows, trusted, quality.BUCKETS, quality.SMOOTHING)
    rows = [r for r, s in zip(rows, scores) if not brute.base_rules(r[1])[-1] and round(s, 6) >= quality.THRESHOLD]
    rows = [(d, x[2]) for (d, _), x in zip(rows, brute.line_dedup(rows))]
    comp = brute.near_duplicates(rows)
    rows = [r for r in rows if comp[r[0]] == r[0]]
    items = [brute.shingles(r["text"]) for r in read(spark, SF, "benchmark").collect()]
    rows = [(d, t) for d, t in rows if not any(i and 100 * len(i & brute.shingles(t)) >= 75 * len(i) for i in items)]
    want = []
    for (d, _), ids in zip(rows, reference_ids([t for _, t in rows])):
        want += [(d, k, a, len(p := ids[a : a + 4096]), zlib.crc32(p.tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, SF).collect()
    assert bag(tuple(r)[:5] for r in got) == bag(want)
    check_packing(got, 4096)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "benchmark", "packing"]


def test_arrays_of_stores_that_cannot_be_mapped(tmp_path, monkeypatch):
    from pyarrow import fs

    rng = np.random.default_rng(1)
    kind = np.dtype([("key", "<u8"), ("n", "<i8")])
    whole = np.zeros(5000, kind)
    whole["key"], whole["n"] = np.sort(rng.integers(0, 3000, 5000)), rng.integers(0, 99, 5000)
    (tmp_path / "a").write_bytes(whole.tobytes())
    (tmp_path / "none").write_bytes(b"")
    monkeypatch.setattr(common.StoreArray, "BLOCK", 160)
    monkeypatch.setattr(common.StoreArray, "KEPT", 3)
    opened = lambda name: common.StoreArray(fs.LocalFileSystem().open_input_file(str(tmp_path / name)), kind)
    a, keys = opened("a"), np.unique(rng.integers(0, 3100, 700)).astype(np.uint64)
    for side in ("left", "right"):
        assert (np.searchsorted(a["key"], keys, side) == np.searchsorted(whole["key"], keys, side)).all()
    at = rng.integers(0, 5000, 900)
    assert (a[at] == whole[at]).all() and (a["n"][at] == whole["n"][at]).all() and (a[17:333] == whole[17:333]).all() and (np.asarray(a["n"]) == whole["n"]).all() and len(a._blocks) <= 3
    assert len(opened("none")) == 0 and np.searchsorted(opened("none")["key"], keys).sum() == 0


def test_counts_beyond_32_bits(tmp_path):
    name = f"{tmp_path}/pairs"
    keys, counts = np.array([5, 7, 9], np.uint64), np.array([2, 2**32 - 1, 2**35 + 1])
    many = np.zeros(2, language_model.MANY)
    many["key"], many["n"] = keys[1:], counts[1:]
    for end, array in ((".key", keys), (".count", np.minimum(counts, int(language_model.LOW)).astype("<u4")), (".many", many)):
        language_model._write(name + end, array)
    model = language_model.Model(str(tmp_path), 0, [], pairs={0: name}).open()
    assert model.pair_counts(np.array([4, 5, 7, 8, 9], np.uint64)).tolist() == [0, 2, 2**32 - 1, 0, 2**35 + 1]


def test_shared_dir_is_the_session_setting(spark):
    assert shared_dir(spark).removeprefix("file:") == spark.conf.get("spark.checkpoint.dir").removeprefix("file://")

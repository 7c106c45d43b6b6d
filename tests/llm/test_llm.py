"""The text operators: brute force, round trips, held-out accuracy and defined cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyflow.llm import chat_format, mixing, multiset_hash, packing, quality_model, quality_rules, simhash, toxicity, url_rules, wrappers
from tallyflow.llm.common import salted_rank
from tallyflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path(packing.TOKENIZER)
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns with the names that operators use inside.
CLASH = ["score", "predicted", "fp", "size", "k1", "times", "rank", "length", "h", "doc", "key", "b", "_rest", "passages", "kept"]


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    words = " ".join(f"word{i % 997} and some more text of line {i}." for i in range(30_000))
    rows = [
        (1, None, None, None, None), (None, "a null id with a dozen words in it so that the rules keep it well.", "en", "s", 3), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4),
        (4, words, "en", "t", len(words)), (5, "short", None, "s", 5), (5, "short", None, "s", 5), (5, "another text under the same id", "de", None, 9), (6, "x" * 200_000, "en", "t", 200_000),
        (7, "same words here for two rows that agree in every single word of it", "en", "t", 1), (8, "same words here for two rows that agree in every single word of it", "en", "t", 1), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOC)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


def empty(spark):
    return spark.createDataFrame([], DOC)


def labels_of(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# ---------------------------------------------------------------- classifiers


def held_out(spark, name, label, sf="/root/testdata/sf0.1"):
    out = QUERIES[name](spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).toPandas()
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    return rows


def test_quality_held_out(spark):
    rows = held_out(spark, "op1_bradley_terry_quality", "quality")
    assert (rows.predicted == rows.y).mean() > 0.97


def test_toxicity_held_out(spark):
    rows = held_out(spark, "op2_segment_toxicity", "toxic")
    toxic = rows[rows.y == 1]
    assert (toxic.predicted == 1).mean() > 0.85 and (rows[rows.y == 0].predicted == 0).mean() > 0.98


def test_logistic_differences_match_gradient():
    rng = np.random.default_rng(1)
    d = rng.normal(size=(400, 3)) + [0.5, 0, -0.3]
    w = quality_model.logistic_differences(d, ridge=0.01)
    grad = -(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + 0.01 * w
    assert np.abs(grad).max() < 1e-8


def plain_features(text):
    """The quality features by their definitions, a character at a time."""
    raw = (text or "").encode()
    words = raw.split()
    n, chars = max(1, len(words)), max(1, sum(map(len, words)))
    letters = [c for c in raw if chr(c).isalpha() and c < 128]
    lines = [x for x in (y.strip() for y in raw.split(b"\n")) if x]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    rare = lambda x: math.log1p(100 * x)
    some = 1.0 if words else 0.0
    return [
        math.log1p(len(words)), min(30, sum(map(len, words)) / n) if words else 1.0, rare(sum(c in b"#*$%&|<>" for c in raw) / n), rare(raw.count(b"!") / n), rare(raw.count(b"|") / n),
        sum(65 <= c <= 90 for c in letters) / max(1, len(letters)), rare(sum(48 <= c <= 57 for c in raw) / chars), rare(sum(c in b",;:?\"'()-" for c in raw) / n), sum(c > 127 for c in raw) / chars,
        len(set(words)) / n, len(again) / n, rare(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n), rare(1 - len(set(lines)) / len(lines)) if lines else 0.0,
        sum(x[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)), math.log1p(n / len(lines)) if lines else 0.0, some,
    ]


def test_quality_features_by_definition(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text) < 4000][:60] + [None, "", " \n", "A!", "a b a b a b a b a b", "x\nx\nY 12 é|"]
    got = quality_model.features(pa.array(texts, pa.string()))
    for t, row in zip(texts, got, strict=True):
        want = plain_features(t)
        if not (t or "").split():
            want[1] = row[1]  # a mean over no words is whatever stands in for it
        assert row == pytest.approx(want, abs=1e-9), t


def test_threshold_leaves_the_bad_share_below():
    rng = np.random.default_rng(4)
    y = (rng.random(3000) < 0.3).astype(int)
    x = np.column_stack([y + rng.normal(size=3000), rng.normal(size=3000)])
    sizes = {0: int((y == 0).sum()), 1: int((y == 1).sum())}
    w, threshold = quality_model.fit(x, y, sizes)
    assert ((x @ w) < threshold).mean() == pytest.approx(sizes[0] / 3000, abs=0.001) and w[0] > 5 * abs(w[1])


def test_models_are_learnt_from_all_labels(spark, monkeypatch):
    """What counts is in more labelled documents than any bound; the table's fit is that of the arrays."""
    rng = np.random.default_rng(6)
    y = (rng.random(30_000) < 0.8).astype(int)
    x = np.zeros((len(y), len(quality_model.FEATURES)))
    x[:, :2] = np.column_stack([y + rng.normal(size=len(y)), rng.normal(size=len(y))]).astype(np.float32)
    known = spark.createDataFrame([(i, int(c), row.tolist()) for i, (c, row) in enumerate(zip(y, x, strict=True))], "doc_id long, y int, x array<float>")
    known = quality_model.cut(known, "known")
    w, threshold = quality_model.fit_table(known)
    below = ((x @ w) < threshold).sum()
    assert below == (y == 0).sum()
    w2, threshold2 = quality_model.fit(x, y, {0: int((y == 0).sum()), 1: int((y == 1).sum())})
    assert w[:2] == pytest.approx(w2[:2], abs=0.05) and threshold == pytest.approx(threshold2, abs=0.05)
    pairs = quality_model.differences(known, {0: int((y == 0).sum()), 1: int((y == 1).sum())}, np.ones(len(quality_model.FEATURES)))
    assert pairs.count() == quality_model.EACH * (y == 1).sum()
    # Seven in ten of 24 000 documents count, more than seven in ten of 10 000 a class.
    docs = spark.range(24_000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'vile rot here' ELSE 'plain good here' END AS text")
    labels = spark.range(24_000).selectExpr("id AS doc_id", "CAST(id % 2 = 0 AS INT) AS toxic")
    seen, odds = [], toxicity.log_odds
    monkeypatch.setattr(toxicity, "log_odds", lambda c, n: seen.append(n) or odds(c, n))
    toxicity.train(docs, labels)
    assert sum(seen[0]) > 16_000 and min(seen[0]) > 8_000


def test_segments_are_all_maximal():
    """Against the definition: best-scoring interval first, then left and right of it."""
    rng = random.Random(5)

    def brute(scores, lo, hi):
        best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-12:
            return []
        _, _, i, j = best
        return brute(scores, lo, i) + [(i, j - 1, round(best[0], 6))] + brute(scores, j, hi)

    for _ in range(60):
        n = rng.randrange(1, 25)
        hits = {i: rng.choice([0.7, 1.3, 2.1]) + rng.random() / 100 for i in range(n) if rng.random() < 0.35}
        scores = [hits.get(i, -0.313) for i in range(n)]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(sorted(hits.items()), 0.313)]
        assert got == brute(scores, 0, n)


def test_many_sparse_hits_are_scanned_in_linear_time():
    import time

    began = time.perf_counter()
    found = toxicity.segments([(i * 300, 1.0) for i in range(100_000)], 0.01)
    assert len(found) == 100_000 and time.perf_counter() - began < 1


def test_lexicon_against_the_formula(spark):
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(60)]
    docs = [(i % 3 == 0, [rng.choice(vocabulary[:40] if i % 3 else vocabulary) for _ in range(30)]) for i in range(150)]
    n = [sum(not y for y, _ in docs), sum(y for y, _ in docs)]
    counts, want = {}, {}
    for y, words in docs:
        for w in toxicity.features([x.encode() for x in words]):
            counts.setdefault(w, [0, 0])[y] += 1
    assert counts[b"word-"] == n
    for w, (a, b) in counts.items():
        prior = toxicity.PRIOR_DOCS * (a + b) / sum(n)
        value = math.log((b + prior) / (n[1] + toxicity.PRIOR_DOCS) / ((a + prior) / (n[0] + toxicity.PRIOR_DOCS)))
        if b >= toxicity.LEAST_DOCS and value > toxicity.LEAST_ODDS and value / math.sqrt(1 / (a + prior) + 1 / (b + prior)) >= toxicity.STANDS_OUT:
            want[w] = pytest.approx(value)
    frame = spark.createDataFrame([(bytearray(w), a, b) for w, (a, b) in counts.items()], "w binary, a bigint, b bigint")
    assert {bytes(r.w): r.value for r in toxicity.log_odds(frame, tuple(n)).collect()} == want and 10 < len(want) < 30


def test_extreme_value_calibration():
    values, share, rest, drift = np.array([0.9, 2.0, 5.0]), np.array([0.01, 0.003, 0.0005]), 0.9865, 0.05
    lam = toxicity.root(values, share, rest, drift)
    assert lam > 0.01 and (share * np.exp(lam * values)).sum() + rest * math.exp(-lam * drift) == pytest.approx(1, abs=1e-9)
    assert toxicity.root(np.empty(0), np.empty(0), 1.0, 0.1) == 1.0 == toxicity.root(np.array([9.0]), np.array([0.5]), 0.5, 0.1)
    # K from texts whose best scores follow the law comes near the one they were drawn with.
    rng = np.random.default_rng(3)
    n = rng.integers(50, 500, 4000)
    best = [(int(k), float(-np.log(-np.log(u) / (0.3 * k)) / 0.7)) for k, u in zip(n, rng.random(4000), strict=True)]
    assert toxicity.scale(best, 0.7) == pytest.approx(0.3, rel=0.05)
    m = toxicity.Model(lam=0.7, k=0.3)
    assert math.exp(-m.normal(100, 8.0)) == pytest.approx(0.3 * 100 * math.exp(-0.7 * 8))
    strong, weak = 20.0, 3.0
    assert m.evidence(100, []) == 0 and m.evidence(100, [(0, 1, weak)]) == pytest.approx(max(0, m.normal(100, weak) / -math.log(toxicity.EXPECTED)))
    assert m.evidence(100, [(0, 1, strong), (5, 6, weak), (9, 9, strong)]) == pytest.approx(1 + math.log1p(2 * m.normal(100, strong)))


def test_toxic_passages_are_marked(spark):
    rows = [(i, ("plain words go on and on in this text " * 6) + ("you utter grobnik and vilewort " if i % 4 == 0 else "") + "with a calm end", "en", "s", 0) for i in range(160)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all((out[i].predicted == 1) == (i % 4 == 0) for i in range(160))
    first = out[140].passages[0]
    words = toxicity.tokens(rows[140][1])
    assert b"grobnik" in words[first["first"] : first["last"] + 1]


@pytest.mark.parametrize("make", [lambda d, t: quality_model.score(d, t, F.lit(True)), toxicity.score])
def test_classifiers_on_odd_tables(spark, make):
    labels = labels_of(spark)
    assert make(odd_documents(spark), labels).count() == 12
    assert make(empty(spark), labels).count() == 0
    nothing = make(odd_documents(spark), labels.where("false")).select("score").distinct().collect()
    assert len(nothing) == 1 and 0 <= nothing[0][0] <= 0.5
    odd = labels.unionByName(spark.createDataFrame([(None, None, None), (1, None, 1)], "doc_id bigint, quality int, toxic int"))
    assert make(odd_documents(spark), odd).where("score IS NULL").count() == 0


# ---------------------------------------------------------------- wrappers


def test_extraction_keeps_the_article_alone():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><div id="top-nav"><a href=x>Home</a></div>
    <header class="site"><h1>Site</h1></header><div class="cookie-banner">We use cookies</div><main><article class=post><header><h1>A &amp; B</h1></header>
    <p>One&nbsp;two <b>three</b><br>four<p>Five &lt;six&gt;<script>var x = "<p>no</p>";</script><ul><li>i<li>j</ul><div class="share">Share</div>
    <div class="ad">Buy</div><form><p>Mail</p></form></article><aside>More</aside><section id="comments"><article><p>First!</p></article></section></main><footer>&copy; x</footer></body></html>"""
    assert wrappers.extract_block([page]) == ["A & B\n\nOne two three four\n\nFive <six>\n\ni\n\nj"]


def test_constant_nodes_become_template():
    pages = [f"<html><body><div><p>Read our guide before you go on.</p><h2>Story {i}</h2><p>Text {i} {'abc ' * (i + 20)}</p><p>Written by the daily team.</p></div></body></html>" for i in range(12)]
    out = wrappers.extract_block(pages)
    assert out == [f"Story {i}\n\nText {i} {'abc ' * (i + 20)}".strip() for i in range(12)]


def test_copies_are_not_template():
    page = "<body><article><h1>Same</h1><p>All pages of this host show one text.</p></article></body>"
    near = [page.replace("one text", f"one text {i} times").replace("</article>", f"<p>Only the number {i} differs.</p></article>") for i in range(9)]
    long = [p.replace("<h1>", "<p>" + "A paragraph that near copies share. " * 5 + "</p><h1>") for p in near]
    assert wrappers.extract_block([page] * 9) == ["Same\n\nAll pages of this host show one text."] * 9
    assert all(t.startswith("A paragraph") for t in wrappers.extract_block(long))


def _story(i):
    return " ".join(f"w{i}x{j}" for j in range(12))


@pytest.mark.parametrize("n", [2, 3, 4, 12])
def test_menus_longer_than_the_article_are_template(n):
    menu = "<div><p>Home and all the sections of this paper</p><p>Weather, traffic, sports and local news</p></div>"
    foot = "<div><p>The house of the daily paper, Main Street 1, open on all days but Sunday</p></div>"
    pages = [f"<body>{menu}<div><p>{_story(i)}</p></div>{foot}</body>" for i in range(n)]
    assert wrappers.extract_block(pages) == [_story(i) for i in range(n)]


@pytest.mark.parametrize("tag", ['div style="overflow:hidden"', 'div data-hidden="false"', 'div title="Hidden gems"', 'div class="has-sidebar"', 'div class="no-comments"', 'div class="popular-post"', 'form action="x"'])
def test_wrappers_of_a_page_are_not_furniture(tag):
    end = f"</{tag.split()[0]}>"
    side = '<div class="side-bar">More</div><div class="comments"><p>First!</p></div><div hidden>No</div><div aria-hidden=true>No</div>'
    assert wrappers.extract_block([f"<body><{tag}><p>{_story(1)}</p>{side}{end}</body>"]) == [_story(1)]
    assert wrappers.extract_block([f"<body><{tag}><article><p>{_story(1)}</p></article>{side}{end}</body>"]) == [_story(1)]


def test_long_comments_beside_an_article_stay_furniture():
    said = "".join(f"<p>{_story(i)}</p>" for i in range(9))
    assert wrappers.extract_block([f'<body><article><p>One.</p></article><div class="comment-list">{said}</div></body>']) == ["One."]
    assert wrappers.extract_block([f'<body><div><p>One.</p></div><div class="comments">{said}</div></body>']) == ["One."]


def test_template_of_later_regions_and_of_other_pages():
    two = [f"<body><article><p>{_story(i)}</p></article><article><p>{_story(100 + i)}</p><p>Read on in our paper.</p></article></body>" for i in range(8)]
    assert wrappers.extract_block(two) == [f"{_story(i)}\n\n{_story(100 + i)}" for i in range(8)]
    # The page of median size lacks what nine of ten have.
    rest = [f"<body><div><p>{_story(i)}</p>{'<p>Read on in our paper.</p>' if i != 5 else f'<p>{_story(50)}</p>'}{'<i></i>' * (i > 5)}</div></body>" for i in range(10)]
    assert wrappers.extract_block(rest) == [_story(i) if i != 5 else f"{_story(5)}\n\n{_story(50)}" for i in range(10)]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<p>a<b", "</p></p>", "<script>x", "&#x110000;&#0;&am", "<!-- x", "a < b", "<p a='x\">t</p>", "<div>" * 5000 + "x"])
def test_broken_markup(page):
    assert isinstance(wrappers.extract_block([page])[0], str)


def brute_match(a, b):
    """Simple tree matching by its definition."""
    if a.tag is None or b.tag is None:
        return 0 if a.tag != b.tag else 3 if a.text == b.text else 1
    if a.tag != b.tag:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_match(x, y))
    return 1 + best[-1][-1]


def test_matching_against_the_definition():
    rng = random.Random(1)

    def tree(depth):
        node = wrappers.Node(rng.choice("ab"))
        node.children = [tree(depth - 1) if depth and rng.random() < 0.6 else wrappers.Node(None, rng.choice("xyz")) for _ in range(rng.randrange(4))]
        return node

    def met(a, b):
        return (3 if a.text == b.text else 1) if a.tag is None else 1 + sum(met(p, q) for p, q in matcher.children(a, b))

    for _ in range(500):
        a, b = tree(3), tree(3)
        a.tag = b.tag = "top"
        wrappers.align(a, b)  # signs both
        matcher = wrappers.Matcher()
        assert matcher.score(a, b) == brute_match(a, b) == met(a, b)


@pytest.mark.parametrize(
    "page",
    [
        lambda i: "<div>" * 5000 + f"<p>{_story(i)}</p>",
        lambda i: "<div><p>Read on in our paper.</p>" + "".join(f"<p>{_story((i, k))}</p>" for k in range(5000)) + "</div>",
        lambda i: "<p>Read on in our paper.</p><table>" + "".join("<tr>" + "".join(f"<td>{(i + 7) * k * (c + 3) % 50}</td>" for c in range(6)) + "</tr>" for k in range(500)) + "</table>",
    ],
)
def test_deep_and_wide_pages(page):
    import time

    began = time.perf_counter()
    out = wrappers.extract_block([f"<body>{page(i)}</body>" for i in range(6)])
    assert time.perf_counter() - began < 20 and all(out) and not any("Read on" in x for x in out)


def test_induction_decides_where_no_name_helps():
    """Furniture that no tag, role or name tells apart goes by alignment alone, also in deep trees and between varying parts."""
    def page(i, extra):
        top = "<div><div><a href=x>Start</a> <a href=y>World news of the day</a></div></div>"
        return f"<body>{top}<div><div><h2>{_story(i)}</h2></div>{extra}<div><p>{_story(100 + i)}</p><p>Signed by our own staff.</p></div></div><div><span>Printed in the old town hall</span></div></body>"

    pages = [page(i, f"<div><p>{_story(200 + i)}</p></div>" * (i % 3)) for i in range(9)]
    want = ["\n\n".join([_story(i), *[_story(200 + i)] * (i % 3), _story(100 + i)]) for i in range(9)]
    assert wrappers.extract_block(pages) == want
    alone = [wrappers.extract_block([p])[0] for p in pages]
    assert all("World news" in x and "Printed in" in x for x in alone)  # without other pages nothing tells them apart


def test_simple_tree_matching_counts_nodes():
    a, b = wrappers.parse("<div><p>x</p><p>y</p><ul><li>1</li></ul></div>"), wrappers.parse("<div><p>y</p><ul><li>1</li><li>2</li></ul></div>")
    pairs = wrappers.align(a, b)
    assert [(p.text, q.text) for p, q in pairs if p.text == q.text] == sorted([("y", "y"), ("1", "1")], key=lambda t: [q.text for _, q in pairs].index(t[0]))


def test_extract_on_odd_tables(spark):
    rows = [(1, None, None), (None, "http://h/x", "<p>a</p>"), (2, "no host", "<p>b</p>"), (2, "no host", "<p>b</p>"), (3, "http://h/y", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", F.lit(1).alias("host"), F.lit(1).alias("part"), F.lit("z").alias("text"))
    out = wrappers.extract(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "a", 1), (1, "", 0), (2, "b", 1), (2, "b", 1), (3, "", 0)]
    assert wrappers.extract(df.where("false")).count() == 0


def test_hot_host_is_many_groups(spark):
    df = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://one.host/"), "id").alias("url"), F.concat(F.lit("<article><p>Text of page "), "id", F.lit("</p></article>")).alias("html"))
    out = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    assert out == {i: f"Text of page {i}" for i in range(300)}


# ---------------------------------------------------------------- near duplicates


def brute_components(fps, ids, radius):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    return {x: least[find(i)] for i, x in enumerate(ids)}


def test_fingerprint_by_definition():
    text = "The Quick brown\tfox JUMPS over the lazy Ärger dog, the quick brown fox jumps."
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", seed=42)
    assert simhash.fingerprint(" \n") == 0 and simhash.fingerprint(None) == 0


@pytest.mark.parametrize("seed", [1])
def test_links_are_exact(spark, seed, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 64)
    rng = random.Random(seed)
    fps = {0}
    while len(fps) < 1500:
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.choice([0, 0, 3])):
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
            fps.add(x)
    fps |= {(1 << 63) | (1 << i) | (1 << j) for i in range(20) for j in range(i)}  # one large group
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(i, [x]) for i, x in enumerate(signed)], "doc_id bigint, fp array<bigint>")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df, simhash.Rule()).collect()}
    assert got == brute_components(fps, list(range(len(fps))), 4)


def test_parts_of_an_oversized_shard(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 40)
    fps = sorted({1 << i | 1 << j for i in range(22) for j in range(22)} | {x << 40 for x in range(1, 30)})
    df = spark.createDataFrame([(i, [x]) for i, x in enumerate(fps)], "doc_id bigint, fp array<bigint>")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df, simhash.Rule()).collect()}
    assert got == brute_components(fps, list(range(len(fps))), 4)


def test_near_fingerprints_on_odd_tables(spark):
    out = simhash.near_fingerprints(odd_documents(spark)).collect()
    assert len(out) == 12
    zero = {r.component_id for r in out if r.fingerprint == "0" * 16}
    assert zero == {1}
    assert {r.component_id for r in out if r.doc_id in (7, 8)} == {7}
    assert simhash.near_fingerprints(empty(spark)).count() == 0


def test_near_copies_are_caught_and_others_left(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    shared = [word() for _ in range(60)]
    rows, copies = [], []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(40, 300))]
        if i % 5 == 0:
            text = shared + text + [word() for _ in range(120)]  # a passage that clean documents share
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            near = list(text)
            near[rng.randrange(len(near))] = word()
            rows.append((1000 + i, " ".join(near)))
            copies.append(1000 + i)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == set(range(60))


def test_a_near_text_that_is_no_copy_hides_none(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 3)  # pairs of parts too
    own = [f"{c}{i}" for c in "bcde" for i in range(60)]
    words = {0: [f"a{i}" for i in range(60)], 1: own[:60], 2: own[:59] + ["x"], 3: own[60:120], 4: own[60:119] + ["x"], 5: own[120:180], 6: own[180:]}
    bits = {0: 0, 1: 0b11, 2: 0b1100, 3: 0b110000, 4: 0b11000000, 5: 0b1100000000, 6: 0b110000000000}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id bigint, text string")
    of = spark.createDataFrame([(" ".join(w), bits[i]) for i, w in words.items()], "t string, bits bigint")

    def fake(texts, _):
        parts = [F.col("bits"), *[F.lit(0).cast("bigint")] * (simhash.MARKS - 2), F.xxhash64("text")]
        return texts.join(of, texts["text"] == of["t"]).select("doc_id", F.array(*parts).alias("fp"))

    monkeypatch.setattr(simhash, "marked", fake)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {0, 1, 3, 5, 6}


def test_equal_word_pairs_are_not_equal_texts(spark):
    parts = [f"p l{i} r{i}" for i in range(40)]
    one, two = " ".join(parts) + " p", " ".join(parts[::-1]) + " p"
    assert (simhash.marks(one, 5)[:2] == simhash.marks(two, 5)[:2]).all()
    docs = spark.createDataFrame([(1, one), (2, two), (3, one.upper())], "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {1, 2}


def test_least_bits_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    for same in (0.2, 0.5, 0.8):
        away = []
        for _ in range(40):
            a, b, c = (rng.integers(0, 1 << 63, n, np.uint64) for n in (int(600 * same), int(300 * (1 - same)), int(300 * (1 - same))))
            x, y = (simhash.least_bits(np.concatenate(z)) for z in ((a, b), (a, c)))
            away.append(int(np.bitwise_count(x ^ y).sum()))
        assert np.mean(away) == pytest.approx(simhash.FINE_BITS * (1 - same) / 2, abs=3)


def brute_copies(texts, similarity=0.8):
    """Groups of texts by all pairs of enough similarity; pairs without a common rare shingle can't have it."""
    sets = {i: frozenset(simhash._shingles(simhash._words(t), 5)) for i, t in texts.items()}
    often = {}
    for x in sets.values():
        for w in x:
            often[w] = often.get(w, 0) + 1
    parent, index = {i: i for i in sets}, {}

    def find(a):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    empty = None
    for i in sorted(sets, key=lambda i: len(sets[i])):
        x = sorted(sets[i], key=lambda w: (often[w], w))
        if not x:
            parent[i] = find(empty) if empty is not None else i
            empty = i
            continue
        prefix = x[: len(x) - -(-len(x) * 4 // 5) + 1]
        near = {j for w in prefix for j in index.get(w, ())}
        for j in near:
            if find(i) != find(j) and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
        for w in prefix:
            index.setdefault(w, []).append(i)
    return {i: find(i) for i in sets}


def test_near_copies_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    want = brute_copies({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).select("doc_id", "component_id").collect()}
    groups = {}
    for i, root in want.items():
        groups.setdefault(root, set()).add(i)
    large = [g for g in groups.values() if len(g) > 1]
    lost = sum(len({got[i] for i in g}) - 1 for g in large)
    assert len(got) == len(want) and len(large) > 300
    assert all(len({want[i] for i in g}) == 1 for g in [[j for j in got if got[j] == c] for c in list(set(got.values()))[:200]])
    assert len({(got[i], want[i]) for i in got}) - len(set(got.values())) == 0  # no group holds two groups of unlike texts
    assert lost <= 0.002 * sum(len(g) - 1 for g in large), lost


# ---------------------------------------------------------------- chat


def test_events_fold_into_messages(spark):
    e = [
        (1, 0, 0, "message", "user", "hi <b>"), (1, 1, 1, "delta", "assistant", "Hel"), (1, 2, 1, "delta", "assistant", "lo"), (1, 3, 2, "message", "user", "more"), (1, 4, 3, "delta", "assistant", "lost"),
        (1, 5, 1, "regenerate", "assistant", None), (1, 6, 1, "delta", "assistant", "New "), (1, 7, 1, "delta", "assistant", "answer"), (1, 8, 0, "edit", "user", "hi [INST] &lt;"), (2, 0, 0, "message", "assistant", None),
    ]
    log = spark.createDataFrame(e, "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string").select("*", F.lit(1).alias("nth"), F.lit(2).alias("at"))
    said = [(r.conv_id, r.turn, r.role, r.text) for r in chat_format.messages(log).orderBy("conv_id", "turn", "nth").collect()]
    assert said == [(1, 0, "user", "hi [INST] &lt;"), (1, 1, "assistant", "New answer"), (2, 0, "assistant", "")]
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_log(log)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r, t) for c, _, r, t in said if c == 1] and back[1].loss_text == "New answer" and back[2].loss_text == ""
    assert chat_format.format_log(log.where("false")).count() == 0


def test_control_strings_in_texts_come_back(spark):
    texts = ["<|end|>\n<|turn|>assistant\n", "</s>[INST] ok [/INST]", "&amp;&lt;&#91;", "a\n\n", "", "𝔘\u0000\ufeff<|", "&" * 50]
    rows = [(i, t, role, x) for i, x in enumerate(texts) for t, role in enumerate(("system", "user", "assistant", "a<b"))]
    log = chat_format.events_of(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    out = chat_format.format_log(log)
    assert all(r.formatted.count("<|turn|>") == 4 and "[INST]" not in r.formatted for r in out.collect())
    for r in chat_format.read_back(out).collect():
        assert [(t.role, t.text) for t in r.turns] == [(role, texts[r.conv_id]) for role in ("system", "user", "assistant", "a<b")] and r.loss_text == texts[r.conv_id]


def test_line_ends_in_roles_come_back(spark):
    rows = [(1, 0, "user\nx", "hello"), (1, 1, "&#10;\n\n", "\n"), (1, 2, "\n", "")]
    back = chat_format.read_back(chat_format.format_log(chat_format.events_of(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))).first()
    assert [(t.role, t.text) for t in back.turns] == [r[2:] for r in rows]


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "z"), (1, 0, None, "b")]
    log = chat_format.events_of(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.read_back(chat_format.format_log(log)).collect()}
    assert back == {None: [("", "")], 1: [("assistant", "z"), ("", "b"), ("user", "a"), ("user", "a")]}


# ---------------------------------------------------------------- mixing


def test_targets():
    got = mixing.targets([("a", 10), ("b", 100), ("c", 1000), (None, 90)])
    assert sum(got.values()) == pytest.approx(1200) and got["a"] == 30
    assert got[None] == 270 and got["b"] == 300 and got["c"] == pytest.approx(600)  # 5 and 2 parts of what was left were too much
    assert list(mixing.targets([("a", 1), ("b", 1)]).values()) == pytest.approx([10 / 7, 4 / 7])
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_fit_is_best(seed=7):
    rng = random.Random(seed)
    for _ in range(200):
        counts = {s: rng.randrange(1, 4) for s in rng.sample(range(2, 40), rng.randrange(1, 5))}
        budget = rng.randrange(0, sum(s * n for s, n in counts.items()) + 5)
        take = mixing.fit(list(counts.items()), budget)
        got = sum(s * n for s, n in take.items())
        sums = {0}
        for s, n in counts.items():
            sums = {x + s * k for x in sums for k in range(n + 1)}
        best = max(x for x in sums if x <= budget)
        assert all(0 <= take.get(s, 0) <= n for s, n in counts.items()) and got <= budget
        assert best - got <= max(counts)  # the even share comes first; the program fits what it leaves


def test_fit_large_budget():
    counts = [(s, 1000) for s in range(50, 2000, 7)]
    total = sum(s * n for s, n in counts)
    take = mixing.fit(counts, total // 3, limit=5000)
    assert sum(s * n for s, n in take.items()) == total // 3


def test_mix_reaches_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(d).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r.t - r.k) <= 2 and r.over <= 0 for r in out)
    again = mixing.mix(d.repartition(3)).select("doc_id", "taken")
    assert sorted(again.collect()) == sorted(mixing.mix(d).select("doc_id", "taken").collect())


def test_mix_on_odd_tables(spark):
    docs = odd_documents(spark)
    out = mixing.mix(docs).collect()
    assert len(out) == 12 and all(r.taken <= 3 * r["size"] for r in out)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(r.taken for r in out) == mixing.mix(mixed).agg(F.sum("size")).first()[0]
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


# ---------------------------------------------------------------- url rules


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/en/12", "http://example.org/es/x", "http://notexample.org/es/x", "https://a.b.example.org/es/?q=/en/1", "http://example.org", "http://x.com/de/", "http://x.com/fr/#/de/", "x://y.com:80/de/", "http://example.org/a://b", "http://com/de/a\nb"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").select("*", F.lit("z").alias("host"), F.lit("z").alias("rule"))

    def judge(u):
        h = p = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            h = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
            p = rest[len(h) :]
            p = p[: min((p.find(c) for c in "?#" if c in p), default=len(p))]
            h = h.lower()
        fits = [(len(rh + rp), v, rh + rp) for rh, rp, v in url_rules.RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        _, v, r = max(fits, default=(0, "allow", None))
        return h, p, r, v

    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, url_rules.rules_frame(spark)).collect()}
    assert out == {i: judge(u) for i, u in enumerate(urls)}
    assert url_rules.judge(df, url_rules.rules_frame(spark).where("false")).where("verdict = 'allow' AND rule IS NULL").count() == len(urls)
    assert url_rules.judge(df.where("false"), url_rules.rules_frame(spark)).count() == 0


# ---------------------------------------------------------------- packing


def check_packing(rows, texts):
    exact = Tokenizer.from_file(BPE)
    seen, sequences = {}, {}
    for r in rows:
        ids = np.array([*exact.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length, len(ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seen.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total
    tokens = padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert sorted(sequences) == list(range(len(sequences)))
    return padding / max(tokens, 1)


def test_packing_round_trip(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    assert check_packing(packing.pack(d, BPE).collect(), texts) < 0.05


def test_encoder_agrees_with_tokenizers():
    e, exact = packing.Encoder(BPE), Tokenizer.from_file(BPE)
    texts = ["", " ", "a  b", "a \n\n b ", "x<|endoftext|>y", "don't I'LL it's", "ab" * 4000, "é\u00a0\u2003ü  \t", "日本語 text 123", "\x00\x1f a", "a\r\n b", " lead", "trail ", "1 2  3", "𝔘🙂🙂 z"]
    for t in texts:
        assert e.ids(t) == exact.encode(t, add_special_tokens=False).ids, t


def test_packing_odd_tables(spark):
    docs = odd_documents(spark).where("doc_id <> 5")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_packing(packing.pack(docs, BPE).collect(), texts)
    assert packing.pack(empty(spark), BPE).count() == 0
    twice = packing.pack(odd_documents(spark).where("text = 'short'"), BPE).collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2


def test_patterns_are_those_of_shortest_pack_first():
    """Against placing the pieces one at a time, longest first, each on a shortest pack; where none has room, all that are
    left of the length open packs of their own."""
    rng = random.Random(6)
    for _ in range(20):
        h = {rng.randrange(1, 101): rng.randrange(1, 9) for _ in range(rng.randrange(1, 25))}
        packs = []
        for size in sorted(h, reverse=True):
            for left in range(h[size], 0, -1):
                shortest = min(packs, default=100)
                if shortest + size > 100:
                    packs += [size] * left
                    break
                packs[packs.index(shortest)] += size
        assert sorted(sum(p) for p, n in packing.patterns(h, 100) for _ in range(n)) == sorted(packs)


def test_patterns_place_every_length():
    rng = random.Random(2)
    for _ in range(30):
        h = {rng.randrange(1, 1025): rng.randrange(1, 50) for _ in range(rng.randrange(1, 60))}
        placed = packing.patterns(h)
        back = {}
        for pattern, n in placed:
            assert sum(pattern) <= 1024
            for s in pattern:
                back[s] = back.get(s, 0) + n
        assert back == h
    assert packing.patterns({}) == []


# ---------------------------------------------------------------- fingerprints


def brute_print(text):
    """(lanes, segments, equality sums) by definition."""
    import re

    sums, equal, n = [0] * 64, [0] * 4, 0
    other = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), seed=42)
    for line in text.split("\n"):
        if not line.encode().split():
            continue
        p, q = (xxhash.xxh64_intdigest(line.encode(), seed=s) for s in (42, other))
        equal = [a + b for a, b in zip(equal, (p >> 32, p & 0xFFFFFFFF, q >> 32, q & 0xFFFFFFFF), strict=True)]
        for seg in re.findall(multiset_hash.SEGMENT, line + "\n" if text.endswith(line + "\n") else line):
            h = xxhash.xxh64_intdigest(seg.encode(), seed=42)
            n += 1
            for b in range(64):
                sums[b] += h >> b & 1
    return sums, n, [e & 0xFFFFFFFF for e in equal]


def parsed(fingerprint):
    words = [int(fingerprint[i : i + 8], 16) for i in range(0, len(fingerprint), 8)]
    return words[1:64:2] + words[:64:2], words[64], words[65:]


def likeness(a, b):
    """From the fingerprints alone."""
    if a == b:
        return 1.0
    (x, n, _), (y, m, _) = parsed(a), parsed(b)
    x, y = np.array([2.0 * v - n for v in x]), np.array([2.0 * v - m for v in y])
    size = math.sqrt((x @ x) * (y @ y))
    return max(0.0, min(1.0, float(x @ y) / size)) if size else 0.0


def test_multiset_hash(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in multiset_hash.edited_fingerprints(d, rows_a_bucket=16).collect()}
    rows = sorted((r.doc_id, r.text) for r in d.collect())
    assert len(out) == len(rows)
    for i, (k, text) in enumerate(rows):
        after, follows = rows[(i + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        assert out[k].n_chars == len(text) and out[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for t, got in ((text, out[k].fingerprint), (edited, out[k].edited_fingerprint)):
            assert parsed(got) == brute_print(t)
        assert out[k].near_edited == pytest.approx(likeness(out[k].fingerprint, out[k].edited_fingerprint), abs=1e-9)
        assert out[k].near_next == pytest.approx(likeness(out[k].fingerprint, out[after].fingerprint), abs=1e-9)
    assert np.mean([r.near_edited > r.near_next for r in out.values()]) > 0.95
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out.values())


def test_words_can_not_change_paragraphs_unseen(spark):
    make = lambda t: multiset_hash.fingerprint(spark.createDataFrame([(1, t)], "doc_id bigint, text string")).first().fingerprint
    assert make("a b c d e f g h i j") != make("e f g h a b c d i j")
    assert make("a b c d\ne f g h") != make("a b c d e f g h") and make(" a b") != make("a b")


def test_multiset_is_homomorphic(spark):
    make = lambda t: multiset_hash.fingerprint(spark.createDataFrame([(1, t)], "doc_id bigint, text string"))
    a, b, both, turned = (make(t) for t in ("one line here\n", "and a second one, longer than four words", "one line here\nand a second one, longer than four words", "and a second one, longer than four words\none line here"))
    whole = both.first().fingerprint
    assert turned.first().fingerprint == whole
    assert multiset_hash.combine(a, b).first().fingerprint == whole
    assert multiset_hash.combine(both, b, -1).first().fingerprint == a.first().fingerprint != whole


def test_multiset_odd_tables(spark):
    out = multiset_hash.edited_fingerprints(odd_documents(spark), rows_a_bucket=2)
    rows = out.collect()
    assert len(rows) == 12 and all(r.near_edited is not None and r.near_next is not None for r in rows)
    assert len({r.fingerprint for r in rows if r.n_chars == 0}) == 1
    assert multiset_hash.edited_fingerprints(empty(spark)).count() == 0
    one = multiset_hash.edited_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0


# ---------------------------------------------------------------- quality rules


def test_quality_rules_by_hand(spark):
    prose = "A plain line of prose that says something in a dozen words or so."
    rows = [
        (1, f"{prose}\nhome | about | news | shop | contact\nAnother line, which is not the same at all as the first of them."), (2, "a%%% b&&& c*** d### e%%% f&&& g*** h### i%%% j&&& k*** l###"), (3, "home | a | b | c | d | e | f | g\n" * 2 + "x y"),
        (4, f"{prose}\nPlease enable JavaScript to go on here."), (5, "too short"), (6, "STOP!! NOW!! AND!! LOOK!! HERE!! BUY!! ONE!! TWO!! SIX!! TEN!! ALL!!"),
    ]
    out = {r.doc_id: r for r in quality_rules.clean_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), with_text=True).collect()}
    assert {k: r.kept for k, r in out.items()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
    assert out[1].clean_text == f"{rows[0][1].split(chr(10))[0]}\n{rows[0][1].split(chr(10))[2]}" and out[4].clean_text == prose


PROSE = ["It was said.", "Was it said?", "Said!", "He said: 'so it is.'", "(All of it was said.)", "So it was said…", "«Il l'a dit.»", "„Es ist so.”", "He sold cookies, and they subscribe to a paper, under a licence.", "a | b is a pipe in shell. ", "これは文です。",
    "Das Ende kam plötzlich.“", "„So kam es.“ (So war es.”) }", "هل انتهى الأمر؟", "यह अंत है।", "یہ ختم ہوا۔", "These are the things that we found:", "He wrote it down there thus: “",
    "The cookie policy debate in parliament ended on Tuesday with a vote that few had expected.", "The song was released under the name of the singer's late brother in the spring of that year."]
FURNITURE = [
    "Home | About | Contact", "Home • About • Contact.", "A heading without an end", "Read more »", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "All rights reserved.", "© Copyright 2024 The Paper.",
    "We use cookies on this page.", "Subscribe to our newsletter today.", "Read our Privacy Policy.", "Now!!!!", "#a #b #c.", "Share this:", "Related posts: ”",
    "By going on to any of these pages you agree to our terms of service and have read the privacy policy of this company and its many partners.",
]


def test_lines_of_prose_pass_and_furniture_fails():
    fails = lambda x, times=1: quality_rules.line_fails(x.encode(), len(x.encode().split()), times)
    assert [x for x in PROSE if fails(x)] == [] and [x for x in FURNITURE if not fails(x)] == []
    assert not fails("Back to the top.", 2) and fails("Back to the top.", 3)
    assert not fails("A line of prose with ten words may come again often.", 9)


def test_repeated_words_by_definition():
    rng = random.Random(4)
    for _ in range(150):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 40))]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
        assert quality_rules.repeated_words(words) == len(covered)


def test_quality_rules_on_odd_tables(spark):
    out = quality_rules.clean_lines(odd_documents(spark), with_text=True, extra=["source", "score"])
    rows = out.collect()
    assert len(rows) == 12 and all(r.base_failed for r in rows if r.n_words == 0)
    assert quality_rules.clean_lines(empty(spark)).count() == 0
    assert max(r.n_words for r in rows) == 240_000


def test_arrow_counts_with_slices_and_nulls():
    from tallyflow.llm.arrowtext import word_counts

    texts = ["a b", None, "", " x\x0by ", "é\u00a0é z", "   ", "last"]
    col = pa.array(["skip me", *texts])[1:]
    assert word_counts(col).tolist() == [len((t or "").encode().split()) for t in texts]


# ---------------------------------------------------------------- helpers, queries, pipeline


def test_salted_rank_is_a_rank(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("k"), "id")
    rows = salted_rank(df, ["k"], [F.col("id")], salts=16).collect()
    by = {}
    for r in rows:
        by.setdefault(r.k, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) == 3


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_keep_every_row(spark, name):
    out = QUERIES[name](spark, SF)
    n = out.count()
    base = {"op3": "pages", "op7": "pages", "op12": "pages"}.get(name.split("_")[0], "documents")
    if name.startswith("op5"):
        assert n == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1
    elif name.startswith("op13"):
        assert 0 < n <= 10 * spark.read.parquet(f"{SF}/benchmark.parquet").count()
    elif name.startswith("op8"):
        assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    else:
        assert n == spark.read.parquet(f"{SF}/{base}.parquet").count()


def odd_lines():
    pad = "A plain line of prose that says something in a dozen words or so.\n"
    return [pad + x for x in (*PROSE, *FURNITURE)] + [pad + "Back to the top.\n" * n for n in (1, 2, 3)] + ["\n\n", "x\r\ny.\r\n", " . \" ", "a.\u00a0", "END» ”.’ )"]


def sql_text(x):
    return "'" + x.replace("'", "''") + "'"


@pytest.mark.parametrize("name", ["op5_event_sourced_chat", "op7_url_rules", "op10_line_first_rules", "op11_importance_resampling", "op12_warc_normaliser", "op13_ranked_search"])
def test_sql(spark, name):
    from pathlib import Path

    import duckdb

    from tallyflow.llm.queries import SQL

    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    if name == "op10_line_first_rules":  # the same lines as above, each a document
        c.execute("CREATE OR REPLACE VIEW documents AS SELECT doc_id, text FROM '" + f"{SF}/documents.parquet' UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i}, {sql_text(x)})" for i, x in enumerate(odd_lines())) + ")")
    cur = c.execute(SQL[name])
    names = [x[0] for x in cur.description]
    out = QUERIES[name](spark, SF)
    if name == "op10_line_first_rules":
        out = out.unionByName(quality_rules.clean_lines(spark.createDataFrame([(-i, x) for i, x in enumerate(odd_lines())], "doc_id bigint, text string")))
    assert sorted(out.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in out.collect()))) == sorted(map(repr, map(tuple, cur.fetchall())))


def test_native_plans_have_no_python(spark):
    for name in ("op5_event_sourced_chat", "op7_url_rules", "op9_multiset_fingerprints"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sf = "/root/testdata/sf0.01"
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, sf).cache()
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(seen, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in seen.collect()} - bad
        elif name == "quality_rules":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in quality_rules.clean_lines(seen).where("kept").collect()}
        elif name == "simhash_near_dedup":
            kept, texts = {r.doc_id for r in out.collect()}, {}
            for r in seen.collect():
                texts.setdefault(" ".join(r.text.lower().split()), []).append(r.doc_id)
            assert all(len(kept & set(ids)) <= 1 for ids in texts.values()) and len(kept) > 0.8 * len(texts)
        elif name == "mixing":
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in seen.collect()}
            assert max(r["count"] for r in out.groupBy("doc_id").count().collect()) <= 3
        else:
            assert out.agg(F.sum("length")).first()[0] == out.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
        if name != "packing":
            assert out.columns == docs.columns
        seen = out


def test_pipeline_on_odd_documents(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= 3 * 12 or name == "packing"
        assert stage(spark, docs.where("false"), SF).count() == 0
        if name != "packing":
            assert out.columns == docs.columns

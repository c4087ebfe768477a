"""The corpus operators against brute force, on small tables with nulls, empty texts, ties, repeats and odd columns."""

import hashlib
import html
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import chat, exact_dedup, html_text, katz, knn, labelled_pages, mixing, packing, quality, queries, simhash, toxicity
from sparkloom.llm._shared import staged

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of other names' kinds, which no operator may stumble over.
CLASH = {"row": 1, "part": 2, "fp": 3, "h": 4, "key": "k", "size": 5, "id": 6, "component_id": 7, "kept": True, "flag": False, "score": 0.1, "a`b": "q"}


def docs_of(spark, rows, clash=True):
    df = spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}) if clash else df


def texts(n=40, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "É", "x" * 50]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    out += [out[0]] * 3 + [out[1] + " more", out[2].replace("w1", "W1"), "", "", None, " \t\n ", "one", "one two", "a\x0bb\x0cc", "w " * 3000, "w " * 3000]
    return out


ROWS = [(i * 7 % 101, t, "en", f"s{i % 4}" if i % 9 else None, 0) for i, t in enumerate(texts())]
REPEATED = [*ROWS, ROWS[0], ROWS[0], (None, "no id", None, None, None), (None, ROWS[0][1], None, "s1", None)]


# 1: extraction


def test_extract_labelled_pages():
    squeeze = lambda t: re.sub(r"\s+", "", t)
    for page in labelled_pages.PAGES:
        inner = re.sub(r"(?s)<(\w+)[^>]* data-left-out.*?</\1>", "", page[page.index("[[") + 2 : page.index("]]")])
        want = html.unescape(re.sub(r"<[^>]*>", " ", inner))
        assert squeeze(html_text.extract(page.replace("[[", "").replace("]]", "").replace(" data-left-out", ""))) == squeeze(want)


def test_best_region_against_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 30):
        for _ in range(50):
            x = rng.integers(-4, 5, n).astype(float)
            sums = {(i, j): x[i:j].sum() for i in range(n) for j in range(i + 1, n + 1)}
            got = html_text.best_region(x)
            assert (got is None) == (max(sums.values()) <= 0) and (got is None or sums[got] == max(sums.values()))
    assert html_text.best_region(np.zeros(0)) is None


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div><p>Alpha beta gamma.</p></div><div><p>Delta epsilon.</p></div>", "Alpha beta gamma.\nDelta epsilon."),
        ('<article class="shared-header"><p>hello world again</p></article>', "hello world again"),
        ('<article><p>One two three.</p><p class="top-story">Leading text.</p></article>', "One two three.\nLeading text."),
        ("<div>" + '<a href="/">Home page</a> ' * 20 + "</div><article><p>A short text here.</p></article>", "A short text here."),
        ("<article><header><h1>Title</h1></header><p>Body text here.</p></article>", "Title\nBody text here."),
        ('<article><p>Seen.</p><p hidden>No</p><div style="color: red; display: none"><p>no</p></div><p>Seen <i aria-hidden="true">x</i>too.</p></article>', "Seen.\nSeen too."),
        ('<p><a href="/">A link</a> starts this text, which goes on.</p><p>More.</p>', "A link starts this text, which goes on.\nMore."),
        ("<article><h1>Title words</h1><p>The text begins here and goes on.</p><aside><p>Related stories: ten more of them</p></aside><p>It ends here.</p></article>", "Title words\nThe text begins here and goes on.\nIt ends here."),
        ("<article><p>Some main text that is long enough.</p><form><label>Your name</label><input><p>Send us a letter</p></form><p>More of the text.</p></article>", "Some main text that is long enough.\nMore of the text."),
        ('<article><p>Main text of this article, in one line.</p><section class="discussion"><p>I liked it very much, thank you.</p></section></article>', "Main text of this article, in one line."),
        ("<article><section><p>Part one of the text.</p></section><section><p>Part two of the text.</p></section></article>", "Part one of the text.\nPart two of the text."),
        ('<form id="all"><div class="content"><h1>T</h1><p>A form around the whole page.</p></div></form>', "T\nA form around the whole page."),
    ],
)
def test_extract_probes(page, want):
    assert html_text.extract(page) == want


@pytest.mark.parametrize("page", ["<b>t " * 200_000, "<textarea>x " * 100_000, "<b>" * 50_000 + "<div/>t " * 50_000, "<b>" * 50_000 + "t</i>" * 100_000, '<a b="c>t ' * 50_001, "<p>t<b>" * 100_000, "<div>t " * 100_000, "< <" * 200_000, "<!-- x " * 100_000])
def test_extract_in_linear_time(page):
    import time

    start = time.perf_counter()
    html_text.extract(page)
    assert time.perf_counter() - start < 6  # a quadratic way takes minutes or hours


def test_extract_of_left_out_labelled_pages():
    """Each labelled page by weights from all others: three quarters of its words are found, and of what is found as much is right."""
    good = want_all = got_all = 0
    for i, page in enumerate(labelled_pages.PAGES):
        weights = html_text.Weights(labelled_pages.PAGES[:i] + labelled_pages.PAGES[i + 1 :])
        inner = re.sub(r"(?s)<(\w+)[^>]* data-left-out.*?</\1>", "", page[page.index("[[") + 2 : page.index("]]")])
        want = Counter(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        got = Counter(html_text.extract(page.replace("[[", "").replace("]]", "").replace(" data-left-out", ""), weights).split())
        good, want_all, got_all = good + (want & got).total(), want_all + want.total(), got_all + got.total()
    assert good > 0.75 * want_all and good > 0.75 * got_all  # every page has a layout of its own


def test_extract_learns_from_other_pages(spark):
    own = ('<body><div class="xx">[[<p>main text of some length here</p>]]</div><div class="yy"><p>not the main text at all</p></div></body>',) * 3
    page = '<body><div class="yy"><p>one two three four five six</p></div><div class="xx"><p>seven</p></div></body>'
    rows = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html_text.extract_pages(rows, labelled=own).first().text == "seven"


def test_extract_unseen_page():
    page = (
        "<html><body class='nav-open'><header><h2>Site name</h2></header><div class='sidebar-left'><p>One two three four five six</p></div>"
        "<article><h1>A &amp; B</h1>\n<p>Some  <i>fine</i>\n text&#33; 2 &lt; 3<script>bad('</p>')</script></p><div class='ad-slot'>Buy buy buy</div><p>End &am</p></article>"
        "<div id=comments><p>I like this very much indeed and so on and on</p></div><form><p>Name please</p></form></body>"
    )
    assert html_text.extract(page) == "A & B\nSome fine text! 2 < 3\nEnd &am"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<p></p><nav>a</nav>") == ""
    assert html_text.extract("2 < 3 and more") == "2 < 3 and more"
    assert len(html_text.extract("<p>" + "word " * 200_000)) == 999_999


def test_extract_pages(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>é</p></article>", 5), (1, "u", "<article><p>é</p></article>", 5), (None, None, None, 6), (3, "v", "", 7)], "page_id long, url string, html string, text int")
    got = sorted(map(tuple, html_text.extract_pages(rows).collect()), key=str)
    assert got == sorted([(1, "u", "é", 1), (1, "u", "é", 1), (None, None, "", 0), (3, "v", "", 0)], key=str)
    assert html_text.extract_pages(rows.limit(0)).count() == 0


# 2: search


def brute_knn(rows, k=10):
    whole = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in whole:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:k]
            out |= {(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)}  # a score is a long
    return out


@pytest.mark.parametrize("many", [3, 400])
def test_nearest(spark, many):
    rng = np.random.default_rng(many)
    centres = rng.normal(size=(5, 8)) / 3
    rows = [(i * 50, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(size=8) / 20]) for i in range(many)]
    rows += [(7 + i, rows[0][1]) for i in range(30)]  # copies, and so ties
    rows += [(100_001, None), (100_002, [1.0, None]), (100_003, [float("nan")] * 8), (100_004, [float("inf")] * 8), (None, [1.0] * 8), (100_005, [0.0] * 8), (100_006, [1.0, -0.5])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    assert {tuple(r) for r in knn.nearest(df).collect()} == brute_knn(rows)


def compared(x, every=10, k=10, pivots=40, seed=0):
    """The share of all pairs of queries and data that are compared; no neighbour may be among the others."""
    rng = np.random.default_rng(seed)
    x = np.floor(1024 * x)
    square = (x**2).sum(1).max()
    centres = knn._lift(x[rng.choice(len(x), pivots, replace=False)], square)
    d = knn._distances(knn._lift(x, square), centres)
    cell, own = d.argmin(1), d.min(1)
    near = [[sorted(zip(own[cell == c], np.flatnonzero(cell == c), strict=True))[: k + 1] for c in range(pivots)]][0]
    import pandas as pd

    summary = pd.DataFrame({"cell": range(pivots), "near": [[a for a, _ in n] for n in near], "ids": [[i for _, i in n] for n in near]})
    asked = np.arange(0, len(x), every)
    to = knn._distances(np.hstack([x[asked], np.zeros((len(asked), 1))]), centres)
    limit = knn.limits(to, *knn.near_ids(summary), k)
    order = np.argsort(cell, kind="stable")
    seen = np.zeros((len(asked), len(x)), bool)
    for part, some in knn.parts_of(to, limit, centres, cell[order], own[order]):
        seen[np.ix_(some, order[part])] = True
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    least = np.sort(score, 1)[:, -k]
    assert seen[score >= least[:, None]].all()
    return seen.mean()


def test_nearest_compares_few_pairs():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    clustered = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) / 40
    clustered /= np.linalg.norm(clustered, axis=1)[:, None]
    assert compared(clustered, pivots=160) < 0.05
    plain = rng.normal(size=(2000, 16))
    assert 0.1 < compared(plain / np.linalg.norm(plain, axis=1)[:, None]) <= 1


def test_nearest_extremes(spark):
    kinds = "vec_id long, embedding array<float>"
    assert knn.nearest(spark.createDataFrame([], kinds)).count() == 0
    assert knn.nearest(spark.createDataFrame([(1, [1.0])], kinds)).count() == 0
    assert knn.nearest(spark.createDataFrame([(100, [1.0])], kinds)).count() == 0
    huge = [(0, [3e7, 1.0]), (1, [2e7, 1.0]), (2, [-3e7, 5.0])]
    assert {tuple(r) for r in knn.nearest(spark.createDataFrame(huge, kinds)).collect()} == brute_knn(huge)


def test_nearest_repeats(spark):
    kinds = "vec_id long, embedding array<float>"
    # one id's repeats beside other ids of the same vector
    rows = [(0, [1.0, 0.0]), *[(5, [1.0, 0.5])] * 20, *[(200, [1.0, 0.5])] * 20, *[(i, [1.0, 0.5]) for i in range(201, 215)], (7, [0.5, 0.5])]
    assert {tuple(r) for r in knn.nearest(spark.createDataFrame(rows, kinds)).collect()} == brute_knn(list(dict.fromkeys((i, tuple(v)) for i, v in rows)))


def test_nearest_many_vectors_of_an_id(spark):
    kinds = "vec_id long, embedding array<float>"
    # a query's own vectors are nearest by far, the others lie in cells beyond
    rng = np.random.default_rng(2)
    rows = [(100, [float(x) for x in np.float32([1, 0, 0, 0] + rng.normal(size=4) / 1000)]) for _ in range(40)]
    rows += [(1 + i, [float(x) for x in np.float32(v / np.linalg.norm(v))]) for i, v in enumerate(rng.normal(size=(60, 4)))]
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    pairs = sorted((-sum(x * y for x, y in zip(a, b)), i) for q, a in set((i, tuple(v)) for i, v in whole) if q == 100 for i, b in whole if i != 100)
    assert sorted(tuple(r) for r in knn.nearest(spark.createDataFrame(rows, kinds)).collect()) == [(100, n + 1, i, -s) for n, (s, i) in enumerate(pairs[:10])]


# 3 and 6: classifiers


def test_toxicity_learns(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(1500):
        own = [word() for _ in range(rng.randint(5, 80))]
        bad = i % 6 == 0
        if bad:
            own.insert(rng.randrange(len(own)), rng.choice(["zoxa", "zoxina", "vileword", "krumm"]))
        rows.append((i, " ".join(own), None, None, None))
        labels.append((i, int(bad)))
    docs, known = docs_of(spark, [*rows, (None, None), (5000, "")]), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, known).collect()}
    assert len(got) == 1502 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and got[None].score == got[5000].score
    assert sum(got[i].predicted == int(i % 6 == 0) for i in held) / len(held) > 0.97
    # labels of held-out rows are never read
    wrong = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in toxicity.score_toxicity(docs, wrong).where("doc_id is not null").collect()} == {i: r.score for i, r in got.items() if i is not None}


def test_classifiers_without_labels(spark):
    docs, none = docs_of(spark, ROWS), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.score_toxicity(docs, none).select("score").distinct().count() == 1
    assert quality.score_quality(docs, none).select("score").distinct().count() == 1
    one = spark.createDataFrame([(r[0], 1, 1) for r in ROWS], "doc_id long, toxic int, quality int")
    assert toxicity.score_toxicity(docs, one).count() == quality.score_quality(docs, one).count() == len(ROWS)
    assert toxicity.score_toxicity(docs.limit(0), one).count() == quality.score_quality(docs.limit(0), one).count() == 0


def test_label_model_ranks_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < a, y, ~y).astype(int) for a in (0.95, 0.8, 0.6)], 1)
    votes = np.hstack([votes, votes[:, 2:]])  # a copy of the worst voter
    post, _, corr = toxicity.label_model(votes, 0.3, np.array([0.9, 0.8, 0.6, 0.6]))
    assert ((post > 0.5) == y).mean() > 0.93 and corr[2, 3] > 0.9 > abs(corr[0, 1])


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.88 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.95


def test_toxicity_undisguises():
    assert {"idiot", "fool"} <= toxicity.text_features("an 1d10t, id10t and f o o l!")
    names = {p: toxicity.pattern_votes(t) >> i & 1 for i, (p, t) in enumerate(zip(toxicity.PATTERNS, ("a s***t b", "such a f o o l", "big l0ser now", "GO AWAY NOW YOU ALL!", "no!!", "sooooo", "loser loser loser", "you are such a clown!")))}
    assert all(names.values()) and toxicity.pattern_votes("A plain text, with 12 words in it.") == toxicity.pattern_votes(None) == 0


def planted_sample(n=1500, seed=2):
    """(names, rows, counts): words that go with the label, words that don't, and a pattern of each kind."""
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(30)] + [f"wo{i}-" for i in range(3)]
    toxic = (rng.random(n) < 0.2).astype(int)
    words, patterns = [], np.zeros(n, np.int64)
    for i, y in enumerate(toxic):
        own = {int(w) for w in rng.integers(6, 30, 8)} | {int(w) for w in range(6) if rng.random() < (0.5 if y else 0.01)}
        words.append(np.array([[w, 30 + w if w < 3 else -1, -1, -1] for w in sorted(own)]))
        patterns[i] = int(rng.random() < (0.6 if y else 0.05)) + 2 * int(rng.random() < 0.3)
    rows = toxicity.Rows(words, rng.integers(0, toxicity.FOLDS, n), patterns, toxic)
    return names, rows


def counts_of(names, rows):
    counts = np.zeros((len(names), toxicity.FOLDS, 2))
    for own, f, y in zip(rows.words, rows.fold, rows.toxic):
        counts[np.unique(own[own >= 0]), f, y] += 1
    return counts


def test_own_label_has_no_part_in_its_posterior():
    names, rows = planted_sample()
    post, accuracy, _ = toxicity.posteriors(names, counts_of(names, rows), rows)
    assert ((post > 0.5) == rows.toxic).mean() > 0.95
    assert accuracy[accuracy > 0].min() > 0.4
    for i in (0, 7, 100, 1499):
        other = toxicity.Rows(rows.words, rows.fold, rows.patterns, rows.toxic.copy())
        other.toxic[i] = 1 - other.toxic[i]
        assert toxicity.posteriors(names, counts_of(names, other), other)[0][i] == post[i]
    # nor any label of its fold
    other = toxicity.Rows(rows.words, rows.fold, rows.patterns, np.where(rows.fold == 1, 1 - rows.toxic, rows.toxic))
    again = toxicity.posteriors(names, counts_of(names, other), other)[0]
    assert (again[rows.fold == 1] == post[rows.fold == 1]).all()


def test_classifier_is_trained_on_posteriors(monkeypatch):
    names, rows = planted_sample(600)
    seen = {}
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, target, *_, **__: seen.update(target=target) or (np.zeros(len(names)), 0.0))
    toxicity.fit_rows(names, counts_of(names, rows), rows)
    assert (seen["target"] == toxicity.posteriors(names, counts_of(names, rows), rows)[0]).all() and not np.isin(seen["target"], (0, 1)).all()


def test_patterns_have_one_sign_or_none():
    _, rows = planted_sample()
    vote, right = toxicity.signs(rows, (0, 3))
    assert vote[0] == 1 and right[0] > 0.5 and (vote[1:] == -1).all()
    rows.toxic = 1 - rows.toxic
    assert toxicity.signs(rows, ())[0][0] == 0


def test_margin_against_features(spark):
    import pickle

    rng = random.Random(3)
    weights = {"bad": 2.0, "bad-": 1.0, "badl-": 0.5, "idiot": 3.0, "fool": 1.5, "w-": 9.0}
    model = toxicity.Toxicity(weights, -1.0)
    for _ in range(300):
        text = "".join(rng.choice(["bad", "badly", "id1ot", " ", " ", "f o o l", "f.o-o l", "x", "\n", "Bad", "1", "é"]) for _ in range(rng.randint(0, 14)))
        want = -1.0 + sum(weights[x] for x in sorted(weights.keys() & toxicity.text_features(text)))
        assert math.isclose(model.margin(text), want) and math.isclose(pickle.loads(pickle.dumps(model)).margin(text), want)


def test_quality_learns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert got and sum(r.predicted == r.quality for r in got) / len(got) > 0.9


def test_quality_held_out(spark):
    """A view without skill doesn't spoil the other: at most as many errors together as from the content alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    wrong = lambda c: int(((got[c] >= 0.5) != got["quality"]).sum())
    assert wrong("score") <= 8 and wrong("score") <= min(wrong("content_score"), wrong("metadata_score"))


def test_quality_views_without_skill():
    rng = np.random.default_rng(3)
    label = (rng.random(800) < 0.7).astype(int)
    told = np.where(label == 1, 1.0, -1.0) + rng.normal(0, 1, 800)
    noise = rng.normal(0, 1, 800)
    w = quality._mix([2 * told, 0 * noise + 0.8], label)
    assert w == (1.0, 0.0, 0.0)
    w = quality._mix([2 * told, 2 * (np.where(label == 1, 1.0, -1.0) + rng.normal(0, 1, 800))], label)
    assert w[0] > 0.3 and w[1] > 0.3
    assert quality.shape("ABCdef-12-34-5!xyz") == "a-0-0-0!a" and quality.shape("NASA") == "A"


def odd_half(spark, n=4000, labelled=400):
    """Documents whose words and whose source each tell their quality in nine of ten cases."""
    rng = random.Random(4)
    good, bad = ["fine", "words", "of", "prose"], ["junk!", "##", "buy"]
    rows = []
    for i in range(n):
        flip = lambda: i % 2 if rng.random() < 0.9 else 1 - i % 2  # noqa: E731, B023
        rows.append((i, " ".join(rng.choice(good if flip() else bad) for _ in range(rng.randint(3, 9))), "en", f"s{flip()}", None))
    labels = spark.createDataFrame([(i, i % 2) for i in range(labelled)], "doc_id long, quality int")
    return docs_of(spark, rows), labels


def test_quality_either_view_learns(spark):
    docs, labels = odd_half(spark)
    got = quality.score_quality(docs, labels).where("doc_id >= 400").collect()
    right = lambda c: sum((r[c] >= 0.5) == r.doc_id % 2 for r in got) / len(got)
    assert right("content_score") > 0.85 and right("metadata_score") > 0.85 and right("score") >= max(right("content_score"), right("metadata_score"))
    # metadata alone, then words alone: what the other view can't see changes nothing
    for drop, alone in (({"text": F.lit("")}, "metadata_score"), ({"source": F.lit("s"), "lang": F.lit("l")}, "content_score")):
        one = quality.score_quality(docs.withColumns(drop), labels).where("doc_id >= 400").collect()
        assert sum((r[alone] >= 0.5) == r.doc_id % 2 for r in one) / len(one) > 0.85


def test_quality_learns_from_all(spark):
    docs, labels = odd_half(spark, 3000, 100)
    last = F.col("doc_id") >= 2900
    scores = []
    for df in (docs, docs.withColumn("source", F.when(last, "s7").otherwise(F.col("source")))):
        scores.append({r.doc_id: r.score for r in quality.score_quality(df, labels).where(~last).collect()})
    assert scores[0].keys() == scores[1].keys() and scores[0] != scores[1]


def test_quality_bayes_and_surest(spark):
    rng = np.random.default_rng(6)
    sets = [[{f"f{x}" for x in rng.integers(0, 40, rng.integers(1, 9))} for _ in range(400)] for _ in range(2)]
    label = np.array([int("f1" in a or "f2" in b) for a, b in zip(*sets)])
    packed = [[quality.hashed(f, w) for f in own] for own, w in zip(sets, quality.WIDTHS)]
    views = tuple(map(quality.View, packed))
    models = quality._fit(None, views, label, [], 1.0)
    for i in range(2):
        loo = models[i].margin(views[i], label)
        for r in (0, 7, 399):  # brute force: counts of all other rows
            keep = [j for j in range(400) if j != r]
            name = lambda j: set(np.frombuffer(packed[i][j], np.uint16).tolist())  # noqa: E731, B023
            c = {y: Counter(x for j in keep if label[j] == y for x in name(j)) for y in (0, 1)}
            n = {y: sum(label[j] == y for j in keep) for y in (0, 1)}
            w = [float(quality._odds(np.array([c[0][x]]), np.array([c[1][x]]), n[0], n[1])[0]) for x in sorted(name(r))]
            assert math.isclose(loo[r], sum(w) / max(1, sum(x != 0 for x in w)), abs_tol=1e-9)
    pool = spark.createDataFrame(list(zip(*packed)), "content binary, metadata binary").repartition(3)
    scales = [(1e9, -1e9 * float(np.median(m.margin(v)))) for m, v in zip(models, views)]  # all are sure, on either side of the median
    done = [quality._surest(pool, models, scales, [], 20, 10)]
    done.append(quality._surest(pool, models, scales, done, 20, 10))
    known = quality.taught(views, done)
    for i in range(2):
        m = quality.ordered(models[1 - i].margin(views[1 - i]))
        rest = m[known[i] == -1]
        assert (known[i] >= 0).any() and all(x <= rest.min(initial=2**31) for x in m[known[i] == 0]) and all(x >= rest.max(initial=-(2**31)) for x in m[known[i] == 1])
    for i, (counts, total) in enumerate(quality._counted(pool, done)):
        assert (total == [(known[i] == y).sum() for y in (0, 1)]).all()
        assert all((counts[y] == views[i].counts(known[i] == y, quality.WIDTHS[i])).all() for y in (0, 1))


# 4: near duplicates


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in root}


def check_simhash(got, rows):
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    root = brute_groups(set(fps))
    low = defaultdict(list)
    for (i, *_), f in zip(rows, fps):
        low[root[f]].append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    want = Counter((i, f"{f:016x}", least[root[f]]) for (i, *_), f in zip(rows, fps))
    assert Counter(map(tuple, got.collect())) == want


def test_simhash(spark):
    check_simhash(simhash.simhash_groups(docs_of(spark, REPEATED)), REPEATED)
    assert simhash.simhash_groups(docs_of(spark, [])).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    check_simhash(queries.op4_simhash(spark, DIR), rows)


def test_links_are_whole():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 150, np.uint64)
    flips = np.array([[np.uint64(1) << np.uint64(b) for b in rng.choice(64, 3, False)] for _ in range(450)], np.uint64)
    every = np.unique(np.concatenate([base, np.repeat(base, 3) ^ np.bitwise_xor.reduce(flips[:, : 1 + len(flips) % 3], 1)]))
    every = every[np.argsort(simhash._counts(every)[2], kind="stable")]
    x, y = simhash.links_between(every, every, 3, 0)
    nodes, roots = simhash._forest(x, y)
    got = {int(f): int(f) for f in every} | dict(zip(nodes.view(np.uint64).tolist(), roots.view(np.uint64).tolist()))
    want = brute_groups({int(f) for f in every})
    same = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert same(got) == same(want)


def test_components_of_a_chain_and_a_star(spark):
    chain, star = [(i, i + 1) for i in range(0, 300)], [(1000, 1000 + i) for i in range(1, 400)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame([*chain, *star, (5, 5)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(400)}


# 5: exact duplicates


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(docs_of(spark, REPEATED).repartition(6)).collect()
    groups = defaultdict(list)
    for i, t, *_ in REPEATED:
        groups[t or ""].append(i)
    assert len(got) == len(REPEATED) and sum(r.kept for r in got) == len(groups)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert exact_dedup.exact_groups(docs_of(spark, [])).count() == 0
    huge = [(i, "hot" if i % 3 else f"t{i // 6}", None, None, None) for i in range(3000)]  # one group holds two thirds
    sizes = Counter(t for _, t, *_ in huge)
    got = {r.doc_id: (r.group_size, r.keep_id, r.kept) for r in exact_dedup.exact_groups(docs_of(spark, huge)).collect()}
    last = {t: i for i, t, *_ in huge}
    assert got == {i: (sizes[t], last[t], i == last[t]) for i, t, *_ in huge}
    kept = exact_dedup.drop_exact_duplicates(docs_of(spark, REPEATED))
    assert kept.count() == len(groups) and kept.columns == docs_of(spark, []).columns


def test_golomb_code():
    rng = np.random.default_rng(0)
    for values in (np.unique(rng.integers(0, 2**63, 500, np.uint64)), np.array([0], np.uint64), np.array([5, 6, 2**63], np.uint64), np.arange(100, dtype=np.uint64)):
        assert (knn_same := exact_dedup.rice_decode(len(values), *exact_dedup.rice_encode(values))).tolist() == values.tolist(), knn_same


# 7: mixing


def reshared(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + [None] * (None in sizes)
    w = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[n] for n in full)
        share = sum(w[n] for n in names if n not in full)
        target = {n: 3 * sizes[n] if n in full else left * w[n] / share for n in names}
        over = {n for n in names if target[n] > 3 * sizes[n] + 1e-9}
        if not over:
            return target
        full |= over


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 30), None, rng.choice(["a"] * 30 + ["b", "c", "Z", "é", None, ""]), None) for i in range(3000)]
    df = docs_of(spark, rows)
    got = mixing.mix_sources(df).collect()
    sizes = defaultdict(int)
    source = {}
    for i, t, _, s, _ in rows:
        sizes[s] += len(t.split())
        source[i] = s
    want, taken = reshared(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and math.isclose(r.target, want[source[r.doc_id]], rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(df.repartition(5)).collect()))
    copies = Counter(r.doc_id for r in mixing.mixed_rows(df).collect())
    assert all(copies[r.doc_id] == (r.taken // r.size if r.size else 1) for r in got)


def test_mixing_extremes(spark):
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0
    got = mixing.mix_sources(docs_of(spark, REPEATED)).collect()
    assert len(got) == len(REPEATED) and all(r.taken == 0 for r in got if r.size == 0)
    assert [r.taken for r in mixing.mix_sources(docs_of(spark, [(1, None), (2, "")])).collect()] == [0, 0]
    assert mixing.mix_sources(docs_of(spark, [(1, "a b c")], clash=False)).first().taken == 3


# 8: language model


def good_turing(counts):
    """Katz's factors for counts 1 to 5, from the definition: r* / r, lowered so that what they free is the share of items seen once."""
    n = Counter(counts)
    if all(n[r] for r in range(1, 7)):
        limit = 6 * n[6] / n[1]
        d = {r: ((r + 1) * n[r + 1] / n[r] / r - limit) / (1 - limit) for r in range(1, 6)} if limit < 1 else {}
        if d and all(0 < x < 1 for x in d.values()):
            return d
    off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return {r: (r - off) / r for r in range(1, 6)}


def brute_katz(rows, texts=None, order=3):
    """Scores of all ``rows``, or of ``texts``, by the model of the training rows: trigrams, bigrams, words."""
    tok = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    grams = lambda t: [(("\t", *t)[max(0, j + 2 - order) : j + 1], t[j]) for j in range(len(t))]  # context of one or two, word
    train = [tok(t) for i, t, *_ in rows if not held(i)]
    one = Counter(w for t in train for w in t)
    two, three = Counter(), Counter()
    for t in train:
        for h, w in grams(t):
            two[h[-1:], w] += 1
            if len(h) == 2:
                three[h, w] += 1
    n = sum(one.values())
    d1, d2, d3 = (good_turing(c.values()) for c in (one, two, three))
    freed = sum((1 - d1[c]) * c for c in one.values() if c <= 5)
    div1, unknown = (n, freed / n) if freed > 0 else (n + 1, 1 / (n + 1))
    p1 = lambda w: d1.get(one[w], 1) * one[w] / div1 if one[w] else unknown if n else 1.0
    after = defaultdict(dict)
    for (h, w), c in [*two.items(), *three.items()]:
        after[h][w] = c
    memo = {}

    def info(h):
        if h not in memo:
            own, d = after[h], d2 if len(h) == 1 else d3
            total = sum(own.values())
            kept = sum(c * d.get(c, 1) for c in own.values())
            none = all(c > 5 for c in own.values())
            memo[h] = (total + none, (1.0 if none else total - kept) / (total + none) / (1 - sum(p(h[1:], w) for w in own)))
        return memo[h]

    def p(h, w):
        if not h:
            return p1(w)
        if h not in after:
            return p(h[1:], w)
        div, alpha = info(h)
        c = after[h].get(w, 0)
        return c * (d2 if len(h) == 1 else d3).get(c, 1) / div if c else alpha * p(h[1:], w)

    for h in [*list(after)[:40], *list(after)[-40:], ("never seen",)]:
        assert math.isclose(sum(p(h, w) for w in [*one, "never seen"]), 1.0, rel_tol=1e-9)
    out = []
    for i, t, *_ in rows if texts is None else texts:
        own = tok(t)
        score = sum(math.log10(p(h, w)) for h, w in grams(own))
        out.append((i, held(i), len(own), sum(one[w] > 0 for w in own), n, sum(math.log10((one[w] + 1) / (n + len(one) + 1)) for w in own), score))
    return out


def check_katz(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(map(tuple, got.collect()), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("rows", [REPEATED, [(i, t) for i, t in enumerate(texts(300, 8))], [(1, "a"), (2, None)]])
def test_katz(spark, rows, order):
    check_katz(katz.score_texts(docs_of(spark, rows).repartition(3), order=order), brute_katz(rows, order=order))


def test_katz_from_its_tables(spark, monkeypatch):
    monkeypatch.setattr(katz, "SLICE", 50)  # on the driver only: tasks keep theirs
    rows = [(i, t) for i, t in enumerate(texts(60, 8))]
    fitted = katz.fit_texts(docs_of(spark, rows), order=3)
    other = [*rows[:5], (3, "w1 w2 never seen w1 w2 w3 w4"), (4, "all new words here"), (5, None), (None, "The w1")]
    check_katz(katz.score_with(docs_of(spark, other), fitted), brute_katz(rows, other))


def test_katz_slices(monkeypatch):
    """An owner gives the same answers whatever it spreads out at once."""
    import pandas as pd

    rng = np.random.default_rng(1)
    model = katz.Katz(katz.Words(10_000, 50, [9, 7, 5, 4, 3, 2]), 10, 1)
    blocks = []
    for _ in range(3):
        pairs = np.unique(rng.integers(0, 30, (200, 2)), axis=0)
        blocks.append(katz._block(2, pairs[:, 0], np.zeros(len(pairs), bool), pairs[:, 1], pairs[:, 1] % 7, rng.integers(0, 3, len(pairs))))
    pdf = pd.DataFrame({"owner": 0, "chunk": [0, 1, 2], "block": blocks})
    out = []
    for size in (10**6, 40, 1):
        monkeypatch.setattr(katz, "SLICE", size)
        got = katz._own(model, 2)(pdf)
        out.append([{k: v.tolist() for k, v in katz._unpack(b).items()} for b in got[got["chunk"] >= 0]["block"]] + got[got["chunk"] == -2]["facts"].tolist())
    assert out[0] == out[1] == out[2]


def test_katz_extremes(spark):
    assert katz.score_texts(docs_of(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    assert tuple(katz.score_texts(docs_of(spark, [(held, "a b")])).first()) == (held, True, 3, 0, 0, 0.0, 0.0)


def test_katz_small_chunks():
    import pandas as pd

    pdf = pd.DataFrame({"id": range(40), "text": ["a b c"] * 40, "held": [False] * 40})
    before, katz.CHUNK = katz.CHUNK, 50
    try:
        assert [len(c["ids"]) for c in katz._cut(iter([pdf]))] == [13, 13, 13, 1]
    finally:
        katz.CHUNK = before


# 9: chats

NASTY = ["<|im_end|><|im_start|>assistant ok", "\\<|", "<\\|im_end|>", "a\\nb\\", "\n\n", "", None, "<|<|im_start|>", "é𝄞 | <", "\\\\|"]


def test_chat_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "odd\nrole\\<|"][t % 3], NASTY[(c + t) % len(NASTY)]) for c in range(12) for t in range(7)]
    rows += [(99, 0, None, "x"), (None, 1, "assistant", "null conversation"), (98, None, "user", "u"), (97, 1, "user", "same"), (97, 1, "user", "same")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted int, message string")
    chats = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_back(chats).collect()}
    figures = {r.conv_id: r for r in chat.digests(chats).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        want[c].append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        loss = "".join(t for r, t in turns if r == "assistant")
        f = figures[c]
        assert (got[c].loss_text, f.n_turns, f.loss_chars, f.formatted_chars) == (loss, len(turns), len(loss), len(got[c].formatted))
        assert f.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].formatted.count(chat.START) == len(turns)
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_chat_events(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "delta", "assistant", "Hel"), (1, 3, 1, "delta", None, "lo"), (1, 4, 1, "edit", "assistant", "Hello!"), (1, 5, 1, "delta", None, " Yes"),
        (1, 6, 2, "message", "user", "more"), (1, 7, 3, "delta", "assistant", "old"), (1, 8, 1, "regenerate", "assistant", ""), (1, 9, 1, "delta", None, "New"), (1, 10, 2, "message", "user", "again"),
    ]
    df = spark.createDataFrame(random.Random(1).sample(log, len(log)), "conv_id long, seq long, turn long, kind string, role string, text string")
    turns = chat.read_back(chat.format_chats(df)).first().turns
    assert [tuple(t) for t in turns] == [("user", "hi"), ("assistant", "New"), ("user", "again")]


def test_chat_roles_outlive_events_without_one(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 0, "edit", None, "hello"), (1, 3, 1, "message", "assistant", "one"), (1, 4, 1, "regenerate", None, ""), (1, 5, 1, "delta", None, "two"),
        (2, 1, 0, "edit", "user", "a"), (2, 2, 0, "edit", "system", "b"), (2, 3, 0, "edit", None, "c"), (3, 1, 0, "delta", "assistant", "d"), (4, 1, 0, "delta", None, "e"),
    ]
    df = spark.createDataFrame(random.Random(1).sample(log, len(log)), "conv_id long, seq long, turn long, kind string, role string, text string")
    turns = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.format_chats(df)).collect()}
    assert turns == {1: [("user", "hello"), ("assistant", "two")], 2: [("system", "c")], 3: [("assistant", "d")], 4: [("", "e")]}


# 10: packing


def test_packing_one_cluster(spark):
    import time

    df = spark.createDataFrame([(7, "same text", None, "s", None)], DOCS).crossJoin(spark.range(30_000)).drop("id")
    start = time.perf_counter()
    assert packing.pack_documents(df, shard=10_000).select("bin_id").distinct().count() == 30_000
    assert time.perf_counter() - start < 30

def test_packing(spark):
    rows = [*REPEATED, *[(1000 + i, "x " * (i % 37) + "same end", None, "hot", None) for i in range(300)], *[(2000 + i, "equal text here", None, f"t{i % 3}", None) for i in range(60)]]
    got = packing.pack_documents(docs_of(spark, rows), capacity=100, per_source=4, shard=150).collect()
    words = Counter()
    for i, t, *_ in rows:
        words[i] += len((t or "").split())
    have = Counter()
    for r in got:
        have[r.doc_id] += r.n_words
    assert have == words
    bins = defaultdict(list)
    for r in got:
        assert (r.bin_id is None) == (r.n_words == 0)
        if r.bin_id:
            bins[r.bin_id].append(r)
    text = {i: (t, s) for i, t, _, s, _ in rows}
    for own in bins.values():
        spans = sorted((r.bin_start, r.bin_start + r.n_words) for r in own)
        assert spans[0][0] == 0 and spans[-1][1] <= 100 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        parts = [r for r in own if r.n_words < 100 and r.doc_id is not None]
        assert len({text[r.doc_id][0] for r in parts}) == len(parts)
        assert max(Counter(text[r.doc_id][1] for r in parts).values(), default=0) <= 4
    assert packing.pack_documents(docs_of(spark, [])).count() == 0


def test_best_fit_takes_the_tightest():
    rng = random.Random(4)
    n = 300
    sizes, sources, clusters = ([rng.randint(1, 60) for _ in range(n)], [rng.randrange(5) for _ in range(n)], [rng.randrange(-1, 20) for _ in range(n)])
    where, start, bins = packing.best_fit(np.array(sizes), np.array(sources), np.array(clusters), 100, 3)
    room, held, used = [100] * bins, [Counter() for _ in range(bins)], [set() for _ in range(bins)]
    made = 0
    for i in sorted(range(n), key=lambda i: -sizes[i]):
        fits = [room[b] for b in range(made) if room[b] >= sizes[i] and held[b][sources[i]] < 3 and (clusters[i] < 0 or clusters[i] not in used[b])]
        b = where[i]
        made = max(made, b + 1)
        assert room[b] == (min(fits) if fits else 100) and start[i] == 100 - room[b]
        room[b] -= sizes[i]
        held[b][sources[i]] += 1
        used[b].add(clusters[i])


# The pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing", "packing"]
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in at.collect()]
        out = staged(stage(spark, at, DIR), "stage")
        rows = [tuple(r) for r in out.collect()]
        if name != "packing":
            assert out.columns == docs.columns and set(rows) <= set(before)
        if name == "toxicity":
            score = toxicity.score_toxicity(at, spark.read.parquet(f"{DIR}/labels.parquet"))
            assert {r[0] for r in rows} == {r.doc_id for r in score.where("predicted = 0").collect()}
        elif name == "exact dedup":
            last = {}
            for r in before:
                last[r[1]] = max(last.get(r[1], -1), r[0])
            assert sorted(r[0] for r in rows) == sorted(last.values())
        elif name == "SimHash near-dedup":
            root = brute_groups({brute_fingerprint(r[1]) for r in before})
            least = {}
            for r in before:
                least[root[brute_fingerprint(r[1])]] = min(r[0], least.get(root[brute_fingerprint(r[1])], r[0]))
            assert sorted(r[0] for r in rows) == sorted(least.values())
        elif name == "mixing":
            taken = {r.doc_id: r.taken // max(1, r.size) for r in mixing.mix_sources(at).collect()}
            assert Counter(r[0] for r in rows) == Counter({i: n for i, n in taken.items() if n})
        else:
            assert sum(r.n_words for r in out.collect()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in before)
        at = out
    assert corpus_pipeline.run(spark, DIR).count() == at.count()


def test_pipeline_odd_tables(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, an empty table, and columns whose names the stages use themselves."""
    import corpus_pipeline

    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(101)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (REPEATED, []):
        at = docs_of(spark, rows).withColumn("toxicity", F.lit("own")).withColumn("toxicity score", F.lit(2.0))
        want = at.columns
        for name, stage in corpus_pipeline.STAGES:
            before = {tuple(r) for r in at.collect()}
            at = staged(stage(spark, at, str(tmp_path)), "odd")
            assert name == "packing" or (at.columns == want and {tuple(r) for r in at.collect()} <= before)
        assert bool(at.count()) == bool(rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    want = [tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()]
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == sorted(want)

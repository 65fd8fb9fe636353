"""The dealt operators against versions that look at everything at once, and held-out accuracy."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfeat.llm import decontaminate, html, pieces, pii, quality, toxicity
from loomfeat.llm import text as T
from loomfeat.llm.shared import read

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# --- op1


def _paths(model, text):
    """{pieces: probability} of all segmentations, by enumeration."""
    weight = {}

    def go(rest, done, log):
        if not rest:
            weight[tuple(done)] = log
        for n in range(1, min(len(rest), model.longest) + 1):
            i = model.id.get(rest[:n])
            if i is not None:
                go(rest[n:], [*done, i], log + model.log[i])

    go("\u2581" + text.replace(" ", "\u2581"), [], 0.0)
    total = np.logaddexp.reduce(list(weight.values()))
    return {k: math.exp(v - total) for k, v in weight.items()}


def test_segmentations_come_as_often_as_their_probability():
    model, n = pieces.load(pieces.MODEL), 20_000
    want = _paths(model, "hello there")
    data = np.frombuffer(b"hello there" * n, np.uint8)
    found, off = pieces.encode(model, data, np.arange(n + 1) * 11, T.mix(np.arange(n).astype(np.uint64)))
    got = Counter(tuple(found[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True))
    assert set(got) <= set(want)
    assert sum(abs(got[k] / n - p) for k, p in want.items()) / 2 < 0.03


# --- op3, op5


def test_quality_of_documents_held_out(spark):
    docs = read(spark, MIDDLE, "documents")
    labels = read(spark, MIDDLE, "labels").filter("doc_id is not null and quality is not null").dropDuplicates(["doc_id"])
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    got = quality.scored(docs, labels.filter(half == 0)).join(labels.filter(half == 1).select("doc_id", "quality"), "doc_id").toPandas()
    assert len(got) > 30 and (got["kept"].astype(int) == got["quality"]).mean() > 0.9
    good, bad = got["score"][got["quality"] == 1], got["score"][got["quality"] == 0]
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.95


def test_pairs_fit_as_plain_descent_fits_them():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.5, 1, (60, 3)) * [1, 5, 0.1], rng.normal(-0.5, 1, (50, 3)) * [1, 5, 0.1]
    mean, weights = quality.fit(good, bad, pairs=5000)
    draw, both = np.random.default_rng(7), np.concatenate([good, bad])
    g, b = draw.integers(0, 60, 5000), draw.integers(0, 50, 5000)
    d, w = (good[g] - bad[b]) / both.std(0), np.zeros(3)
    for _ in range(20_000):
        w += 0.3 * ((d / (1 + np.exp(d @ w))[:, None]).mean(0) - 1e-3 * w)
    assert np.allclose(mean, both.mean(0)) and np.allclose(weights, w / both.std(0), rtol=1e-4)


def test_the_threshold_is_the_quantile_of_all_good_scores(spark):
    scores = spark.createDataFrame([(i, float(i % 97)) for i in range(500)] + [(900, quality.LOWEST)], "doc_id long, score double").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(500)] + [(900, 1), (None, 1)], "doc_id long, quality int")
    good = sorted(float(i % 97) for i in range(500) if i % 3 > 0)
    for q in (0.002, 0.3):
        assert quality.threshold_of(scores, labels, q) == good[max(1, math.ceil(q * len(good))) - 1]


def _words(y, rng, pair=True):
    """Documents whose class depends on two terms, of which neither says anything."""
    for i, label in enumerate(y):
        a = rng.integers(0, 2)
        b = a if label == 0 else 1 - a
        yield i, " ".join([*(["ants"] if a else []), *(["bees"] if b else []), *(f"w{k}" for k in rng.integers(0, 300, 25))])


def test_terms_that_tell_only_together(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 3000)
    rows = list(_words(y, rng))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y) if i < 2400], "doc_id long, toxic int")
    machine, _ = toxicity.train(docs, labels)
    known = set(toxicity.terms(pa.array(["ants bees"]))[1].tolist())
    assert known <= set(machine.terms.tolist()) and len(machine.terms) < 10
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, labels).collect()}
    assert np.mean([got[i] == bool(y[i]) for i in range(2400, 3000)]) > 0.99
    # additive weights get three of the four cases at best
    row, term = toxicity.terms(pa.array([t for _, t in rows]))
    flat = toxicity.fit(row, term, y.astype(float), machine.terms, factors=1, epochs=1)
    flat.v[:] = 0
    assert np.mean((flat.scores(*flat.indexed(row, term), len(y)) > flat.bias) == y) < 0.8


def test_scores_are_sums_over_all_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 4)))
    for own in ([0, 2, 5], [1], []):
        want = 0.3 + m.w[own].sum() + sum(m.v[i] @ m.v[j] for n, i in enumerate(own) for j in own[n + 1 :])
        assert np.allclose(m.scores(np.zeros(len(own), int), np.array(own, int), 1), want)


def test_no_text_is_never_toxic(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "vile vile words"), (4, "kind words"), (5, " ,. ")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (1, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, labels).collect()}
    assert not got[1] and not got[2] and not got[5]


# --- op7


def _trees(pages, damping):
    """{(host, path): importance} from nested dictionaries, by recursion; a path names the styles on the way."""
    sites = defaultdict(set)
    for _, url, page in pages:
        if html.host_of(url) and page:
            sites[html.host_of(url)].add(page)
    out = {}
    for host, texts in sites.items():
        if len(texts) < 2:
            continue
        styles, said = defaultdict(Counter), defaultdict(Counter)

        def walk(node, path, styles=styles, said=said):
            if node.tag == "#text":
                styles[path]["#text"] += 1
                said[path].update(html.sentences(node.text))
                return
            labels = tuple(c.label for c in node.children)
            styles[path][labels] += 1
            for j, c in enumerate(node.children):
                walk(c, (*path, labels, j))

        for page in texts:
            walk(html.parse(page), ())

        def importance(path, styles=styles, said=said, n=len(texts)):
            own = styles[path]
            m = sum(own.values())
            if m == 1:
                return 1.0
            if set(own) == {"#text"}:
                sums = said[path]
                return 1 - sum(k * math.log(k) for k in sums.values()) / sum(sums.values()) / math.log(n) if sums else 0.0
            shares = {s: k / m for s, k in own.items()}
            shown = -sum(p * math.log(p, m) for p in shares.values())
            damp = damping ** len(own)
            below = sum(p * (np.mean([importance((*path, s, j)) for j in range(len(s))]) if s else 1.0) for s, p in shares.items())
            return (1 - damp) * shown + damp * below

        out |= {(host, path): importance(path) for path in styles}
    return out


def _by_hand(pages, damping, threshold):
    known, out = _trees(pages, damping), {}
    for i, url, page in pages:
        host = html.host_of(url)
        root = html.parse(page or "")

        def prune(node, path, host=host):
            labels = tuple(c.label for c in node.children)
            kept = []
            for j, c in enumerate(node.children):
                below = (*path, labels, j)
                if known.get((host, below), 1.0) >= threshold:
                    prune(c, below)
                    kept.append(c)
            node.children = kept

        prune(root, ())
        out[i] = html.text_of(root, None, lambda _: False)[0]
    return out


def _site(rng, host, n, depth):
    nav = "<ul class='nav'><li>Home</li><li>About</li></ul>"
    for i in range(n):
        words = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6))
        extra = "".join(f"<p>{rng.choice(['same line', 'own line'])} {rng.randrange(4)}</p>" for _ in range(rng.randrange(3)))
        yield f"http://{host}/{i}", f"<html><body>{nav}{'<div>' * depth}<p>text {i}. {words}. Shared end.</p>{extra}{'</div>' * depth}<div id=foot>Rights. {rng.choice(['a', 'b'])}</div></body></html>"


def test_pages_against_nested_trees(spark):
    rng = random.Random(3)
    rows = [x for host, n, depth in (("a.org", 7, 1), ("b.org", 2, 4), ("c.org", 9, 9), ("d.org", 1, 2)) for x in _site(rng, host, n, depth)]
    rows += [rows[0], rows[0], ("http://a.org/bare", "no markup. at all"), (None, "<p>x</p>"), ("nonsense", "<div>y"), ("http://a.org/e", ""), ("http://a.org/n", None)]
    pages = [(i, *x) for i, x in enumerate(rows)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"site": F.lit("x"), "key": F.lit(1), "row": F.lit(2)})
    for threshold, most in ((0.3, 10**6), (0.65, 0)):
        got = {r["page_id"]: r["text"] for r in html.main_text(df, threshold=threshold, local_nodes=most).collect()}
        assert got == _by_hand(pages, 0.9, threshold)
    assert html.main_text(df.limit(0)).count() == 0


# --- op8


def _distance(item, text):
    last = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != t), last[j] + 1, row[j - 1] + 1))
        last = row
    return min(last)


@pytest.mark.parametrize("rate", [0.05, 0.12])
def test_random_edits_against_dynamic_programming(rate):
    rng = random.Random(5)
    for _ in range(60):
        items = sorted({"".join(rng.choice("abc\u00e9") for _ in range(rng.randint(1, 60))) for _ in range(4)})
        text = "".join(rng.choice("abc\u00e9 ") for _ in range(80))
        for x in items:
            y = list(x)
            for _ in range(rng.randint(0, 4)):
                at, what = rng.randrange(len(y) + 1), rng.random()
                y[at : at + (what < 0.7)] = [rng.choice("abc\u00e9")] if what > 0.3 else []
            at = rng.randrange(len(text))
            text = f"{text[:at]} {''.join(y).upper()}. {text[at:]}"
        (flat, words), = decontaminate.compared(pa.array([text]))
        starts, want = set(words.tolist()), {}
        for i, x in enumerate(items):
            budget = int(len(x) * rate)
            d = _distance(x, flat) if budget else 0 if any(flat[a : a + len(x)] == x and {a, a + len(x)} <= starts for a in range(len(flat))) else 1
            if d <= budget:
                want[i] = d
        assert decontaminate.Matcher(items, rate)(flat, words) == want
        assert bool(decontaminate.Matcher(items, rate)(flat, words, True)) == bool(want)


def test_items_of_any_kind_are_searched(spark):
    docs = spark.createDataFrame([(1, "the answer is forty two, they say"), (2, "forty twofold"), (None, "Forty-two!"), (4, "\u00c9COLE NORMALE SUP\u00c9RIEURE DE LYON"), (5, None)], "doc_id long, text string").withColumn("item_id", F.lit("x"))
    items = spark.createDataFrame([(1, "forty two"), (None, "forty two"), (3, "\u00e9cole normale sup\u00e9rieure de lyon"), (4, ""), (5, None), (6, "?!")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    for size in (10**6, 9):  # one part of the items, and several
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items, chunk_bytes=size).collect()}
        assert got == {(1, 1), (1, None), (None, 1), (None, None), (4, 3)}
        assert {r["doc_id"] for r in decontaminate.without_benchmark(docs, items, chunk_bytes=size).collect()} == {2, 5}
    assert decontaminate.matches(docs, items.limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), items).count() == 0


# --- op10


def _scores_by_hand(texts):
    """{(pattern, kind): score} by dictionaries."""
    edges = {(v, seed, p) for t in texts for _, _, v, seed, found in pii.occurrences(t or "") for p in found}
    total = Counter(p for _, _, p in edges)
    seeds = {(v, s): 1.0 for v, s, _ in edges if s}
    confidence, scores = dict(seeds), {}
    for turn in range(pii.TURNS):
        pos = defaultdict(float)
        for v, _, p in edges:
            for (w, kind), c in confidence.items():
                if w == v:
                    pos[p, kind] += c
        claimed = defaultdict(float)
        for (p, _), c in pos.items():
            claimed[p] += c
        made = {(p, k): round(c / (claimed[p] + pii.UNKNOWN_WEIGHT * max(total[p] - claimed[p], 0)), 9) for (p, k), c in pos.items() if c >= pii.MIN_SUPPORT}
        scores = {x: s for x, s in made.items() if s >= pii.THRESHOLD}
        if turn == pii.TURNS - 1:
            break
        miss = defaultdict(lambda: 1.0)
        for v, seed, p in edges:
            for (q, kind), s in scores.items():
                if q == p and not seed:
                    miss[v, kind] *= max(1 - s, 1e-9)
        confidence = seeds | {x: 1 - m for x, m in miss.items() if 1 - m >= pii.THRESHOLD}
    return scores


def test_pattern_scores_against_dictionaries(spark):
    rng = random.Random(1)
    texts = [f"{rng.choice(['mail', 'write to', 'contact'])} user{i}@host{i % 3}.org or {rng.choice(['call', 'ring'])} +1 555-010-{1000 + i} today" for i in range(25)]
    texts += [f"mail bad{i}@@x and call 555-{i} today" for i in range(6)] + [f"room {i} of {i * 3}" for i in range(10)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["pattern"], r["kind"]): r["score"] for r in pii.pattern_scores(pii.extract(df)).collect()}
    want = _scores_by_hand(texts)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert pii.personal_data(df.limit(0)).count() == 0


def test_words_around_are_found_past_any_blanks():
    for gap in (" ", " " * 5000, "\n" * 300):
        (*_, near), = pii.occurrences(f"please{gap}write{gap}to{gap}a.b@c.org{gap}soon")
        assert "left please write to [mail]" in near and "around to [mail] soon" in near

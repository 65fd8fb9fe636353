"""The dealt operators against brute force, exact round trips, agreement with the labels, and rows of all odd kinds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomfeat.llm import chat, decontaminate, html, neardup, neighbours, pieces, pii, quality, tokencount, toxicity
from loomfeat.llm.queries import ORACLES, QUERIES
from loomfeat.llm.shared import read

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "word " * 60000), (4, "the same words here again and again"), (5, "the same words here again and again"), (5, "the same words here again and again"), (None, "no id here"), (7, "  \n\t "), (8, "▁ café \U0001f600 x@y.org")]


def docs(spark, rows=ODD, schema=DOC):
    full = [(i, t, "en", "web", None if t is None else len(t)) for i, t in rows]
    # columns whose names clash with those that the operators make
    return spark.createDataFrame(full, schema).withColumns({"score": F.lit("s"), "group_id": F.lit(1.5), "kept": F.lit("x"), "bands": F.lit(0), "_hash": F.lit(None).cast("int")})


def labels(spark, rows=((4, 1, 0), (5, 0, 1), (9, None, None), (None, 1, 1), (4, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_document_operators_take_odd_rows(spark, rows):
    d, lab = docs(spark, rows), labels(spark, [] if not rows else [(4, 1, 0), (5, 0, 1), (9, None, None), (None, 1, 1)])
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "the same words here again and again")] if rows else [], "item_id long, text string")
    near = neardup.near_duplicates(d)
    ids = {i for i, _ in rows}
    assert {r["doc_id"] for r in near.collect()} == ids
    if rows:
        assert {r["doc_id"]: r["group_id"] for r in near.collect()}[5] == 4
    assert quality.scored(d, lab).count() == len(rows)
    assert toxicity.toxicity(d, lab).count() == len(rows)
    assert tokencount.token_counts(d).count() == len(rows)
    assert decontaminate.matches(d, bench).count() == (2 if rows else 0)
    assert decontaminate.without_benchmark(d, bench).columns == d.columns
    assert pii.redact(d).columns == d.columns
    assert pii.redact(d).count() == len(rows)
    enc = pieces.encoded(d).collect()
    assert len(enc) == len(rows) and all(r["lossless"] for r in enc)


def test_pieces_decode_to_the_text_and_repeat(spark):
    d = read(spark, SMALL, "documents")
    a = pieces.encoded(d)
    back = a.join(d.select("doc_id", "text"), "doc_id").select("text", pieces.decoded(F.col("pieces")).alias("back"))
    assert back.filter("text <> back").count() == 0
    b = pieces.encoded(d.repartition(5))
    assert a.select("doc_id", "pieces").exceptAll(b.select("doc_id", "pieces")).count() == 0
    other = pieces.encoded(d, seed=2)
    assert a.select("doc_id", "pieces").exceptAll(other.select("doc_id", "pieces")).count() > 0


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    v = np.concatenate([centres[rng.integers(0, 20, 900)] + 0.2 * rng.normal(size=(900, 16)), rng.normal(size=(300, 16))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.neighbours(df, every=1, first=60, per_cell=20, block=200).collect():
        got.setdefault(r["vec_id"], []).append(r["neighbour_id"])
    v = v.astype(np.float32).astype(float)
    hits = 0
    for i in range(len(v)):
        d = ((v - v[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & set(got[i]))
    assert hits / (10 * len(v)) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [0.0, 1.0]), (8, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = {(r["vec_id"], r["rank"]): (r["neighbour_id"], r["distance"]) for r in neighbours.neighbours(df, every=1).collect()}
    assert got == {(1, 1): (2, 0.0), (1, 2): (3, 1.0), (2, 1): (1, 0.0), (2, 2): (3, 1.0), (3, 1): (1, 1.0), (3, 2): (2, 1.0)}
    assert neighbours.neighbours(df.filter("false")).count() == 0
    assert neighbours.neighbours(df).count() == 0  # no id is divisible by 100
    # of equal distances at the last place the least ids count
    ring = spark.createDataFrame([(100 * i, [float(i % 2), float(i // 2 % 2), 0.0, 0.0]) for i in range(40)], "vec_id long, embedding array<double>")
    got = [r["neighbour_id"] for r in neighbours.neighbours(ring, k=3).filter("vec_id = 400").orderBy("rank").collect()]
    assert got == [0, 800, 1200]


def test_traversal_is_the_sorted_order_of_all_pairs():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    got = [d for d, _, _ in neighbours.traverse(a, b)]
    assert np.allclose(got, np.sort((a[:, None] + b[None, :]).ravel())) and len(got) == 35


def _shingles(text):
    w = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def test_near_duplicates_against_all_pairs(spark):
    d = read(spark, SMALL, "documents")
    rows = d.select("doc_id", "text").collect()
    sets = {r["doc_id"]: _shingles(r["text"] or "") for r in rows}
    group = {r["doc_id"]: r["group_id"] for r in neardup.near_duplicates(d).collect()}
    high, both = 0, 0
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.6 * max(len(sets[a]), len(sets[b])):
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= 0.6:
                    high, both = high + 1, both + (group[a] == group[b])
    assert high and both >= 0.95 * high


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 300).astype(np.uint64)
    one, two = x[:200], x[100:]
    row = np.repeat([0, 1], 200)
    sig = neardup.superminhash(row, np.concatenate([one, two]), 2, 1024)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.06


def _edit_substring(item, text):
    last = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != t), last[j] + 1, row[j - 1] + 1))
        last = row
    return min(last)


def test_edit_matching_against_dynamic_programming(spark):
    item = "which of these four old rivers runs through the capital of the northern province in spring"
    changed = item.replace("rivers", "rivrs").replace("spring", "sprang")
    texts = {1: f"before {item} after", 2: f"x {changed} y", 3: "nothing of the kind is here", 4: item[: len(item) // 2], 5: None}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    b = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["distance"], r["budget"]) for r in decontaminate.matches(d, b).collect()}
    assert set(got) == {1, 2}
    assert got[1][0] == 0 and got[2][0] == _edit_substring(item, f"x {changed} y") <= got[2][1]


def test_identifiers_are_found_and_redacted(spark):
    d = read(spark, SMALL, "documents")
    found = pii.personal_data(d).collect()
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    assert found and all(text[r["doc_id"]][r["start"] : r["end"]] == r["value"] for r in found)
    gone = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert all(r["value"] not in gone[r["doc_id"]] for r in found)
    clean = set(text) - {r["doc_id"] for r in found}
    assert all(gone[i] == text[i] for i in clean)


def test_token_counts_against_encoding_each(spark):
    d = read(spark, SMALL, "documents")
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op4_token_counts"](spark, SMALL).collect()}
    enc = tokencount.tokenizer(tokencount.RANKS)
    assert got == {r["doc_id"]: len(enc.encode_ordinary(r["text"] or "")) for r in d.collect()}
    # documents that blocks cut, and blocks without a separator
    small = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(d, block_tokens=50).collect()}
    assert small == got


@pytest.mark.parametrize("name, column, target", [("op3_quality_classifier", "kept", "quality"), ("op5_toxicity", "toxic", "toxic")])
def test_classifiers_agree_with_labels(spark, name, column, target):
    sf = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf).select("doc_id", F.col(column).alias("said"))
    both = got.join(read(spark, sf, "labels").select("doc_id", F.col(target).alias("truth")), "doc_id").toPandas()
    assert (both["said"].astype(int) == both["truth"]).mean() > 0.9


def test_chat_round_trip(spark):
    out = QUERIES["op6_chat_formatting"](spark, SMALL)
    assert out.filter("not identical").count() == 0
    assert "op6_chat_formatting" in ORACLES
    rows = [(1, 1, "user", "<|im_start|>"), (1, 2, None, None), (1, 2, "user", ""), (None, 1, "user", "x"), (2, None, "<|end|>", "\n<|end|>\\")]
    odd = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("clash"))
    got = chat.formatted(odd).collect()
    assert {r["conv_id"] for r in got} == {1, 2, None} and all(r["identical"] for r in got)
    assert chat.formatted(odd.filter("false")).count() == 0


def test_page_boilerplate_goes_and_content_stays(spark):
    page = "<html><body><div class='nav'><a>Home</a><a>About us</a></div><div class='main'><p>{}</p></div><div class='foot'>All rights reserved</div></body></html>"
    rows = [(i, f"http://a.org/{i}", page.format(f"own text number {i} of this page, unlike {i * i}")) for i in range(12)] + [(20, None, "<p>x</p>"), (21, "http://b.org/", None), (22, "http://b.org/", ""), (23, "nonsense", "<div><p>unclosed")]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 16
    for i in range(12):
        assert f"number {i} of" in got[i] and "Home" not in got[i] and "reserved" not in got[i]
    assert (got[20], got[21], got[22], got[23]) == ("x", "", "", "unclosed")


def _by_hand(rows, labels, items, classifier):
    """The pipeline over lists: every document against every other and every item, and plain loops elsewhere."""
    mean, weights, threshold = classifier
    x = quality.features(pa.array([r["text"] for r in rows], pa.string()))
    rows = [r for r, f in zip(rows, x, strict=True) if f[0] > 0 and (f - mean) @ weights >= threshold - 1e-12]
    kept = []
    sets = {r["doc_id"]: _shingles(r["text"]) for r in rows}
    group = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 2 * min(len(sets[a]), len(sets[b])) >= max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                old, new = group[b], group[a]
                group = {i: new if g == old else g for i, g in group.items()}
    first = {g: min(i for i in ids if group[i] == g) for g in set(group.values())}
    kept = [r for r in rows if first[group[r["doc_id"]]] == r["doc_id"]]
    flat = [x for x, _ in decontaminate.compared(pa.array(items, pa.string()))]
    out = []
    for r in kept:
        (text, words), = decontaminate.compared(pa.array([r["text"]]))
        hit = False
        for x in filter(None, flat):
            budget = int(len(x) * decontaminate.RATE)
            # any window that holds an occurrence has a piece of the item; exact substrings are searched for without pieces
            hit = hit or x in text or budget > 0 and any(p in text for _, p in decontaminate.pieces(x, budget)) and decontaminate.Pattern(x, decontaminate.RATE).distance(text) <= budget
        if not hit:
            out.append(r)
    return {r["doc_id"]: r["text"] for r in out}


def test_pipeline_against_lists(spark):
    d = read(spark, SMALL, "documents")
    labels = read(spark, SMALL, "labels")
    rows = [r for r in d.collect() if r["doc_id"] is not None]
    mean, weights = quality.train(d, labels)
    scores = d.select("doc_id", quality.score_of(F.col("text"), mean, weights).alias("score"))
    want = _by_hand(rows, labels, [r["text"] for r in read(spark, SMALL, "benchmark").collect()], (mean, weights, quality.threshold_of(scores, labels)))
    stage = d
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, stage, SMALL)
        assert sorted(out.columns) == sorted(d.columns)
        stage = out
    redacted = {r["doc_id"]: r["text"] for r in stage.collect()}
    # banding may miss a pair near the threshold
    assert set(want) <= set(redacted) and len(redacted) <= 1.03 * len(want)
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert last.keys() == redacted.keys() and all(r["lossless"] for r in last.values())
    model = pieces.load(pieces.MODEL)
    for i, r in last.items():
        assert b"".join(model.bytes[p] for p in r["pieces"]).decode()[1:] == (redacted[i] or "")


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_pipeline_stages_take_odd_rows(spark, tmp_path, rows):
    d = docs(spark, rows)
    sf = str(tmp_path)
    labels(spark, [] if not rows else [(4, 1, 0), (8, 1, 0), (5, 0, 1), (9, None, None)]).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "no id here")] if rows else [], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, d, sf)
        assert out.dtypes == d.dtypes, name
        d = spark.createDataFrame(out.toArrow()) if out.count() else out
        assert out.count() <= max(1, len(rows))
    got = corpus_pipeline.STAGES[-1][1](spark, d, sf).collect()
    assert all(r["lossless"] for r in got) and {r["doc_id"] for r in got} <= {i for i, _ in rows}

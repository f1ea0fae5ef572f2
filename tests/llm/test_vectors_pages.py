"""Vector operators against brute force, page extraction, and the pipeline on the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sellerlens.llm import hnsw, html_text, pq_dedup
from sellerlens.llm.minhash import forest


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16))
    x[100:160] = x[100] + 0.05 * rng.normal(size=(60, 16))
    x[200:210] = x[200]
    x[300] = 3 * x[301]
    rows = [(k, v.tolist(), 1, "n") for k, v in enumerate(x)]
    odd = [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [float("inf")] * 16), (404, [None] + [1.0] * 15), (405, [1.0]), (406, []), (None, x[100].tolist())]
    return x, rows + [(i, v, 1, "n") for i, v in odd]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, node string")


def test_near_vectors(spark, vectors):
    x, rows = vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    roots = forest(linked)
    got = {r["vec_id"]: r for r in pq_dedup.near_vectors(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k in range(400):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (linked[k].sum(), roots[k], roots[k] == k)
    for k in (400, 401, 402, 403, 404, 405, 406):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert got[None]["kept"] and got[None]["n_links"] == 0
    assert pq_dedup.near_vectors(frame(spark, [])).count() == 0


def test_neighbours(spark, vectors):
    x, rows = vectors
    table = frame(spark, rows)
    got = {}
    for r in hnsw.neighbours(table, table.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    assert set(got) == set(range(0, 400, 50))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(400), d))[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(s - d[i]) < 1e-12 for _, i, s in found) and [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len(set(best) & {i for _, i, _ in found})
    assert hits >= 0.95 * 80
    assert [i for _, i, _ in got[200]][:9] == list(range(201, 210))
    few = frame(spark, rows[:4])
    assert hnsw.neighbours(few, few.where("vec_id = 0")).count() == 3
    assert hnsw.neighbours(frame(spark, []), table).count() == 0 and hnsw.neighbours(table, frame(spark, [])).count() == 0


@pytest.mark.parametrize("shape", ["isotropic", "clustered", "dense third"])
def test_neighbours_over_many_lists(spark, monkeypatch, shape):
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(hnsw, "QUERIES", 16)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 16))
    if shape == "clustered":
        x = 4 * rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] + 0.5 * x
    if shape == "dense third":
        x[:1000] = x[0] + 0.01 * rng.normal(size=(1000, 16))
    table = frame(spark, [(k, v.tolist(), 1, "n") for k, v in enumerate(x)])
    assert len(hnsw.fit(x, len(x)).centre) > 30
    got = {}
    for r in hnsw.neighbours(table, table.where("vec_id % 25 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(range(0, 3000, 25)) and all(len(v) == 10 for v in got.values())
    hits = 0
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.95 * 10 * len(got)


def test_neighbours_of_odd_tables(spark):
    """Repeated ids, lengths that only one side has, fewer rows than neighbours, and components whose squares overflow."""
    rows = [(1, [0.0, 1.0], 1, "n"), (1, [0.0, 1.0], 1, "n"), (1, [5.0, 1.0], 1, "n"), (2, [0.0, 2.0], 1, "n"), (3, [5.0, 2.0], 1, "n"), (4, [1e200, 1.0], 1, "n"), (7, [1.0] * 3, 1, "n")]
    asked = [(1, [0.0, 1.0], 1, "n"), (1, [5.0, 1.0], 1, "n"), (8, [1.0] * 4, 1, "n"), (9, [0.0, 1.0], 1, "n")]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in hnsw.neighbours(frame(spark, rows), frame(spark, asked)).collect()}
    assert got[1, 1] == (2, 1.0) and got[1, 2] == (3, 1.0)
    assert got[9, 1] == (1, 0.0) and got[9, 2] == (2, 1.0)
    assert {q for q, _ in got} == {1, 9} and [v for (q, _), (v, _) in sorted(got.items()) if q == 9] == [1, 2, 3]  # 4 is beyond double precision


def test_tree_learns_its_table():
    x, y = html_text.EXAMPLES[:, :-1], html_text.EXAMPLES[:, -1]
    assert (html_text.decide(html_text.tree(), x) == y).mean() > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav><div id="cookie-notice">We use cookies on this site, as many others do, to see who reads it.</div>
<article><h1>Head &amp; tail</h1><p><b>First paragraph of   the text&nbsp;has many words<br>in it so that it is long enough.</b><p>Short.
<div class="advert">Buy the very best things that anyone has ever made anywhere</div><p>Last one, caf&#233;.</article>
<section class="comments"><p>I think this is a great text and I would like to read much more of this kind here.</p></section>
<form><input>Subscribe now to our letters</form><script>var p = "</p>";</script><footer>&copy; us</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & tail First paragraph of the text has many words in it so that it is long enough. Short. Last one, café."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""
    long = "<article>" + "<p>word word</p>" * 20_000
    assert html_text.main_text(long).count("word") == 40_000


def test_extract(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "u", PAGE, "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got) and sum(r["n_chars"] > 0 for r in got) == 2
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "test-stage")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] == counts[2] >= counts[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.agg({"length": "sum"}).first()[0] == last.where("start = 0").agg({"doc_tokens": "sum"}).first()[0]


def test_near_vectors_of_one_group_in_many_lists(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "LIST_ROWS", 8)
    monkeypatch.setattr(pq_dedup, "BLOCK", 64)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=16) + 0.4 * rng.normal(size=(900, 16))).astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(pq_dedup.fit(u, len(u), 0.9).centre) > 25
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    table = frame(spark, [(k, v.tolist(), 1, "n") for k, v in enumerate(x)])
    for vectors in (table, table.withColumn("embedding", F.col("embedding").cast("array<float>"))):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq_dedup.near_vectors(vectors).collect()}
        assert got == dict(enumerate(zip(linked.sum(axis=1), forest(linked), strict=True)))


def brute_links(rows, cosine=0.9):
    """Number of linked ids and smallest id reachable, by id, over vectors of equal length."""
    ids = [i for i, *_ in rows]
    linked = np.zeros((len(rows), len(rows)), bool)
    lengths = np.array([len(v) for _, v, *_ in rows])
    for d in set(lengths.tolist()):
        at = np.flatnonzero(lengths == d)
        u = np.stack([rows[k][1] for k in at])
        u = u / np.linalg.norm(u, axis=1, keepdims=True)
        linked[np.ix_(at, at)] = u @ u.T >= cosine
    np.fill_diagonal(linked, False)
    roots = forest(linked)
    return {i: (int(linked[k].sum()), ids[roots[k]]) for k, i in enumerate(ids)}


def test_near_vectors_of_all_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0, 0.0]), (4, [1.0, 2.0, 0.0]), (5, [1.0, 2.0, 0.1]), (6, [-1.0]), (7, [3.0]), (8, [4.0])]
    rows += [(100 + k, (rng.normal(size=3) + [4, 0, 0]).tolist()) for k in range(60)] + [(200 + k, rng.normal(size=2).tolist()) for k in range(60)]
    want = brute_links(rows)
    for exact in (False, True):
        again = rows + [rows[0], (None, [1.0, 2.0])]  # a repeated row is the same vector
        got = pq_dedup.near_vectors(frame(spark, [(*r, 1, "n") for r in again]), exact=exact).collect()
        assert len(got) == len(again)
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None} == want


@pytest.mark.parametrize("shape", ["isotropic", "clustered", "dense third"])
def test_recall_of_near_vectors(spark, monkeypatch, shape):
    monkeypatch.setattr(pq_dedup, "LIST_ROWS", 40)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 32))
    if shape == "clustered":
        x = rng.normal(size=(30, 32))[rng.integers(0, 30, 1500)] * 2 + 0.6 * rng.normal(size=(1500, 32))
    if shape == "dense third":
        x[:500] = 6 * rng.normal(size=32) / 5.6 + 0.32 * rng.normal(size=(500, 32))
    for k in range(0, 1000, 4):  # pairs around the threshold
        x[1499 - k // 4] = x[k] + np.linalg.norm(x[k]) * rng.uniform(0.2, 0.48) * rng.normal(size=32) / 32**0.5
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    want = brute_links(rows)
    links = sum(n for n, _ in want.values())
    assert links > 200
    for exact in (False, True):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq_dedup.near_vectors(frame(spark, [(*r, 1, "n") for r in rows]), exact=exact).collect()}
        if exact:
            assert got == want
        assert sum(n for n, _ in got.values()) >= 0.999 * links and all(got[k][0] <= want[k][0] for k in want)

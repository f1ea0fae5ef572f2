"""Every stage of the pipeline against plain Python or SQL, each on what the stage before it kept."""

import math
from collections import Counter

import duckdb
import numpy as np

import corpus_pipeline
from sellerlens.llm import line_dedup, minhash, packing, queries, tokens, toxicity
from tests.llm.test_documents import brute_components, reference_ids

SF = "/root/testdata/sf0.001"


def by_id(table):
    rows = table.collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(found) == len(rows)
    return found


def without_lines(rows):
    """Texts without the lines that more than a share of their source's documents hold."""
    totals = Counter(r["source"] for r in rows.values())
    holders = Counter((r["source"], line) for r in rows.values() for line in {x.strip(line_dedup.WHITE) for x in (r["text"] or "").split("\n")} if line)
    gone = {k for k, n in holders.items() if n >= line_dedup.PAGES and n > totals[k[0]] * line_dedup.RATIO}
    kept = lambda r: "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(line_dedup.WHITE)) not in gone)
    return {i: None if r["text"] is None else kept(r) for i, r in rows.items()}


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "source_mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns

    every = by_id(spark.read.parquet(f"{SF}/documents.parquet"))
    model = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = toxicity.Scorer(model.stems)
    clean = {i: r for i, r in every.items() if model.scores(np.array([scorer.features(r["text"])]))[0] < 0.5}
    assert by_id(kept["toxicity"]) == clean

    stripped = by_id(kept["line_dedup"])
    assert {i: r["text"] for i, r in stripped.items()} == without_lines(clean)
    assert all(r["n_chars"] == len(r["text"]) for i, r in stripped.items() if r["text"] != clean[i]["text"])

    root = brute_components([(i, r["text"], None) for i, r in stripped.items()], corpus_pipeline.NEAR)
    assert by_id(kept["minhash_near_dedup"]) == {i: r for i, r in stripped.items() if root[i][1] == i}

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/minhash_near_dedup/*.parquet')")
    want = Counter(i for i, in con.sql(f"SELECT doc_id FROM ({queries.MIXING_SQL})").fetchall())
    mixture = [(r["doc_id"], r["text"], r["source"]) for r in kept["source_mixing"].collect()]
    assert Counter(i for i, _, _ in mixture) == want and {t for _, t, _ in mixture} <= {r["text"] for r in stripped.values()}

    pieces = sorted(kept["packing"].collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    stream = np.concatenate([ids for _, ids in reference_ids(mixture)]).astype(np.uint32)
    at, ends = 0, Counter()
    for p in pieces:
        assert p["offset"] == ends[p["sequence_id"]] and p["ids_crc32"] == tokens.crc(stream[at : at + p["length"]])
        at += p["length"]
        ends[p["sequence_id"]] += p["length"]
    assert at == len(stream) and max(ends.values()) <= packing.WINDOW
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == want


def test_near_copies_at_the_stage_threshold(spark):
    """Jaccard 0.82 and 0.80: one document for the stage, two for the query; 0.79: two for both."""
    rows = []
    for k, cut in enumerate((82, 80, 79)):
        w = [f"w{k}x{n}" for n in range(104)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: cut + 4]))]  # 100 shingles, and the first of them
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["minhash_near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, SF).collect()) == [0, 2, 4, 5]
    assert minhash.without_copies(docs).count() == 6


def test_slack_and_first_keys_at_both_thresholds():
    for percent in (80, 85):
        t, n = percent / 100, minhash.SKETCH
        low = sum(math.comb(n, k) * t**k * (1 - t) ** (n - k) for k in range(n + 1) if k / n < minhash._least_estimate(percent))
        assert low < 2e-5


def test_near_copies_of_the_stage_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    kept = corpus_pipeline.without_copies(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i in ids if root[i] == i]


ODD = ["row", "plan", "both", "site", "new", "at", "epoch", "block", "before", "inside", "whole", "rest", "_gone", "id", "n", "keys", "host", "class", "a.b", "part"]


def odd_table(spark, rows):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in ODD)
    return spark.createDataFrame([(*r, *ODD) for r in rows], kinds)


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, empty and long texts, repeated rows, and columns that the stages use themselves."""
    menu, words = "Home News Contact", [f"w{n}" for n in range(40_000)]
    rows = [
        (1, f"{menu}\nfirst page says this", "en", "a", 30), (2, f"second one says that\n{menu}", "en", "a", 30), (3, menu, None, "a", None),
        (4, "", "en", "a", 0), (5, None, "en", "a", None), (None, "a row without an id", "en", None, 1), (None, None, None, None, None),
        (6, " ".join(words), "en", "b", 1), (7, " ".join(words), "en", "b", 1), (8, "same text twice in one id", "en", "b", 1),
        (8, "same text twice in one id", "en", "b", 1), (8, "another text of that id", "en", "b", 1),
    ]
    docs, kept = odd_table(spark, rows), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns
    assert kept["toxicity"].count() == len(rows)
    texts = lambda name: Counter((r["doc_id"], r["text"]) for r in kept[name].select("doc_id", "text").collect())
    want = Counter((i, t if t is None else "\n".join(x for x in t.split("\n") if x != menu)) for i, t, *_ in rows)
    assert texts("line_dedup") == want
    want[(7, " ".join(words))] = 0
    assert texts("minhash_near_dedup") == +want
    assert all(r[c] == c for r in kept["minhash_near_dedup"].collect() for c in ODD)
    assert set(texts("source_mixing")) <= set(texts("minhash_near_dedup")) and texts("source_mixing")[(6, " ".join(words))] >= 1
    pieces = kept["packing"].collect()
    assert sum(p["start"] == 0 for p in pieces) == kept["source_mixing"].count()
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)


def test_stages_on_no_rows(spark, tmp_path):
    docs = odd_table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.schema(docs.schema if name != "packing" else stage(spark, docs, SF).schema).parquet(str(tmp_path / name))
        assert docs.count() == 0

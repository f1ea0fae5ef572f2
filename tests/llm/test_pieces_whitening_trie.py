"""Sentence pieces against the library, whitening against numpy, the conversation trie against brute force and SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sellerlens.llm import conversation_trie, queries, sentence_pieces, whitening
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


# --- sentence pieces ---

@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Pieces(sentence_pieces.model_path())


def test_agenda_equals_library(pieces):
    rng = random.Random(4)
    letters = "aab  \n\t▁éß你好0019the ing🙂́\x00�<>/s_-....    \r　"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    texts += ["", " ", "   ", "▁", "a ", "\n", "<s></s><unk><0x41>", "a" * 3000, "the " * 3000, " " * 100 + "x"]
    for t in texts:
        ids = pieces.encode(t).tolist()
        assert ids == pieces.library.encode(t, add_eos=True)
        assert pieces.decode(ids) == pieces.library.decode(ids)


def test_texts_together_equal_the_library(pieces, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "TOGETHER", 500)
    rng = random.Random(8)
    words = ["the", "Straße", "\nnew", "ing", "", "▁", "你好", "ﬀ", "é🙂", "x" * 47, "y" * 48, "z" * 70, "un" * 40, "a\tb", "\x00", "<s>"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None, "", "a", "  ", "\n"]
    rng.shuffle(texts)
    for end in (True, False):
        ids = pieces.encode_all(texts, end)
        assert [i.tolist() for i in ids] == [pieces.library.encode(t or "", add_eos=end) for t in texts]
        offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        assert pieces.decode_all(np.concatenate(ids), offsets).to_pylist() == [pieces.library.decode(i.tolist()) for i in ids]
    assert pieces.encode_all([]) == [] and pieces.decode_all(np.zeros(0, np.int32), np.zeros(2, np.int32)).to_pylist() == [""]


def test_any_ids_decode_together(pieces):
    rng = random.Random(9)
    rows = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 28705, 259]) for _ in range(rng.randint(0, 9))] for _ in range(5000)]
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    texts = pieces.decode_all(np.array([i for r in rows for i in r], np.int32), offsets).to_pylist()
    assert texts == [pieces.library.decode(r) for r in rows]


def test_any_ids_decode_as_the_library_does(pieces):
    rng = random.Random(5)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 28705, 259]) for _ in range(rng.randint(0, 9))]
        assert pieces.decode(ids) == pieces.library.decode(ids)


def test_long_texts_in_sections(pieces, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice(["the ", "ing", "  ", "\n", "wort ", "▁", " ▁ ", "é"]) for _ in range(4000))
    whole = pieces.library.encode(text, add_eos=True)
    monkeypatch.setattr(sentence_pieces, "SECTION", 50)
    assert pieces.library_ids(text) == whole == pieces.encode(text).tolist()


def test_memory_of_words_is_bounded(monkeypatch):
    model = sentence_pieces.Pieces(sentence_pieces.model_path())
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 20)
    text = " ".join(f"w{k}rd." for k in range(500))
    assert model.encode(text).tolist() == model.library.encode(text, add_eos=True)
    assert len(model.known) <= 20


def test_round_trip_rows(spark, pieces):
    rows = [(1, "Hello  world", "x"), (2, None, "x"), (3, "", "x"), (None, "é🙂", "x"), (4, "same", "x"), (4, "same", "x"), (5, "long " * 100_000, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sentence_pieces.round_trip(table.withColumn("a.b", F.lit(1))).collect()
    assert len(got) == len(rows) and all(r["agrees"] for r in got)
    found = sorted((r["doc_id"] or 0, r["decoded"]) for r in got)
    assert found == sorted((i or 0, t or "") for i, t, _ in rows)
    by_id = {r["doc_id"]: r["ids"] for r in got}
    assert by_id[2] == by_id[3] == [2] and by_id[1] == pieces.library.encode("Hello  world", add_eos=True)
    assert sentence_pieces.round_trip(table.limit(0)).count() == 0
    bare = sentence_pieces.round_trip(table.where("doc_id = 1"), end=False, check=False).first()
    assert bare["ids"] == by_id[1][:-1] and bare["agrees"] is None


def test_query_digests(spark, pieces):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_sentence_pieces(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = pieces.library.encode(docs[r["doc_id"]], add_eos=True)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["agrees"]) == (
            len(ids), digest(" ".join(map(str, ids))), digest(pieces.library.decode(ids)), True)


def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as model_file

    model = model_file.ModelProto.FromString(open(sentence_pieces.model_path(), "rb").read())
    model.trainer_spec.model_type = model_file.TrainerSpec.UNIGRAM
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        sentence_pieces.Pieces(str(tmp_path / "other.model"))


# --- whitening ---

SPECTRA = {
    "apart": np.linspace(1, 100, 48),
    "close": np.r_[50 + np.arange(20) * 1e-9, np.linspace(1, 10, 28)],
    "equal": np.r_[np.full(10, 5.0), np.full(10, 3.0), np.linspace(0.1, 1, 28)],
    "wide": 10.0 ** -np.linspace(0, 12, 48),
    "tight": 1 + np.arange(48) * 1e-11,
    "nested": np.r_[1 + np.arange(12) * 1e-12, 2 + np.arange(12) * 1e-6, np.linspace(5, 9, 24)],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenvectors(name):
    values = SPECTRA[name]
    n, fine = len(values), np.longdouble
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(n, n)))[0].astype(fine)
    for _ in range(4):
        q = q + q @ ((np.eye(n, dtype=fine) - q.T @ q) / 2)
    a = (q * values.astype(fine)) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    top = values.max()
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-17 * top
    assert np.abs(a @ x - x * found).max() < 1e-17 * top and np.abs(x.T @ x - np.eye(n)).max() < 2e-15
    if name != "equal":
        assert np.abs(1 - np.abs((q[:, np.argsort(-values)] * x).sum(axis=0))).max() < 1e-12


def whitened(spark, rows, **kw):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, component string, id long")
    return whitening.whiten(table.withColumn("a.b", F.lit(1)), **kw).collect()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 40)) * np.linspace(0.5, 3, 40) + 7
    x[100:300] = x[100] + 0.01 * rng.normal(size=(200, 40))
    x[5] = 0
    rows = [(k, v.tolist(), 1, "n", 5) for k, v in enumerate(x)] + [(7, x[7].tolist(), 1, "n", 5), (None, x[8].tolist(), 1, "n", 5)]
    odd = [None, [], [float("nan")] + [1.0] * 39, [float("inf")] * 40, [None] + [1.0] * 39, [1e300] * 40]
    got = whitened(spark, rows + [(900 + k, v, 1, "n", 5) for k, v in enumerate(odd)])
    ints = np.floor(64 * np.stack([r[1] for r in rows])).astype(np.int64) + 1_000_000
    n, s = len(ints), ints.sum(axis=0)
    centred = (ints * n - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = centred @ vectors[:, :32] / np.sqrt(values[:32])
    assert len(got) == 32 * len(rows) and {r["n"] for r in got} == {n}
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"]].append(r)
    sign = np.array([np.sign(r["whitened"] * want[0, r["component"] - 1]) for r in sorted(by[0], key=lambda r: r["component"])])
    for k, row in enumerate(rows):
        for r in by[row[0]]:
            assert abs(r["whitened"] * sign[r["component"] - 1] - want[k, r["component"] - 1]) < 1e-8
            assert r["deviation"] == sum(int(v) ** 2 for v in ints[k] * n - s)
            assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12
    assert len(by[7]) == 64 and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_whitening_defined_cases(spark):
    assert whitened(spark, [(1, None, 1, "n", 5)]) == [] and whitened(spark, [(1, [2.0, 3.0], 1, "n", 5)] * 3) == []
    mixed = [(k, [float(k % 3), float(k % 2)], 1, "n", 5) for k in range(6)] + [(10 + k, [float(k)], 1, "n", 5) for k in range(3)]
    got = whitened(spark, mixed)
    assert sorted({(r["vec_id"] >= 10, r["n"], r["component"]) for r in got}) == [(False, 6, 1), (False, 6, 2), (True, 3, 1)]
    large = whitened(spark, [(k, [1e15 * k, 1.0 * (k % 2)], 1, "n", 5) for k in range(8)])
    assert {r["deviation"] for r in large} == {None} and max(r["identity_error"] for r in large) < 1e-4


# --- conversation trie ---

def brute_nodes(rows, with_text=False):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    by = {c: [turn[2:] for turn in sorted(turns)] for c, turns in by.items()}
    whole = {}
    for c, turns in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(by.get(c - c % 100, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in children[node])
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if len(whole[c]) == len(node)))
        row = (min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]),
               leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
        out.append(row + (node[-1] if node else (None, None)) if with_text else row)
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(8)
    say = lambda: rng.choice(["hi", "é🙂", "", None, "a longer turn", "ok"])
    rows = []
    for c in [*range(0, 140), 200, 305, 317, 399, -5, -100, 10_000]:
        if c != 300:
            rows += [(c, k, rng.choice(["user", "assistant", None]), say()) for k in range(rng.choice([1, 1, 2, 5, 9]))]
    rows += [(50, None, "user", "before all"), (50, 0, "user", "tie b"), (50, 0, "user", "tie a"), (51, 1, "u", "x"), (51, 1, "u", "x"),
             (None, 0, "user", "nobody"), (60, 99, "user", "long " * 20_000)]
    rows += [(70, k, "user", f"turn {k % 3}") for k in range(300)]
    rows += [(c, k, "user", "same") for c in range(400, 460) for k in range(8)]  # a group of equal conversations
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(3)).withColumn("a.b", F.lit(1))


def test_trie_equals_brute_force(spark, conversations, monkeypatch):
    want = brute_nodes(conversations)
    table = frame(spark, conversations)
    assert trie_rows(conversation_trie.trie(table)) == want
    monkeypatch.setattr(conversation_trie, "BLOCK", 7)      # conversations over many blocks
    monkeypatch.setattr(conversation_trie, "ID_BITS", 2)    # end lists in many parts
    monkeypatch.setattr(conversation_trie, "parts_for", lambda *a: 9)
    assert trie_rows(conversation_trie.trie(table.repartition(5), with_text=True)) == brute_nodes(conversations, with_text=True)


def test_trie_of_little(spark):
    assert trie_rows(conversation_trie.trie(frame(spark, []))) == []
    assert trie_rows(conversation_trie.trie(frame(spark, [(None, 1, "u", "x")]))) == []
    one = [(7, None, None, None)]
    assert trie_rows(conversation_trie.trie(frame(spark, one))) == brute_nodes(one)
    turnless = [(c, 0, "u", "only") for c in range(301, 330)]  # heads reach past their only turn, and there is no conversation 300
    assert trie_rows(conversation_trie.trie(frame(spark, turnless))) == brute_nodes(turnless)


def test_trie_sql(spark):
    con = connect(SF)
    assert not differences(queries.op13_conversation_trie(spark, SF), con, queries.oracle_sql()["op13_conversation_trie"])
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(queries.op13_conversation_trie(spark, SF)) == brute_nodes(rows)

"""Document operators on small tables: brute force, round trips, nulls, ties, repeats, clashing names."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sellerlens.llm import binary_ids, components, licences, line_dedup, minhash, mixing, packing, queries, tokens, toxicity
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, source string, n_chars long, n long, class string, row string, before long, part int"


def docs(spark, rows):
    """Rows of (id, text, source) with further columns named like the operators' own."""
    return spark.createDataFrame([(i, t, s, len(t or ""), 7, "c", "r", 3, 1) for i, t, s in rows], KINDS)


def words(rng, n):
    return " ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    passage = words(rng, 60)
    rows = [(k, words(rng, rng.choice([0, 1, 3, 5, 30, 90])), f"s{k % 3}") for k in range(40)]
    base = words(rng, 260)
    for k in range(40, 110):  # near copies, more than a list of common values holds
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9999))
        rows.append((k, " ".join(w), "s0"))
    rows += [(k, passage + " " + words(rng, rng.choice([4, 8, 40])), "s1") for k in range(110, 180)]
    rows += [(200, None, "s0"), (201, "", None), (202, " \t\n", "s0"), (None, base, "s0"), (203, base, "s2"), (203, base, "s2"),
             (204, "Four words UPPER É", "s1"), (205, "four words upper É", "s1"), (206, "x" * 200_000, "s1"), (207, words(rng, 6000), "s1")]
    return rows


def brute_components(rows, percent=85):
    sets = {}
    for i, t, _ in rows:
        w = bytes((t or "").encode()).lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_minhash_equals_brute_force(spark, corpus):
    want = brute_components(corpus)
    got = minhash.near_duplicates(docs(spark, corpus)).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert len({want[k][1] for k in range(40, 110)}) < 10  # the group is there


def test_minhash_keeps_one_of_each_group(spark, corpus):
    table = docs(spark, corpus)
    kept = minhash.without_copies(table)
    assert kept.columns == table.columns
    want = brute_components(corpus)
    assert {r["doc_id"] for r in kept.collect()} == {None} | {i for i, (_, c) in want.items() if i == c}
    assert minhash.near_duplicates(table.where("false")).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 199)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100, 199: 199, 200: 199}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def reference_ids(rows):
    encoder = tokens.encoder(tokens.vocabulary_path())
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    return [(i, encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in ordered]


def test_word_encoder_is_the_library():
    encoder = tokens.encoder(tokens.vocabulary_path())
    rng = random.Random(3)
    signs = "aZéÀßſİŉ.,'’1²-<|> \n\tdsmΣς́\x1c\x85"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|startoftext|>", "It's don't THEY'LL", "", "3.14 ... ?!,", "ÀÉ ß æ"]
    for t in texts:
        assert encoder.encode(t).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2], t


def test_pack_and_unpack():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], dtype=np.uint32)
    for n in range(len(values) + 1):
        assert binary_ids.unpack(*binary_ids.pack(values[:n]), n).tolist() == values[:n].tolist()


def test_binary_ids_round_trip(spark, corpus):
    ids, ranks = binary_ids.write_ids(docs(spark, corpus))
    got = sorted(binary_ids.read_ids(ids, ranks).collect(), key=lambda r: r["start"])
    want, start = reference_ids(corpus), 0
    assert [(r["doc_id"], list(r["ids"])) for r in got if r["doc_id"] != 203] == [w for w in want if w[0] != 203]
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    sums = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in binary_ids.checksums(ids, ranks).collect()}
    assert sums == {(r["doc_id"], r["start"]): tokens.crc(np.array(r["ids"])) for r in got}
    assert binary_ids.checksums(*binary_ids.write_ids(docs(spark, []))).count() == 0


def test_packing(spark, corpus):
    rows = [tuple(r) for r in packing.pack_documents(docs(spark, corpus)).select(
        "sequence_id", "offset", "doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens").collect()]
    rows.sort(key=lambda r: (r[0], r[1]))
    at = {}
    for sequence, offset, _, _, length, ids, crc, _ in rows:
        assert at.get(sequence, 0) == offset and length == len(ids) and tokens.crc(np.array(ids)) == crc
        at[sequence] = offset + length
    assert max(at.values()) <= packing.WINDOW and sorted(at) == list(range(len(at)))
    stream = [x for _, ids in reference_ids(corpus) for x in ids]
    assert [x for r in rows for x in r[5]] == stream
    assert packing.WINDOW * (len(at) - 1) - len(stream) < 0.03 * len(stream)
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(1)
    for _ in range(50):
        at = np.array(sorted({0, *rng.sample(range(1, 60), 20), *range(5, 60, 5)}))
        cost = np.array([0] + [rng.randint(0, 9) for _ in at[1:]])
        best = [0] + [None] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + 10 - (at[j] - at[i]) + cost[j] for i in range(j) if at[j] - at[i] <= 10)
        ends = packing.cuts(at, cost, 10)
        total = sum(10 - n for n in np.diff([0, *ends])) + sum(cost[np.searchsorted(at, ends)])
        assert total == best[-1] and np.diff([0, *ends]).max() <= 10 and ends[-1] == at[-1]


def test_line_dedup(spark):
    rows = [(k, f"menu\nown {k}\n  menu \n\nfooter" if k < 12 else f"own {k}\nrare", "a") for k in range(40)]
    rows += [(100, None, "a"), (101, "", "a"), (102, "menu", "a"), (103, "menu", "b"), (104, "menu\nx", None), (105, "menu\nx", None)]
    table = docs(spark, rows)
    out = line_dedup.without_boilerplate(table, size="n_chars")
    assert out.columns == table.columns and out.count() == len(rows)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[3] == ("own 3\n", 6) and got[20] == ("own 20", 6) and got[100] == (None, 0) and got[101] == ("", 0)
    assert got[102] == ("", 0) and got[103] == ("menu", 4) and got[104] == ("menu\nx", 6)
    assert line_dedup.without_boilerplate(table.where("false")).count() == 0


def test_boilerplate_of_small_hosts_and_white_space(spark):
    rows = [(k, f"own {k}\nfooter", "nine") for k in range(9)]
    rows += [(100 + k, f"menu{chr(13) if k % 2 else ''}\nown {k}\n{chr(9)}about {chr(11)}", "white") for k in range(16)]
    rows += [(200, "twice", "two"), (201, "twice", "two"), (300, "same", "rep"), (300, "same", "rep"), (300, "same", "rep"), (400, "x" * 3_000_000 + "\nfooter", "nine")]
    table = docs(spark, rows).withColumn("a.b", F.lit(1))
    out = line_dedup.without_boilerplate(table, size="n_chars")
    assert out.columns == table.columns
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert [got[k] for k in range(9)] == [[f"own {k}"] for k in range(9)] and got[400] == ["x" * 3_000_000]
    assert [got[100 + k] for k in range(16)] == [[f"own {k}"] for k in range(16)]
    assert got[200] == ["twice"] and got[300] == ["", "", ""]  # repeated rows are pages each


def test_notices_in_long_lines(spark):
    found = lambda t: [(r["line_no"], r["licence"]) for r in licences.scan(docs(spark, [(1, t, "s"), (1, t, "s")])).collect()]
    want = found("Released under the MIT License.")
    assert len(want) == 2 and want[0] == want[1]
    for more in ("-" * 3000, " " * 3000, "*" * 800, " " + "=" * 2000):
        assert found("Released under the MIT License." + more) == want
        assert found(more + "Released under the MIT License.") == want


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(k, words(rng, 50), "big") for k in range(900)] + [(k, words(rng, 50), "small") for k in range(900, 930)]
    rows += [(k, words(rng, 50), None) for k in range(930, 990)] + [(990, None, "none"), (990, "", "none"), (None, "a b", "small")]
    table = docs(spark, rows)
    plan = {r["source"]: r for r in mixing.weights(table).collect()}
    weight = np.array([r["weight"] for r in plan.values() if r["weight"]])
    shares = np.array([r["n_tokens"] for r in plan.values() if r["n_tokens"]]) / sum(r["n_tokens"] for r in plan.values())
    entropy = lambda p: -(p * np.log(p)).sum()
    by_entropy = abs(entropy(weight) - (entropy(shares) + np.log(len(shares))) / 2) < 1e-6
    small = plan["small"]
    assert by_entropy or abs(small["share"] / small["n_tokens"] - mixing.REPEATS) < 0.01
    taken = mixing.mixture(table)
    got = {r["s"]: r for r in taken.groupBy(F.col("row.source").alias("s")).agg(F.sum("n_tokens").alias("t"), F.max("epoch").alias("e")).collect()}
    for s in ("big", "small", None):
        assert 0 <= got[s]["t"] - plan[s]["share"] < 51
    assert got["small"]["e"] >= 1 and "none" not in got
    assert taken.groupBy("row.doc_id", "row.text", "epoch").count().where("count > 1").count() == 0
    assert mixing.mixed(table).columns == table.columns
    assert mixing.mixed(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, [(1, None, "a")])).count() == 0


def test_sums_before_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), b % 3, b, rng.randrange(9), "%032x" % (rng.randrange(4000) if b % 2 else rng.getrandbits(128))) for b in range(3000)]
    got = {tuple(r[:3]): r[3] for r in mixing._sums_before(spark.createDataFrame(rows, "source string, epoch long, b long, size long, order string")).collect()}
    before, want = Counter(), {}
    for source, epoch, b, size, _ in sorted(rows, key=lambda r: (r[4], r[2])):
        want[source, epoch, b] = before[source, epoch]
        before[source, epoch] += size
    assert got == want


def test_every_epoch_has_its_own_order(spark):
    rng = random.Random(7)
    rows = [(k, words(rng, 30), "big") for k in range(700)] + [(k, words(rng, 30), "small") for k in range(700, 760)]
    taken = mixing.mixture(docs(spark, rows).withColumn("a.b", F.lit(1)))
    order = {}
    for r in taken.select("row.doc_id", "row.source", "epoch", "before", "n_tokens").collect():
        order.setdefault((r["source"], r["epoch"]), []).append((r["before"], r["n_tokens"], r["doc_id"]))
    whole = [sorted(v) for (s, _), v in sorted(order.items()) if s == "small" and len(v) == 60]
    assert len(whole) >= 2
    for epoch in whole:  # gapless: every row begins where the one before it ends
        assert [b for b, _, _ in epoch] == [sum(n for _, n, _ in epoch[:k]) for k in range(60)]
    assert len({tuple(i for _, _, i in epoch) for epoch in whole}) == len(whole)
    places = {}
    for epoch in whole:
        for b, _, i in epoch:
            places.setdefault(i, set()).add(b)
    assert sum(len(p) > 1 for p in places.values()) > 50


def test_null_ids_are_dealt_over_blocks_and_parts(spark):
    rng = random.Random(8)
    table = docs(spark, [(None, words(rng, 20), "s") for _ in range(900)])
    assert mixing.mixture(table).select("block").distinct().count() > 2
    from sellerlens.llm import shared

    ordered = shared.in_id_order(table, "doc_id", "text", chars_each=10_000)
    sizes = [r["count"] for r in ordered.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 5 and max(sizes) < 300
    texts = [r["text"] for r in ordered.collect()]
    assert texts == sorted(texts)


@pytest.mark.parametrize("key", list(queries.oracle_sql()))
def test_sql(spark, key):
    con = connect(SF)
    assert differences(queries.queries()[key](spark, SF), con, queries.oracle_sql()[key]) == []


def test_grammar():
    machine = toxicity.grammar()
    score = {s: machine.score(s) for s in ("ooo", "oIo", "ToI", "NoI", "NoooooI", "RoI", "RoTNI", "ToK", "K", "RNK", "II")}
    assert score["ooo"] == 0 and score["ToI"] > score["oIo"] > score["NoI"] > 0 and score["NoooooI"] == score["oIo"]
    assert score["RoI"] < score["oIo"] and score["RoTNI"] < score["ToI"] and score["ToK"] > score["K"] > score["RNK"] and score["II"] > score["oIo"]


def test_toxicity(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for k in range(400):
        toxic = k % 8 == 0
        text = words(rng, 40) + (f". {words(rng, 3)} grumbix{rng.choice('abcdefgh')} {words(rng, 3)}." if toxic else ".")
        rows.append((k, text, "s"))
        marks.append((k, int(toxic)))
    rows += [(500, None, "s"), (501, "", "s"), (None, "you idiot", "s"), (502, "you idiot " * 20_000, "s"), (503, "fine", "s"), (503, "fine", "s")]
    marks += [(None, 1), (503, None), (3, 0), (9999, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.toxicity(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    import zlib
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert r["predicted"] == (r["doc_id"] % 8 == 0)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert by[500] == by[501] == by[503] == 0 and by[None] == by[502] == 1
    plain = toxicity.toxicity(docs(spark, rows[-3:]), labels.where("false")).collect()
    assert [r["predicted"] for r in plain] == [1, 0, 0]
    assert toxicity.without_toxic(docs(spark, []), labels).count() == 0


def test_licences(spark):
    rows = [(1, "Text.\nReleased under the MIT licence.\nmore", "a"), (2, "Some words of a page. Licensed under CC BY-NC 4.0. Then more words that go on.", "a"),
            (3, "nothing here\nunder the", "a"), (4, None, "a"), (5, "", "a"), (None, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3", "a"), (6, "x " * 100_000, "a")]
    got = {(r["doc_id"], r["line_no"], r["licence"]): r["dice"] for r in licences.scan(docs(spark, rows)).collect()}
    assert set(got) == {(1, 1, "MIT"), (2, 0, "CC-BY-NC-4.0"), (None, 0, "GPL-3.0")} and got[1, 1, "MIT"] == 1
    assert licences.scan(docs(spark, rows), templates=[]).count() == 0 and licences.scan(docs(spark, [])).count() == 0


def test_licences_equal_brute_force():
    known = licences.Templates(licences.TEMPLATES, licences.DICE)
    rng = random.Random(6)
    for _ in range(2000):
        w = licences.words(rng.choice(licences.TEMPLATES)[1])
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["the", "of", "x"]))
        b = licences.bigrams(w)
        scores = [2 * len(b & t) / (len(b) + n) for n, _, t in known.sets]
        found = known.best(" ".join(w))
        assert (found[0] if found else None) == (max(scores) if max(scores) >= licences.DICE else None)


def test_licences_after_a_short_sentence():
    known = licences.Templates(licences.TEMPLATES, licences.DICE)
    text = "Enjoy the show. Licensed under CC BY 4.0.\nThanks to all who helped. Licensed under CC BY 4.0.\nNo. Yes!"
    assert list(known.lines(text)) == [(0, "CC-BY-4.0", 1.0), (1, "CC-BY-4.0", 1.0)]


def test_licence_bodies_and_wrapped_notices(spark):
    import textwrap

    rows = []
    for k, (_, body) in enumerate(licences.BODIES):
        rows += [(2 * k, "Some words first.\n\n" + textwrap.fill(body, 40 + 5 * k) + "\n\nOther words follow here.", "a"), (2 * k + 1, body, "a")]
    rows += [(100, "About it\nThis work is licensed under the GNU General\nPublic License, version 3.\nmore", "a"),
             (101, "It was late.\nHe said it is licensed under the sun\nand went home.", "a"), (102, "Released under the MIT License.\nIt is short.", "a")]
    got = {(r["doc_id"], r["line_no"], r["licence"]): r["dice"] for r in licences.scan(docs(spark, rows)).collect()}
    for k, (name, _) in enumerate(licences.BODIES):
        assert got.get((2 * k, 2, name), 0) > 0.95 and got.get((2 * k + 1, 0, name), 0) > 0.95, name
    assert (100, 1, "GPL-3.0") in got and got[102, 0, "MIT"] == 1 and not any(i == 101 for i, _, _ in got)
    assert sum(i in (100, 102) for i, _, _ in got) == 2


def test_runs_equal_brute_force():
    runs = licences.Runs(licences.TEMPLATES, licences.BODIES, licences.DICE)
    rng = random.Random(8)
    for _ in range(60):
        w = licences.plain_words(rng.choice(licences.TEMPLATES + licences.BODIES)[1])
        for _ in range(rng.randint(0, len(w) // 6)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["the", "of", "x"]))
        w = ["some", "words", *w, "and", "more"]
        lines, at = [], 0
        while at < len(w):
            n = rng.randint(1, 9)
            lines.append(w[at : at + n])
            at += n
        best = 0
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                b = licences.bigrams(sum(lines[i : j + 1], []))
                best = max([best, *(2 * len(b & t) / (len(b) + len(t)) for _, t, one in runs.sets if one or j > i)])
        found = runs.found("\n".join(" ".join(x) for x in lines))
        assert max((f[0] for f in found), default=None) == (best if best >= licences.DICE else None)


def test_minhash_lists_classes_with_rare_tails_under_common_values(spark):
    shared = list(range(1000, 1020))  # on 60 classes, each with 12 smaller values of its own
    rows = [(k, [100_000 * -k - n for n in range(12, 0, -1)] + shared) for k in range(1, 61)]
    keys = minhash._keys(spark.createDataFrame(rows, "node long, sketch array<long>"), 85).where("v >= 1000")
    assert keys.select("node").distinct().count() == 60
    assert minhash.rare_keys(85) > 16 and minhash.common_keys(85) == 8


def test_other_vocabularies_are_encoded_whole():
    from tokenizers import Tokenizer

    texts = ["The Word  the word", "It's 12 o'clock!", "Grüße, Straße\n\tx", "", "a<|endoftext|>b"]
    for name, by_words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = tokens.vocabulary_path(name)
        encoder, library = tokens.WordEncoder(path), Tokenizer.from_file(path)
        assert encoder.by_words is by_words
        for t in texts:
            assert encoder.encode(t).tolist() == [*library.encode(t, add_special_tokens=False).ids, tokens.END]

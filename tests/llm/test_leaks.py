import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linkloom.llm import leaks as L
from linkloom.llm import queries
from linkloom.llm.fm_index import FMIndex, WaveletMatrix

ITEM = "item_id long, suite string, text string, answer string"
ASK = "Read the listing below and choose. Whenever Morba receives an owner whose `fan_in` is above 622, it must level-check the dangling marker before Draum can split it, and then report both of them to the team."
SAY = "Only the canonical anchor matters: Draum copies its score into Morba, which leaves 812 mirrors and one footer."


def pairs(spark, docs, items=((1, "s", ASK, SAY),)):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumns({"words": F.lit(1), "key": F.lit("k"), "item_id": F.lit(9)})
    return {(r.doc_id, r.item_id) for r in L.leaked_pairs(d, spark.createDataFrame(list(items), ITEM)).collect()}


def test_forms_of_a_leak(spark):
    words = ASK.split()
    thinned = " ".join(w for i, w in enumerate(words) if i % 6)
    swapped = " ".join("zebra" if i % 6 == 3 else w for i, w in enumerate(words))
    docs = [
        f"intro {ASK} outro", ASK.upper(), ASK.replace("`", "").replace(" ", "\n> "), "<p>" + ASK.replace("Morba", "<b>Morba</b>").replace("`", "&quot;") + "</p>", ASK.replace("_", "\\_"),
        '{"prompt": "x", "completion": "' + SAY + '"}', " ".join(words[9:21]), " ".join(words[9:20]), thinned, swapped, " ".join("zebra" if i % 3 == 0 else w for i, w in enumerate(words)),
        "Read the listing below and choose.", None, "", "!!!", ASK.replace("level-check", "level-\ncheck"), "nothing of the kind " * 5000 + SAY, ASK, ASK,
    ]
    assert pairs(spark, docs) == {(i, 1) for i in (0, 1, 2, 3, 4, 5, 6, 8, 9, 15, 16, 17, 18)}


def test_numbers_of_a_listing_are_layout(spark):
    words = ASK.split()[6:24]
    listed = "\n".join(f"{80 + i}: " + " ".join(words[6 * i : 6 * i + 6]) for i in range(3))
    once = " ".join(words[:6]) + "\n731: " + " ".join(words[6:])
    assert pairs(spark, [listed, once]) == {(0, 1), (1, 1)}
    assert L.words_of(pa.array(["731: a b\nc", "1: a\n 2: b", "7 | a\n8 | b"])).to_pylist() == [["731", "a", "b", "c"], ["a", "b"], ["a", "b"]]


def test_empty_tables_and_null_items(spark):
    assert pairs(spark, []) == set()
    assert pairs(spark, [ASK, SAY], [(1, "s", None, None), (2, "s", "", "!"), (None, "s", ASK, SAY)]) == set()
    assert pairs(spark, [ASK], [(1, "s", ASK, None), (2, "s", ASK, SAY)]) == {(0, 1), (0, 2)}
    assert L.leaks(spark.createDataFrame([(1, ASK)], "doc_id long, text string"), spark.createDataFrame([], ITEM)).count() == 0


def test_blocks_of_items_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEMS_PER_BLOCK", 2)
    monkeypatch.setattr(L, "SHARD_WORDS", 10)
    items = [(i, "s", ASK.replace("Morba", f"Morba{i}").replace("622", str(i)), SAY.replace("Draum", f"x{i}")) for i in range(7)]
    got = pairs(spark, [t for _, _, t, _ in items], items)
    assert {(i, i) for i in range(7)} <= got


def test_spans_are_merged(spark):
    found = spark.createDataFrame([(1, 5, 0, 12), (1, 6, 10, 30), (1, 5, 40, 52), (2, 5, 3, 20)], "doc_id long, item_id long, first_word long, end_word long")
    got = {tuple(map(lambda x: tuple(x) if isinstance(x, list) else x, r)) for r in L.removal_spans(found).collect()}
    assert got == {(1, 0, 30, (5, 6)), (1, 40, 52, (5,)), (2, 3, 20, (5,))}


def test_index_against_a_scan():
    rng = np.random.default_rng(2)
    for codes in (1, 2, 5, 300):
        seq = np.concatenate([[0], rng.integers(0, codes + 1, 700), np.tile([1, min(2, codes)], 80), [0]])
        index = FMIndex(seq, codes)
        phrases = np.array([seq[i : i + 3] for i in range(len(seq) - 3) if seq[i : i + 3].all()] + [[codes] * 3])
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi, strict=True):
            want = [i for i in range(len(seq) - 2) if (seq[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
        matrix = WaveletMatrix(seq, codes)
        at = np.arange(len(seq) + 1)
        for c in {0, 1, codes}:
            assert matrix.rank(np.full(len(at), c), at).tolist() == [0, *np.cumsum(seq == c).tolist()]


def test_common_words_against_a_table():
    rng = random.Random(3)
    for _ in range(200):
        a, b = [[rng.randrange(5) for _ in range(rng.randrange(1, 20))] for _ in "ab"]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert L._common(np.array(a), np.array(b)) == row[-1]


def test_words():
    got = L.words_of(pa.array(["It’s <b>so</b>me_thing &quot;A-B&quot;\\nＷide, ", "", "…", "x"])).to_pylist()
    assert got == [["its", "something", "ab", "wide"], [], [], ["x"]]


def test_given_data_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").select("doc_id", "text").toPandas()
    items = spark.read.parquet(f"{sf}/eval_items.parquet").toPandas()
    grams = {}
    for i, t, a in zip(items.item_id, L.words_of(pa.array(items.text)).to_pylist(), L.words_of(pa.array(items.answer)).to_pylist(), strict=True):
        for p in (t, a):
            for k in range(len(p) - 11):
                grams.setdefault(tuple(p[k : k + 12]), set()).add(i)
    want = {(d, i) for d, w in zip(docs.doc_id, L.words_of(pa.array(docs.text)).to_pylist(), strict=True) for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    got = {(r.doc_id, r.item_id) for r in queries.p7_found(spark, sf).collect()}
    assert want <= got and len(got) <= len(want) + 5


def test_every_pattern_of_lost_and_added_words(spark):
    short = "alpha bravo carol delta eagle frost grape hotel india joker karma lemon mango north opera piano queen river sugar tiger".split()
    long = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    fifth = " ".join(w for i, w in enumerate(short) if i not in (4, 8, 12, 16))  # runs of 4, 3, 3, 3 and 3 words
    added = lambda ws: " ".join(x for i, w in enumerate(ws) for x in ([w, "zebra"] if i % 3 == 2 else [w]))
    both = added([w for i, w in enumerate(long) if i % 5])
    less = " ".join(w for i, w in enumerate(short) if i not in (3, 6, 9, 12, 16))
    mixed = " ".join(short[::-1])
    far = " ".join(w + " zebra" * 3 for w in short)
    docs = [fifth, added(short), added(long), both, less, mixed, far, "intro " * 999 + both, "the " * 80 + fifth + " the" * 80, fifth.upper()]
    items = [(1, "s", " ".join(short), None), (2, "s", None, " ".join(long))]
    assert pairs(spark, docs, items) == {(0, 1), (1, 1), (2, 2), (3, 2), (7, 2), (8, 1), (9, 1)}


def test_stretches_against_every_window(monkeypatch):
    rng = random.Random(4)
    for trial in range(60):
        monkeypatch.setattr(L, "_ROWS", rng.choice([3, 50, 100_000]))
        monkeypatch.setattr(L, "_GROUP", rng.choice([1, 2, 512]))
        words = [f"w{i}" for i in range(rng.choice([4, 12, 40]))]
        parts = [(i, [rng.choice(words) for _ in range(rng.choice([1, 4, 9, 20, 33]))]) for i in range(3)]
        p = L._Phrases(parts)
        docs = []
        for _ in range(6):
            base = [w for w in rng.choice(parts)[1] if rng.random() > 0.12]
            docs.append([x for w in base for x in [w] + ["none"] * (rng.random() < 0.3)] + [rng.choice(words) for _ in range(rng.choice([0, 3, 60]))])
            rng.random() < 0.4 and docs[-1].reverse()
        docs = [d for d in docs if d]
        code = {w: i + 1 for i, w in enumerate(p.words.to_pylist())}
        codes = np.array([code.get(w, 0) for d in docs for w in d], np.int64)
        starts = np.cumsum([0] + [len(d) for d in docs[:-1]])
        want = set()
        for d, s in enumerate(starts):
            own = codes[s : s + len(docs[d])]
            for k, part in enumerate(p.parts):
                reach = int(len(part) * L.STRETCH) + 2
                if any(L._common(part, own[i : i + reach]) >= p.need[k] for i in range(len(own))):
                    want.add((d, k))
        found = list(L._whole(p, codes, starts, set()))
        assert {f[:2] for f in found} == want and len(found) == len(want)
        assert all(L._common(p.parts[k], codes[a:b]) >= p.need[k] and codes[a] and codes[b - 1] for _, k, a, b in found)


def test_wording_shared_by_many_items_is_not_multiplied(monkeypatch):
    stock = [f"stock{i}" for i in range(30)]
    parts = [(i, stock + [f"own{i}x{j}" for j in range(14)]) for i in range(300)]
    p = L._Phrases(parts)
    code = {w: i + 1 for i, w in enumerate(p.words.to_pylist())}
    docs = [parts[7][1], stock[:11], parts[7][1][20:40], stock[:6] + ["none"] + stock[6:]]
    codes = np.array([code.get(w, 0) for d in docs for w in d], np.int64)
    starts = np.cumsum([0] + [len(d) for d in docs[:-1]])
    found = list(L._verbatim(p, codes, starts))
    # all 300 share more than twelve words with the first and the last document; the third has only ten of them
    assert {f[:2] for f in found} == {(0, k) for k in range(300)} | {(2, 7)} | {(3, k) for k in range(300)}
    assert {f[2:] for f in found if f[0] == 0 and f[1] == 7} == {(0, 44)} and {f[2:] for f in found if f[0] == 2} == {(55, 75)}


def test_passages_against_every_window():
    rng = random.Random(11)
    for _ in range(80):
        words = [f"w{i}" for i in range(rng.choice([2, 5, 40]))]
        parts = [(i, [rng.choice(words) for _ in range(rng.choice([3, 12, 13, 30, 60]))]) for i in range(4)]
        docs = [[x for _ in range(3) for x in [rng.choice(words) for _ in range(rng.randrange(5))] + (lambda p, a: p[a : a + rng.randrange(30)])(rng.choice(parts)[1], rng.randrange(20))] + ["none"] for _ in range(5)]
        p = L._Phrases(parts)
        code = {w: i + 1 for i, w in enumerate(p.words.to_pylist())}
        codes = np.array([code.get(w, 0) for d in docs for w in d], np.int64)
        starts = np.cumsum([0] + [len(d) for d in docs[:-1]])
        want = {(d, k) for d, text in enumerate(docs) for k, (_, part) in enumerate(parts) for i in range(len(text) - 11) for j in range(len(part) - 11) if text[i : i + 12] == part[j : j + 12]}
        found = list(L._verbatim(p, codes, starts))
        assert {f[:2] for f in found} == want
        assert all(b - a >= 12 for *_, a, b in found)

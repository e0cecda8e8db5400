import itertools
import random

import numpy as np
import pyarrow as pa

from tessera.llm import p4_near_copies as near
from tessera.llm.groups import connected

SCHEMA = "scrape_id bigint, markdown string, rep string, id int, symbols string"


def _sets(texts):
    out = {}
    for k, t in texts:
        words = near.WORDS.findall((t or "").lower())
        if t is not None and len(words) >= near.LEAST_WORDS:
            out[k] = set(zip(*(words[i:] for i in range(5))))
    return out


def _truth(texts, least):
    sets = _sets(texts)
    return {(min(a, b), max(a, b)) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def _texts(n=60, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts, k = [], 0
    for _ in range(n):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 4)):
            edited = list(base)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(edited))
                if rng.random() < 0.5:
                    edited[at] = word()
                else:
                    edited.insert(at, word())
            texts.append((k, " ".join(edited)))
            k += 1
    return texts


def test_pairs_and_groups_against_brute_force(spark):
    texts = _texts()
    texts += [(900, texts[0][1].upper()), (901, None), (902, ""), (903, "too short"), (None, texts[0][1])]
    df = spark.createDataFrame([(k, t, "r", 1, "s") for k, t in texts + texts[:4]], SCHEMA)
    for least in (0.6, 0.8):
        wanted = _truth([x for x in texts if x[0] is not None], least)
        got = {(r.scrape_a, r.scrape_b) for r in near.near_pairs(df, least=least).collect()}
        assert not got - wanted and len(got & wanted) >= 0.97 * len(wanted)
        assert near.near_pairs(df, least=least).count() == len(got)
    rows = {r.scrape_id: r for r in near.near_groups(df, least=0.6).collect()}
    assert rows.keys() == _sets([x for x in texts if x[0] is not None]).keys()
    assert rows[900].class_id == rows[0].class_id == 0
    found = {(r.scrape_a, r.scrape_b) for r in near.near_pairs(df, least=0.6).collect()}
    assert all(rows[a].group_id == rows[b].group_id for a, b in found)
    assert near.near_pairs(df.where("false")).count() == 0 and near.near_groups(df.where("false")).count() == 0


def test_all_pairs_of_different_texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(90)]
    forms = [" ".join(words), " ".join(words).upper(), ", ".join(words), "# " + " ".join(words), "**" + " ".join(words) + "**", "\n".join(words)]  # one set of shingles
    edited = " ".join(words[:-2] + ["other", "end"])
    texts = list(enumerate([*forms, forms[1], forms[1], forms[2], edited, edited, edited.upper()]))
    df = spark.createDataFrame([(k, t, "r", 1, "s") for k, t in texts + texts[:3]], SCHEMA)
    lowest = {t: k for k, t in reversed(texts)}
    short = {(a, b) for (a, t), (b, u) in itertools.combinations(texts, 2) if t == u and lowest[t] != a}  # copies neither of which is the lowest
    rows = [(r.scrape_a, r.scrape_b) for r in near.near_pairs(df, least=0.6).collect()]
    assert short and len(rows) == len(set(rows)) and set(rows) == _truth(texts, 0.6) - short


def test_code_words_of_fingerprints():
    rng = np.random.default_rng(2)
    words = rng.integers(0, near.MODULUS, (40, near.N_SYMBOLS))
    for agree in range(near.N_SYMBOLS + 1):
        other = rng.integers(0, near.MODULUS, near.N_SYMBOLS)
        other[:agree] = words[0][:agree]
        met = set(near.anchors(words[:1])[0]) & set(near.anchors(other[None])[0])
        assert bool(met) == (agree >= near.DIMENSION)  # they meet exactly within the covering radius
    code_word = np.array([[(5 + 7 * x + 11 * x * x) % near.MODULUS for x in range(1, near.N_SYMBOLS + 1)]])
    assert len(set(near.anchors(code_word)[0])) == 1  # all choices of symbols of a code word give that word


def test_runs_across_batches_and_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(near, "RUN", 6)
    monkeypatch.setattr(near, "BLOCK", 6)
    keys = [1] * 5 + [2] + [3] * 15 + [4] * 2 + [5] * 7
    ids = list(range(len(keys)))
    for size in (1, 4, 7, 100):
        batches = (pa.RecordBatch.from_arrays([pa.array(keys[a : a + size], pa.int64()), pa.array(ids[a : a + size], pa.int64())], names=["anchor", "id"]) for a in range(0, len(keys), size))
        rows = [r for b in near._pairs_of_runs(batches) for r in zip(*(c.to_pylist() for c in b.columns))]
        pairs = {(a, b) for a, b, k in rows if k is None}
        hot = {(k, a) for a, b, k in rows if k is not None}
        small = [(k, [i for i, x in zip(ids, keys) if x == k]) for k in (1, 4)]
        assert pairs == {p for _, m in small for p in itertools.combinations(m, 2)}
        assert hot == {(k, i) for i, k in zip(ids, keys) if k in (3, 5)}
    members = spark.createDataFrame([(k, i) for k, i in sorted(hot)], "anchor bigint, id bigint")
    sets = spark.createDataFrame([(i, bytearray(np.arange(5, dtype=np.uint64).tobytes())) for i in ids], "id bigint, set binary")  # all alike
    got = [(r.a, r.b) for r in near._hot_links(members, sets, 0.6).collect()]
    wanted = [p for k in (3, 5) for p in itertools.combinations([i for i, x in zip(ids, keys) if x == k], 2)]
    assert sorted(got) == sorted(wanted)


def test_connected(spark):
    links = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (5, 5), (3, 1)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.id: r.group_id for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 10, 15)} == {1: 1, 2: 1, 3: 1, 10: 10, 15: 10} and got[140] == 100 and 5 not in got
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hot_anchors_give_the_same_links(spark, monkeypatch):
    texts = _texts(40, seed=9)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(200)]
    for k in range(90):  # one template with edits: every anchor of its symbols is hot
        edited = list(base)
        for _ in range(rng.randint(0, 12)):
            edited[rng.randrange(200)] = f"x{rng.randrange(10_000)}"
        texts.append((2_000 + k, " ".join(edited)))
    texts = list({t: (k, t) for k, t in reversed(texts)}.values())  # links are between different texts
    df = spark.createDataFrame([(k, t, "r", 1, "s") for k, t in texts], SCHEMA)
    truth = _truth(texts, 0.6)
    for run, block, few in ((64, 2_048, 8), (1, 2_048, 3), (4, 10, 100), (30, 25, 8)):
        monkeypatch.setattr(near, "RUN", run)
        monkeypatch.setattr(near, "BLOCK", block)
        monkeypatch.setattr(near, "FEW", few)
        links = [(r.a, r.b) for r in near.near_links(df, least=0.6)[0].collect()]
        assert near.meetings(near.classes_of(df), 0.6)[1].isEmpty() == (run == 64)
        assert len(links) == len(set(links)) and set(links) <= truth and len(links) >= 0.98 * len(truth)


def test_common_shingles_against_sets(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(near, "SLICE", 7)
    for few in (2, 5, 50):
        monkeypatch.setattr(near, "FEW", few)
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(30)]
        for left, right in ((np.arange(30), np.arange(30)), (np.arange(12), np.arange(12, 30))):
            got = near._common(sets, left, right)
            wanted = [[len(set(sets[i].tolist()) & set(sets[j].tolist())) for j in right] for i in left]
            for x, i in enumerate(left):
                for y, j in enumerate(right):
                    assert i == j or got[x, y] == wanted[x][y]

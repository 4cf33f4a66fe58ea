import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from memgate.llm import ngram_join


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def variants(rng, words, n, edits):
    """Texts of which many share most shingles: long posting lists with several components."""
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice("pqrstuvw") * rng.randint(2, 6)
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocab) for _ in range(120)]
    texts = variants(rng, base, 60, 6) + variants(rng, base[:90] + [rng.choice(vocab) for _ in range(30)], 40, 4)
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    passage = " ".join(base[:30])
    texts += [passage + " " + " ".join(rng.choice(vocab) for _ in range(80)) for _ in range(30)]
    texts += texts[:10] + [None, "", "  \n\t", "one two", "ONE two", "a a a a a a a a", "é ü ß", "x" * 5000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_classes(docs).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, None, 1), (None, "a b c d e f", 2), (7, "a b c d e f", 3), (7, "a b c d e f", 4)]])
def test_nulls_and_repeats(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.similar_classes(docs).collect())
    assert got == ([] if not rows else [(-1, 0, -1), (-1, 2, 7), (7, 2, 7), (7, 2, 7)])
    kept = sorted((r.doc_id or -1, r.n_shingles) for r in ngram_join.representatives(docs).collect())
    assert kept == ([] if not rows else [(-1, 1), kept[1]]) and (not rows or kept[1] in ((7, 3), (7, 4)))


def test_representatives_are_rows_not_ids(spark):
    """Ids that repeat with other texts lose none of them; copies with a null id go; rows equal in all columns count once."""
    a, b, c, d = ("a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, d), (7, d), (None, b), (None, "y z"), (None, "y z"), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame(rows, "_row long, row string").repartition(3)
    kept = sorted(((r[0] or -1), r[1] or "") for r in ngram_join.representatives(docs, "_row", "row").collect())
    assert kept == sorted([(1, a), (5, b), (7, c), (7, d), (-1, "y z"), (9, ""), (9, ""), (-1, "")])


def test_signatures_bound_the_overlap_from_above():
    """No pair that links may be ruled out, also where sets have many times the bitmap's bits."""
    rng = np.random.default_rng(5)
    for size in (1, 5, 300, 3000, 40000):
        pool = np.unique(rng.integers(0, 1 << 64, 2 * size, np.uint64, endpoint=False))
        for shared in (0.0, 0.5, 0.9, 1.0):
            k = int(len(pool) * shared)
            one, two = pool[: max(1, k + (len(pool) - k) // 2)], np.concatenate((pool[:k], pool[k + (len(pool) - k) // 2 :]))
            bits = ngram_join.Signatures(ngram_join.signatures([one, two, one[: len(one) // 3 + 1]]))
            for x, y in ((0, 1), (0, 2), (2, 1), (1, 1)):
                sets = (one, two, one[: len(one) // 3 + 1])
                differ = int(bits.differ(np.array([x]), np.array([y]))[0])
                assert differ <= len(np.setxor1d(sets[x], sets[y]))
            if shared == 0 and size > 1000:  # sets that share nothing are ruled out, however large
                total = len(one) + len(two)
                most = (total - int(bits.differ(np.array([0]), np.array([1]))[0])) // 2
                assert 100 * most < 80 * (total - most)
    assert ngram_join.signatures([]) == []


def test_representatives_where_nothing_is_broadcast(spark):
    rng = random.Random(8)
    texts = variants(rng, [f"w{rng.randrange(90)}" for _ in range(80)], 20, 3) + [None, "a b c d e f", "a b c d e f"]
    rows = [*enumerate(texts), (21, "a b c d e f"), (None, "a b c d e f")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = [r.doc_id for r in ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = [i for i, (_, c) in brute(list(enumerate(texts))).items() if i == c]
    assert sorted(kept) == sorted(want)


def as_list(sizes_blocks, sets, token=5):
    sigs = ngram_join.signatures(sets)
    rows = [(0, token, k, len(sets[k]), k, block, home, sigs[k]) for k, block, home in sizes_blocks]
    return pd.DataFrame(rows, columns=["tile", "token", "a", "n", "comp", "block", "home", "sig"])


@pytest.mark.parametrize("every", [True, False])
def test_open_pairs_of_blocks(every):
    """The linkable pair is found beside blocks without members at home, in either order, and for any token of a tile."""
    sets = [np.arange(100, dtype=np.uint64) << np.uint64(40), np.arange(1, 101, dtype=np.uint64) << np.uint64(40)]
    own = [(0, 0, True), (1, 0, True), (1, 0, False)]
    for order in (own + [(1, 1, False)], [(1, 1, False)] + own):
        pdf = as_list(order if every else [x for x in order if x[2]], sets)
        assert ngram_join.open_pairs(every)(pdf).values.tolist() == [[0, 1]]


def test_proposals_are_fewer_than_components():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 64, 60, np.uint64, endpoint=False)
    sets = [np.sort(np.concatenate((base[:56], rng.integers(0, 1 << 64, 4, np.uint64, endpoint=False)))) for _ in range(80)]
    pdf = as_list([(k, 0, True) for k in range(80)], sets)
    assert len(ngram_join.open_pairs(False)(pdf)) == 79
    both = as_list([(k, 0, True) for k in range(80)] + [(k, 0, False) for k in range(80)], sets)
    assert len(ngram_join.open_pairs(True)(both)) == 80 * 79 // 2


@pytest.mark.parametrize("block,heavy", [(16, 64), (2048, 3), (16, 3)])
def test_dense_groups_in_small_blocks(spark, monkeypatch, block, heavy):
    """Chains and families of near copies that no hub links, with lists cut into blocks and spare tiles."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(300)]
    base = [rng.choice(vocab) for _ in range(100)]
    texts = []
    for _ in range(6):  # walks away from one source: neighbours link, the ends do not
        w = list(base)
        for _ in range(25):
            w[rng.randrange(100)] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += variants(rng, base, 60, 9)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)

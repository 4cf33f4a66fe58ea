"""The pipeline against plain versions of its first two stages, and what each later stage must do to what it gets."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memgate.llm import pieces, queries
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and after each, as lists of dicts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [[r.asDict() for r in docs.collect()]]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
        out.append([r.asDict() for r in docs.collect()])
    return out


def plain_quality(rows):
    def fails(text):
        w = (text or "").encode().split()
        places, held = defaultdict(list), set()
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].append(k)
        for own in places.values():
            if len(own) > 1:
                held |= {k + j for k in own for j in range(8)}
        return len(w) < 20 or 100 * len(held) > 30 * len(w), len(w), sum(map(len, (x.decode() for x in w))), sum(c in "#*$%&|<>" for c in text or "")

    judged = [(r, *fails(r["text"])) for r in rows]
    hosts = defaultdict(lambda: [0, 0])
    for r, base, n, chars, symbols in judged:
        if r["source"] is not None:
            hosts[r["source"]][0] += 1
            hosts[r["source"]][1] += base or 10 * symbols > n or chars > 12 * n
    n, x = (np.array([h[k] for h in hosts.values()], float) for k in (0, 1))
    m = x.sum() / n.sum()
    rho = ((n * (x / n - m) ** 2).sum() - (len(n) - 1) * m * (1 - m)) / ((n.sum() - (n * n).sum() / n.sum() - (len(n) - 1)) * m * (1 - m))
    w = 1000 if rho <= 0.001 else 1 if rho >= 0.5 else 1 / rho - 1
    mean = (x + m * w) / (n + w)
    bad = {h for h, low in zip(hosts, mean - 2 * np.sqrt(mean * (1 - mean) / (n + w + 1))) if low > 0.8}
    return {r["doc_id"] for r, base, *_ in judged if not base and r["source"] not in bad}


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_quality(stages):
    assert ids(stages[1]) == sorted(plain_quality(stages[0]))


def test_near_duplicates(stages):
    comp = brute([(r["doc_id"], r["text"]) for r in stages[1]])
    assert ids(stages[2]) == sorted(i for i, (_, c) in comp.items() if c == i)


def test_decontamination(spark, stages):
    kept, items = set(ids(stages[3])), [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in stages[2]:
        whole = any(len(t.split()) >= 4 and t in (r["text"] or "") for t in items)
        assert not (whole and r["doc_id"] in kept)
    before = spark.createDataFrame([(r["doc_id"], r["text"]) for r in stages[2]], "doc_id long, text string")
    found = queries.decontam.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").distinct()
    assert kept == set(ids(stages[2])) - {r.doc_id for r in found.collect()}


def test_secrets_and_tokens(spark, stages):
    assert ids(stages[3]) == ids(stages[4]) == ids(stages[5])
    again = spark.createDataFrame([(r["doc_id"], r["text"]) for r in stages[4]], "doc_id long, text string")
    assert queries.secret_scan.scan(again).filter(F.size("spans") > 0).count() == 0
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    back = pieces.decode(spark.createDataFrame([(r["doc_id"], r["token_ids"]) for r in stages[5]], "doc_id long, token_ids array<int>"))
    assert {r.doc_id: r.text for r in back.collect()} == texts
    assert all(len(r["text"]) == r["n_chars"] for r in stages[4] if r["text"] is not None)
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in stages[5] if r["token_ids"] is not None)


def test_run_is_its_stages(spark, stages):
    digest = lambda rows: sorted((r["doc_id"], r["n_chars"], hashlib.sha256(repr(list(r["token_ids"])).encode()).hexdigest()) for r in rows)
    assert digest(r.asDict() for r in corpus_pipeline.run(spark, SF).collect()) == digest(stages[5])


ODD = [(1, None), (2, ""), (2, ""), (3, "short text"), (None, " ".join(f"w{i}" for i in range(60))), (4, " ".join(f"w{i}" for i in range(60))), (5, " ".join(f"v{i}" for i in range(60))), (5, " ".join(f"u{i}" for i in range(60))), (6, " ".join(f"t{i}" for i in range(30000))), (7, "z" * 40000 + " " + " ".join(f"s{i}" for i in range(40)))]


@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_rows_go_through_every_stage(spark, rows):
    """Nulls, empty and very long texts, ids that repeat, and columns with the names that the stages use themselves."""
    docs = spark.createDataFrame([(i, t, "en", None if i == 4 else "s", 1, 7, 7, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, host int, token_ids int")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.materialize(stage(spark, docs, SF))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        docs = after
    got = sorted((r.doc_id or -1) for r in docs.collect())
    assert got == ([4, 5, 5, 6, 7] if rows else [])

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from memgate.functions import fingerprint, text
from memgate.memory import SCHEMA, Memory, Principal
from memgate.operators import evaluation, gates, retrieve, usage, views
from memgate.plans import catalog, corpus
from memgate.sources import records as source
from memgate.streaming import ingest

SF = "/root/testdata/sf0.001"
def plain(row):
    return repr([round(v, 6) if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v for v in row])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "events", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(plain, df.select(cols).collect())) == sorted(map(plain, want))


@pytest.mark.parametrize("mode", retrieve.MODES)
def test_no_row_that_fails_a_gate_is_returned(spark, mode):
    r, p, e = catalog._printed(spark, SF)
    found = retrieve.retrieve(r, p, e, mode=mode).select("probe_id", "capsule_id")
    got = gates.violations(found, r, p).first()
    assert got.total == 0 < got.rows


def test_gates_hold_for_many_probes(spark, monkeypatch):
    """Where probes are not broadcast, the same pairs come out."""
    r, p, _ = catalog._printed(spark, SF)
    pairs = lambda: {(x.probe_id, x.capsule_id) for x in gates.admitted(r.select(*gates.GATED), p.select(*gates.ASKED)).select("probe_id", "capsule_id").collect()}
    want = pairs()
    monkeypatch.setattr(gates, "BROADCAST_PROBES", 3)
    assert pairs() == want


def test_unknown_mode_is_an_error(spark):
    with pytest.raises(ValueError):
        retrieve.retrieve(*catalog._printed(spark, SF), mode="other")


def test_index_path_finds_what_the_exact_path_finds(spark):
    rows = catalog.ann_recall(spark, SF).agg(F.sum("exact").alias("exact"), F.sum("found").alias("found")).first()
    assert rows.found >= 0.9 * rows.exact
    r, p, e = catalog._vectors(spark, SF)
    found = retrieve.retrieve(r, p, e, above=16)
    assert gates.violations(found, r, p).first().total == 0
    exact = {(x.probe_id, x.capsule_id): x.score for x in retrieve.retrieve(r, p, e).collect()}
    assert {(x.probe_id, x.capsule_id): x.score for x in retrieve.retrieve(r, p, e, above=10_000).collect()} == exact


def test_signature_bands_find_near_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 64))
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(100 + k, (v + 0.25 * rng.normal(size=64)).tolist()) for k, v in enumerate(base)] + [(200, None), (201, []), (202, [1.0] * 8)]
    v = spark.createDataFrame(rows, "capsule_id long, embedding array<double>").withColumn("tenant_id", F.lit(0))
    q = v.filter("capsule_id < 60").select("tenant_id", F.col("capsule_id").alias("probe_id"), F.col("embedding").alias("probe_embedding"))
    found = {(r.probe_id, r.capsule_id) for r in retrieve.dense_candidates(v, q, flips=2).collect()}
    assert sum((k, 100 + k) in found for k in range(60)) >= 54 and all((k, k) in found for k in range(60))
    assert not any(c >= 200 for _, c in found)


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    from memgate.operators import dense

    v = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("item"), "embedding")
    q = v.filter("item % 50 = 0").withColumnRenamed("item", "query_id")
    one = sorted(map(tuple, dense.nearest(v, q, 5).collect()))
    monkeypatch.setattr(dense, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, dense.nearest(v.repartition(3), q, 5).collect())) == one and len(one) == 50


def test_masks_of_128_bits(spark):
    rows = [("0x8000000000000000ffffffffffffffff",), ("12",), ("0x1",)]
    got = spark.createDataFrame(rows, "m string").select(source.parse_mask(F.col("m")).alias("m")).collect()
    assert [(r.m.hi, r.m.lo) for r in got] == [(-(1 << 63), -1), (0, 12), (0, 1)]


def test_masks_that_are_none(spark):
    top = str((1 << 128) - 1)
    got = spark.createDataFrame([(top,), (None,), (" 7 ",)], "m string").select(source.parse_mask(F.col("m")).alias("m")).collect()
    assert [(r.m.hi, r.m.lo) for r in got] == [(-1, -1), (None, None), (0, 7)]
    for bad in ("x", "-1", "0xg", str(1 << 128)):
        with pytest.raises(Exception, match="128 bits"):
            spark.createDataFrame([(bad,)], "m string").select(source.parse_mask(F.col("m")).alias("m")).collect()


def test_fingerprints_against_plain_hashes(spark):
    import hashlib

    words = ["alpha", "beta", "gamma", "delta"]
    df = corpus.fingerprinted(spark.createDataFrame([(" ".join(words),), ("",), (None,)], "t string"), "t").collect()
    terms = sorted(words)
    feats = terms + [" ".join(terms[k : k + n]) for n in (2, 3) for k in range(len(terms) - n + 1)]
    bits, residual = set(), [0] * 64
    for f in feats:
        h = hashlib.sha256(f.encode()).digest()
        bits |= {h[0], h[2], h[4], h[6]}
        residual[h[0] % 64] += (1 if h[1] % 2 == 0 else -1) * (1 + h[2] % 3)
    assert df[0].fp == [sum(1 << b % 16 for b in bits if b // 16 == k) for k in range(16)] and df[0].residual == residual
    assert df[1].fp == [0] * 16


def test_zero_scores_fill_the_list(spark):
    q = spark.createDataFrame([(1, ["aa"]), (2, ["zz"])], "query_id long, terms array<string>")
    d = spark.createDataFrame([(k, ["aa"] if k == 7 else ["bb"]) for k in range(9)], "doc_id long, terms array<string>")
    top = evaluation.ranked(evaluation.bm25_scores(q, d), 3)
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in evaluation.filled(top, q, d, 3).collect())
    assert got == [(1, 1, 7), (1, 2, 0), (1, 3, 1), (2, 1, 0), (2, 2, 1), (2, 3, 2)]


def test_containing_against_plain_search(spark):
    texts = ["the red fox jumps over the lazy dog", "xthe red fox jumps over the lazy dogx", "red fox\njumps over", "", None, "a b", "say a b c"]
    items = ["the red fox jumps over the lazy dog", "fox jumps over", "red fox\njumps", "a b", "b", "over the"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "query_id long, item string")
    want = {(q, k) for q, x in enumerate(items) for k, t in enumerate(texts) if t and x in t}
    assert {(r.query_id, r.doc_id) for r in evaluation.containing(d, i).collect()} == want


def test_remember_recall_forget(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    mine, other = Memory(spark, path, Principal(1, "write")), Memory(spark, path, Principal(2, "write"))
    ids = mine.remember([("backups are kept for thirty days", "policy page"), ("tea is served at four", "note")], now=100)
    assert mine.recall("how long are backups kept", as_of=200).first().capsule_id == ids[0]
    assert other.recall("backups kept", as_of=200).count() == 0
    other.forget(ids)
    assert mine.recall("backups kept", as_of=200).count() > 0
    mine.store.checkpoint()
    mine.forget(ids[:1])
    assert ids[0] not in [r.capsule_id for r in mine.recall("backups kept", as_of=200).collect()]
    with pytest.raises(PermissionError):
        Memory(spark, path, Principal(1)).forget(ids)


def test_streaming_upsert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = dict.fromkeys([c.split()[0] for c in SCHEMA.split(", ")]) | {"tenant_id": 1, "capsule_id": "a", "claim": "x"}
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(row | {"seq": k, "op": op}) for k, op in ((1, "insert"), (2, "delete"), (3, "insert"))))
    memory = Memory(spark, f"file://{tmp_path}/store", Principal(1, "write"))
    ingest.upsert(ingest.ops_stream(spark, f"{tmp_path}/in", SCHEMA), memory.store, f"{tmp_path}/check").awaitTermination()
    assert [(r.capsule_id, r.seq) for r in memory.store.rows().collect()] == [("a", 3)]


def memory_rows(spark, store, ops):
    for seq, op, key, claim in ops:
        row = spark.createDataFrame([(1, key, claim)], "tenant_id long, capsule_id string, claim string")
        if op == "insert":
            store.insert(row, seq)
        else:
            store.delete(1, row.select("capsule_id"), seq)


def test_store_seals_merges_and_truncates(spark, tmp_path):
    from memgate.operators.store import MemoryStore

    s = MemoryStore(spark, f"file://{tmp_path}/s", "tenant_id bigint, capsule_id string, claim string", seal_at=2, merge_at=2)
    view = lambda: sorted((r.capsule_id, r.claim) for r in s.rows().collect())
    memory_rows(spark, s, [(1, "insert", "a", "one"), (2, "insert", "b", "two")])
    assert len(s.current()["runs"]) == 1 and s._names("log") == [] and view() == [("a", "one"), ("b", "two")]
    s.checkpoint()
    assert s.current()["base"] and s.current()["runs"] == [] and view() == [("a", "one"), ("b", "two")]
    memory_rows(spark, s, [(3, "delete", "a", None), (4, "insert", "c", "three"), (5, "insert", "b", "again"), (6, "insert", "d", "four")])
    assert len(s.current()["runs"]) == 1  # merged; the tombstone of a still hides the base's row
    assert view() == [("b", "again"), ("c", "three"), ("d", "four")]
    memory_rows(spark, s, [(7, "insert", "a", "back")])
    again = MemoryStore(spark, s.path, "tenant_id bigint, capsule_id string, claim string")
    assert ("a", "back") in [(r.capsule_id, r.claim) for r in again.rows().collect()]
    s.checkpoint()
    s.checkpoint()
    assert view() == [("a", "back"), ("b", "again"), ("c", "three"), ("d", "four")] and {r.tier for r in s.stats().collect()} == {"base"}


def test_store_survives_a_crash_between_steps(spark, tmp_path, monkeypatch):
    from memgate.operators.store import MemoryStore

    s = MemoryStore(spark, f"file://{tmp_path}/s", "tenant_id bigint, capsule_id string, claim string")
    memory_rows(spark, s, [(1, "insert", "a", "one"), (2, "insert", "b", "two"), (3, "delete", "b", None)])
    for step in ("_advance", "truncate"):
        with monkeypatch.context() as m:
            m.setattr(MemoryStore, step, lambda *a, **k: (_ for _ in ()).throw(OSError("crash")))
            with pytest.raises(OSError):
                s.checkpoint()
        assert [r.capsule_id for r in s.rows().collect()] == ["a"]
    s.checkpoint()
    s.truncate()
    assert [r.capsule_id for r in s.rows().collect()] == ["a"] and s._names("log") == []


def test_two_writers_of_a_version(spark, tmp_path):
    from memgate.operators.store import MemoryStore

    s = MemoryStore(spark, f"file://{tmp_path}/s", "tenant_id bigint, capsule_id string, claim string")
    state = s.current()
    s._advance(state)
    with pytest.raises(RuntimeError):
        s._advance(state)


def test_rate_limit(spark):
    rows = [(1, 1, 0.0), (1, 2, 0.0), (1, 3, 0.0), (1, 4, 10.0), (2, 5, 0.0)]
    got = usage.rate_limit(spark.createDataFrame(rows, "tenant_id long, seq long, at double"), 0.1, 2.0)
    assert {r.seq: r.allowed for r in got.collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_a_changed_audit_record_is_found(spark):
    log = spark.createDataFrame([(k, 1, "query") for k in range(5)], "seq long, tenant_id long, op string")
    chain = usage.audit_chain(log)
    assert usage.audit_verify(chain, log).first().valid
    assert not usage.audit_verify(chain, log.withColumn("op", F.when(F.col("seq") == 2, "delete").otherwise(F.col("op")))).first().valid


def test_extraction(spark):
    said = ["Ann: Well, we decided to ship on Friday.", "Bob: hello", "Ann: I prefer green tea.", "Cy: we agreed to ship on friday", "Cy: Please remember that the door code is 12345!", "Ann: remember I prefer green tea", "Di: our team budget is 40 euros;"]
    lines = spark.createDataFrame(list(enumerate(said, 1)), "line int, value string")
    got = {(r.line, r.kind, r.trust, r.claim) for r in views.extract(views.parse_transcript(lines)).collect()}
    assert got == {(1, "decision", 7, "ship on Friday"), (3, "preference", 6, "Ann (i) prefer green tea"), (5, "explicit", 8, "the door code is 12345"), (7, "attribute", 7, "Di (our) team budget is 40 euros")}
    rows = views.extracted_records(views.extract(views.parse_transcript(lines)), 3, "talk", 1000).collect()
    assert len({r.capsule_id for r in rows}) == 4 and {r.source_uri for r in rows} == {"talk#L1", "talk#L3", "talk#L5", "talk#L7"}


def test_extraction_by_a_model(spark):
    lines = spark.createDataFrame([(1, "Ann", "x"), (2, "Ann", "bad")], "line int, speaker string, utterance string")
    ask = lambda t: "no json" if "bad" in t else json.dumps({"memories": [{"claim": "c", "evidence": "e", "line": 1, "trust": 99}]})
    assert [(r.claim, r.trust) for r in views.extract_with(lines, ask).collect()] == [("c", 10)]


def test_seal_and_integrity(spark, tmp_path):
    key = F.lit("0123456789abcdef").cast("binary")
    df = spark.createDataFrame([("a", 1, "c", "secret"), ("a", 1, "c", "secret")], "capsule_id string, tenant_id long, claim string, evidence string")
    assert source.unseal(source.seal(df, key), key).first().evidence == "secret"
    fixed = source.StaticKey(b"0123456789abcdef")
    assert source.unseal(source.seal(df, fixed, "claim", "evidence"), fixed, "claim", "evidence").first().claim == "c"
    assert source.write_segment(df, f"{tmp_path}/seg", 3).first().capsule_count == 2
    with pytest.raises(ValueError, match="repeated id"):
        source.open_segment(spark, f"{tmp_path}/seg")
    good = df.limit(1)
    source.write_segment(good, f"{tmp_path}/two", 4)
    assert source.open_segments(spark, [f"{tmp_path}/two"]).first().tier == 0
    assert [p.rsplit("/", 1)[1] for p in source.segment_paths(spark, f"file://{tmp_path}")] == ["seg", "two"]
    spark.read.parquet(f"{tmp_path}/two").withColumn("evidence", F.lit("other")).write.mode("append").partitionBy("tenant_id").parquet(f"{tmp_path}/two")
    with pytest.raises(ValueError, match="manifest"):
        source.open_segment(spark, f"{tmp_path}/two")
    assert [r.problem for r in source.integrity(df.withColumn("content_hash", F.lit("x"))).collect()].count("content hash") == 2


def test_normalisation(spark):
    r = spark.range(1).select(text.normalize_category(F.lit(" Multi_Session x ")).alias("c"), text.token_estimate(F.lit("")).alias("t")).first()
    assert (r.c, r.t) == ("multi-session-x", 1)

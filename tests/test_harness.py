"""Adapters, harness predicates, runs and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from memgate import cli
from memgate.memory import principal_of
from memgate.operators import harness, usage
from memgate.sources import adapters
from memgate.sources import records as source


def items(spark, tmp_path, benchmark, value, name="x.json", **options):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value))
    return adapters.read_benchmark(spark, str(path), benchmark, **options).collect()


def test_long_mem_eval(spark, tmp_path):
    value = {"data": [{"question_id": "q1", "question": "who?", "type": "Multi Session", "haystack_session_ids": ["a"], "sessions": [[{"role": "user", "content": "hi"}, {"content": "yo"}], {"id": 7, "turns": [{"speaker": "B", "text": "x"}]}], "answer_session_ids": ["a"], "evidence": [{"sessionId": "z"}]}, {"input": "only"}]}
    one, two = items(spark, tmp_path, "longmemeval", value)
    assert (one.query_id, one.category, one.truth) == ("q1", "multi-session", ["a", "z"])
    assert [(d.capsule_id, d.text, d.session_id) for d in one.documents] == [(1000001, "user: hi\nyo", "a"), (1000002, "B: x", "7")]
    assert (two.query_id, two.question, two.documents, two.category) == ("lme-q-1", "only", [], "unknown")


@pytest.mark.parametrize("dialogs", [False, True])
def test_locomo(spark, tmp_path, dialogs):
    talk = {"conversation_id": "c", "conversation": {"session_2": {"dialogs": [{"id": "D2:1", "speaker": "A", "text": "later"}]}, "session_1": {"dialogs": [{"id": "D1:1", "text": "first"}, {"text": "second"}]}, "session_1_date": "x"}, "qa": [{"question": "?", "category": 2, "evidence": ["D2:1", "D9:4", "plain"]}, {"id": "mine", "category": "5"}]}
    one, two = items(spark, tmp_path, "locomo", [talk], dialogs=dialogs)
    assert (one.query_id, one.category, two.query_id, two.category) == ("c-q-0", "temporal", "mine", "adversarial")
    if dialogs:
        assert one.truth == ["D2:1", "D9:4", "plain"] and [d.capsule_id for d in one.documents] == [1010001, 1010002, 1020001]
    else:
        assert one.truth == ["plain", "session_2", "session_9"] and [d.session_id for d in one.documents] == ["session_1", "session_2"]


def test_convo_mem(spark, tmp_path):
    talk = {"evidence_items": [{"id": "q", "question": "what is it", "conversations": [{"id": "s", "messages": [{"speaker": "User", "text": "My cat is Tom"}, {"speaker": "Bot", "text": "ok"}]}], "message_evidences": [{"speaker": "user ", "text": " my cat is tom"}]}]}
    (one,) = items(spark, tmp_path, "convomem", talk, "user_evidence/1.json")
    assert (one.category, one.truth, one.abstention) == ("user-evidence", ["q-e-0"], False)
    assert one.documents[0].text == "User: My cat is Tom" and one.documents[1].dialog_id == "s:1"
    (two,) = items(spark, tmp_path, "convomem", talk, "abstention_evidence/1.json")
    assert two.abstention and two.truth == []
    every = adapters.read_benchmark(spark, str(tmp_path), "convomem")
    assert every.count() == 2 and harness.of_categories(every, ["user_evidence"]).count() == 1 and harness.of_categories(every, ["all"], 1).count() == 1
    assert {r.parent for r in adapters.item_docs(every.filter("not abstention")).collect()} == {"q-e-0", "s"}


def test_rankings_presets_and_limits(spark):
    docs = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, doc_id string")
    lists = spark.createDataFrame([(0, "q", ["b"]), (3, "q", ["x", "b", "a"])], "line int, query_id string, ranked array<string>")
    held = harness.with_rankings(docs.select("query_id").distinct().union(spark.createDataFrame([("r",)], "query_id string")), lists)
    assert {r.query_id: r.ranked for r in held.collect()} == {"q": ["x", "b", "a"], "r": []}
    got = [(r.doc_id, r["rank"]) for r in harness.returned_docs(held, docs, 1).collect()]
    assert got == [("b", 1)]
    assert harness.clamped_k(10, 4) == 4
    with pytest.raises(ValueError):
        harness.clamped_k(10, 4, strict=True)
    runs = spark.createDataFrame([("LoCoMo", 10, False, True, "user-evidence"), ("LoCoMo", 5, False, True, "user-evidence")], "benchmark string, top_k int, retrieves_all boolean, raw boolean, category string")
    assert harness.preset_problems(runs, "LoCoMo", ["user-evidence"]) == ["top-k"]


def test_needles_and_answers(spark):
    rows = spark.createDataFrame([(1, [1, 2], False, 9), (3, [2, 3], False, 11), (4, [4], True, 10)], "target long, returned array<long>, embargoed boolean, candidates int")
    r = harness.needles(rows).first()
    assert (r.recall_1, r.recall_returned, r.embargoed, r.disclosed, r.avg_candidates) == (0.5, 1.0, 1, 1, 10.0)
    runs = spark.createDataFrame([(k, k % 2 == 0, k) for k in range(4)], "query_id long, correct boolean, context_tokens int")
    gold = spark.createDataFrame([(k, "t") for k in range(4)], "query_id long, question_type string")
    assert tuple(harness.qa_accuracy(runs, gold).first()) == ("t", 4, 0.5, 2)


def test_audit_records_and_hashes(spark):
    probes = spark.createDataFrame([(1, 2, 255, 1, 4, 100, "who")], "probe_id long, tenant_id long, probe_context long, probe_policy long, trust_floor int, as_of long, probe_text string")
    frame = spark.createDataFrame([(1, 2, 8, "h", 5), (1, 1, 9, "g", 6)], "probe_id long, rank int, capsule_id long, source_hash string, trust_level int")
    r = usage.audit_of_queries(frame, probes, 7).first()
    assert (r.context_mask, r.policy_mask, r.returned_count, [x.capsule_id for x in r.returned]) == ("0xff", "0x1", 2, ["9", "8"])
    assert len(usage.request_hash(probes).first().request_hash) == 64
    import hashlib
    want = int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "little", signed=True)
    assert spark.range(1).select(source.stable_hash64(F.lit("abc")).alias("h")).first().h == want
    fold = spark.createDataFrame([("0x5",), ("0x10000000000000003",)], "m string").select(source.source_fold(source.halves(F.col("m"))).alias("s")).collect()
    assert [x.s for x in fold] == [5, 2]


def test_principals():
    p = principal_of("abc:read:3, def:admin", "def")
    assert (p.tenant_id, p.scope) == (0, "admin") and principal_of("abc:read:3", "abc").tenant_id == 3
    with pytest.raises(PermissionError):
        principal_of("abc:read", "x")
    with pytest.raises(PermissionError):
        principal_of("abc:read", "abc").need("write")


def test_command_line(spark, tmp_path, capsys):
    raw = [{"capsule_id": str(k), "tenant_id": 1, "claim": f"backups are kept for {k} days", "evidence": "policy page", "source_id": 1, "valid_from": 0, "observed_at": 0, "last_verified_at": 0, "context_mask": "0xffff", "policy_mask": "65535", "trust_level": 5, "classification": 0, "poison_risk": 0, "relation_edges": []} for k in (1, 2)]
    (tmp_path / "in.json").write_text(json.dumps(raw))
    (tmp_path / "ask.json").write_text(json.dumps({"probe_id": 1, "tenant_id": 1, "query": "how long are backups kept"}))
    seg = f"file://{tmp_path}/seg"
    cli.main(["compile", str(tmp_path / "in.json"), seg], spark)
    cli.main(["validate", seg], spark)
    cli.main(["inspect", seg], spark)
    cli.main(["query", str(tmp_path / "ask.json"), seg, "--k", "1"], spark)
    out = capsys.readouterr().out.splitlines()
    assert json.loads(out[0])[0]["capsule_count"] == 2 and out[1] == "ok" and json.loads(out[2])["count"] == 2 and json.loads(out[3])["rank"] == 1
    (tmp_path / "b.json").write_text(json.dumps([{"question_id": "q", "question": "red fox", "sessions": [{"id": "s1", "turns": [{"text": "a red fox"}]}, {"id": "s2", "turns": [{"text": "blue"}]}], "answer_session_ids": ["s1"]}]))
    cli.main(["eval", "longmemeval", str(tmp_path / "b.json")], spark)
    assert "1.0000" in capsys.readouterr().out


def test_json_round_trip_and_products(spark, tmp_path):
    raw = spark.createDataFrame([("7", 1, "c", "e", [("7", "8", "Supports", 1)])], "capsule_id string, tenant_id long, claim string, evidence string, relation_edges array<struct<from: string, to: string, kind: string, weight: int>>")
    back = source.record_from_json(source.record_to_json(raw)).first()
    assert (back.capsule_id, back.claim, back.relation_edges[0].to) == ("7", "c", "8")
    (tmp_path / "p.jsonl").write_text('{"memory_id": "m", "tenant_id": 1}\n\nnot json\n')
    got = sorted((r.line, r.memory_id, r._corrupt) for r in source.read_products(spark, f"file://{tmp_path}/p.jsonl").collect())
    assert got == [(1, "m", None), (3, None, "not json")]
    assert source.synthetic(spark, 260).filter("embargoed").count() == 20


def test_runs_on_the_command_line(spark, tmp_path, capsys):
    row = {"benchmark": "b", "mode": "m", "category": "c", "recall_1": 1.0, "recall_5": 1.0, "recall_10": 1.0, "build_ns": 5, "violations": 0, "config_hash": "x", "dataset_hash": "y", "split_hash": "z", "truth": ["a"]}
    for name, ns in (("fast", 10), ("slow", 20)):
        (tmp_path / name).write_text("\n".join(json.dumps(row | {"query_id": f"q{k}", "returned": ["a", "b"] if k else ["b"], "retrieval_ns": ns}) for k in range(3)))
    fast, slow = str(tmp_path / "fast"), str(tmp_path / "slow")
    ask = lambda *argv: (cli.main([*argv], spark), capsys.readouterr().out)[1]
    assert "| c | 3 | 1.0000" in ask("compare", fast)
    proof = json.loads(ask("prove", fast, slow))
    assert (proof["accuracy_parity"], proof["latency_lead"], proof["safety"], proof["same_identity"], proof["speedup_p50"]) == ("PASS", "PASS", "PASS", "PASS", round(25 / 15, 6))
    assert json.loads(ask("prove", slow, fast))["latency_lead"] == "FAIL"
    out = ask("diagnose", fast).splitlines()
    assert json.loads(out[0]) == {"queries": 3, "with misses": 1} and json.loads(out[1]) == {"missed": ["a"], "query_id": "q0"}
    assert json.loads(ask("safety", fast)) == {"violations": 0}
    fused = [json.loads(x) for x in ask("fuse", fast, slow).splitlines()]
    assert [(r["query_id"], r["item"]) for r in fused] == [("q0", "b"), ("q1", "a"), ("q1", "b"), ("q2", "a"), ("q2", "b")] and fused[0]["rrf"] == round(2 / 61, 9)
    ask("split", str(tmp_path / "split"), fast, "--dev", "2")
    got = source.read_split(spark, str(tmp_path / "split"))
    assert sorted(r["count"] for r in got.groupBy("split").count().collect()) == [1, 2] and harness.of_split(source.read_run(spark, fast), got, "dev").count() == 2


def test_service_routes(spark, tmp_path):
    from memgate.service import Service, principal_of_token, signed

    s = Service(spark, f"file://{tmp_path}/svc", "w1:write:1,r2:read:2,a1:admin:1", b"key")
    assert s.handle("GET", "/healthz") == (200, {"status": "ok"})
    status, made = s.handle("POST", "/v1/memories", {"memories": [{"claim": "backups are kept thirty days"}]}, "w1")
    assert status == 201
    ask = {"query": "how long are backups kept"}
    assert [c["capsule_id"] for c in s.handle("POST", "/v1/query", ask, signed({"tenant": 1}, b"key"))[1]["capsules"]] == made["ids"]
    assert s.handle("POST", "/v1/query", ask, "r2")[1]["capsules"] == []
    assert s.handle("POST", "/v1/memories", {"memories": []}, "r2")[0] == 403 == s.handle("GET", "/v1/usage", None, "w1")[0] == s.handle("GET", "/v1/usage", None, "none")[0]
    assert s.handle("POST", "/v1/query", {}, "r2")[0] == 400 and s.handle("GET", "/v1/nothing", None, "a1")[0] == 404
    assert s.handle("GET", "/v1/usage", None, "a1")[1] == [{"tenant": "1", "queries": 1, "returned": 1, "inserts": 1, "deletes": 0}]
    assert s.handle("GET", "/v1/audit/verify", None, "a1") == (200, {"valid": True})
    assert 'operations_total{op="query"} 2' in s.handle("GET", "/metrics", None, "a1")[1]
    assert s.handle("DELETE", f"/v1/memories/{made['ids'][0]}", None, "w1")[0] == 204
    assert s.handle("POST", "/v1/admin/compact", None, "a1")[0] == 200 and s.handle("POST", "/v1/query", ask, "w1")[1]["capsules"] == []
    for bad in (signed({"tenant": 1}, b"other"), signed({"tenant": 1, "exp": 5}, b"key"), "a.b.c"):
        with pytest.raises(PermissionError):
            principal_of_token(bad, b"key", now=10)


def test_products_indexes_and_embeddings(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps({"memory_id": "m", "tenant_id": 1, "turns": [{"turn_id": 1, "role": "user", "text": "hello there"}, {"turn_id": 2, "role": "assistant", "text": "yes"}]}))
    made = source.compile_products(source.read_products(spark, f"file://{tmp_path}/p.jsonl"), f"file://{tmp_path}/out", 1, 100)
    assert {r["view"]: r.capsule_count for r in made.collect()} == {"session": 1, "user-turn": 1, "assistant-turn": 1, "turn": 2, "native-capsule": 2}
    assert {r.claim for r in source.open_segment(spark, f"file://{tmp_path}/out/turn").collect()} == {"hello there", "yes"}
    r = spark.createDataFrame([(1, 5, ["aa", "bb"], ["bb", "cc"])], "tenant_id long, capsule_id long, anchors array<string>, entities array<string>")
    source.write_indexes(r, f"file://{tmp_path}/seg")
    assert sorted(x.term for x in spark.read.parquet(f"{tmp_path}/seg.terms").collect()) == ["aa", "bb", "cc"]
    got = source.embed(spark.createDataFrame([("ab",), (None,)], "text string"), lambda texts: [[len(t), 1] for t in texts]).collect()
    assert [x.embedding for x in got] == [[2.0, 1.0], [0.0, 1.0]]
    assert source.seeded_words(3, 5) == source.seeded_words(3, 5) and source.frozen_problems({"a": 1}, {"a": 1, "b": 2}) == ["b"]

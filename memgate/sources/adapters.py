"""Benchmark files to items: LongMemEval, LoCoMo and ConvoMem. Their JSON has no fixed schema, so each file is walked as it is,
by the task that reads it; items leave as rows of one schema."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memgate.operators.harness import CATEGORIES

DOCUMENT = "struct<capsule_id: long, text: string, session_id: string, dialog_id: string, evidence_id: string>"
ITEM = f"file string, place int, benchmark string, query_id string, question string, category string, documents array<{DOCUMENT}>, truth array<string>, abstention boolean"
ROOTS = ("data", "examples", "questions", "conversations", "items")
TEXT, SPEAKER, TURNS = ("text", "content", "transcript", "message"), ("speaker", "role"), ("turns", "dialogs", "messages")
#: LoCoMo's numbered categories.
LOCOMO = {"1": "single-hop", "2": "temporal", "3": "temporal-inference", "4": "open-domain", "5": "adversarial"}


def pick(x, *names):
    """The value of the first of these keys that x has."""
    if isinstance(x, dict):
        for n in names:
            if n in x:
                return x[n]
    return None


def as_text(x) -> str | None:
    if isinstance(x, str):
        return x
    return None if isinstance(x, bool) or not isinstance(x, (int, float)) else json.dumps(x)


def field(x, *names) -> str | None:
    return as_text(pick(x, *names))


def rows(x, *names) -> list:
    got = pick(x, *names) if names else x
    return got if isinstance(got, list) else []


def strings(x) -> list[str]:
    if isinstance(x, dict):
        return [s for v in x.values() for s in strings(v)]
    if isinstance(x, list):
        return [t for v in x if (t := as_text(v)) is not None]
    return [x] if isinstance(x, str) else []


def all_strings(x, *names) -> list[str]:
    return [s for n in names if isinstance(x, dict) and n in x for s in strings(x[n])]


def roots(value) -> list:
    if isinstance(value, list):
        return value
    return next((value[n] for n in ROOTS if isinstance(pick(value, n), list)), [value])


def spoken(x, names=TEXT) -> str:
    said, who = field(x, *names) or "", field(x, *SPEAKER) or ""
    return f"{who}: {said}" if who else said


def flat_text(x) -> str:
    """The text of a session, a turn, or a list of them."""
    if isinstance(x, list):
        return "\n".join(t for t in map(flat_text, x) if t)
    if field(x, *TEXT) is not None:
        return spoken(x)
    turns = pick(x, *TURNS)
    if isinstance(turns, list):
        return "\n".join(spoken(t, ("text", "content", "message")) for t in turns)
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def category_name(x: str) -> str:
    return x.strip().lower().replace("_", "-").replace(" ", "-")


def capsule(item: int, *places: int) -> int:
    """A number for a document by its place: items are a million apart, sessions of dialogs ten thousand."""
    return (item + 1) * 1_000_000 + (places[0] + 1 if len(places) == 1 else (places[0] + 1) * 10_000 + places[1] + 1)


def long_mem_eval(value, path: str):
    for k, item in enumerate(roots(value)):
        query = field(item, "question_id", "query_id", "qid", "id", "questionId") or f"lme-q-{k}"
        names = all_strings(item, "haystack_session_ids", "session_ids")
        docs = []
        for n, session in enumerate(rows(item, "haystack_sessions", "sessions", "memory")):
            own = field(session, "session_id", "sessionId", "id") or (names[n] if n < len(names) else f"session-{n}")
            docs.append((capsule(k, n), flat_text(session), own, None, None))
        truth = set(all_strings(item, "ground_truth_ids", "gold_session_ids", "evidence_session_ids", "answer_session_ids", "target_session_ids", "session_ids"))
        truth |= {i for e in rows(item, "evidence", "evidences") if (i := field(e, "session_id", "sessionId", "parent_session_id")) is not None}
        asked = field(item, "question", "query", "input")
        kind = field(item, "category", "type", "question_type")
        yield k, "LongMemEval", query, json.dumps(item) if asked is None else asked, "unknown" if kind is None else category_name(kind), docs, sorted(truth), False


def locomo_sessions(talk) -> list[tuple[str, object]]:
    listed = pick(talk, "sessions", "chunks")
    if isinstance(listed, list):
        return [(f"session_{n + 1}", s) for n, s in enumerate(listed)]
    own = pick(talk, "conversation")
    named = [(int(m[1]), key) for key in own if (m := re.fullmatch(r"session_([0-9]+)", key))] if isinstance(own, dict) else []
    return [(key, own[key]) for _, key in sorted(named)]


def locomo(value, path: str, dialogs: bool = False):
    place = 0
    for k, talk in enumerate(roots(value)):
        name = field(talk, "conversation_id", "conversationId", "id") or f"conversation-{k}"
        docs, session_of = [], {}
        for n, (default, session) in enumerate(locomo_sessions(talk)):
            own = field(session, "session_id", "sessionId", "id") or default
            turns = session if isinstance(session, list) else rows(session, "dialogs", "turns", "messages")
            if not dialogs:
                docs.append((capsule(k, n), flat_text(session), own, None, None))
            for m, turn in enumerate(turns):
                key = field(turn, "dialog_id", "dialogId", "id", "dia_id") or f"{own}-d-{m}"
                session_of[key] = own
                if dialogs:
                    docs.append((capsule(k, n, m), flat_text(turn), own, key, key))
        for n, qa in enumerate(rows(talk, "qa", "qa_pairs", "questions")):
            truth = set()
            for i in all_strings(qa, "evidence_ids", "evidence", "evidence_dialog_ids", "dialog_evidence_ids", "evidence_session_ids", "session_evidence_ids"):
                head, colon, _ = i.partition(":")
                numbered = re.fullmatch(r"D([0-9]*)", head)
                truth.add(i if dialogs else session_of.get(i) or (f"session_{numbered[1]}" if numbered else head) if colon or i in session_of else i)
            kind = field(qa, "category", "type")
            category = "unknown" if kind is None else LOCOMO.get(kind.strip()) or category_name(kind)
            yield place, "LoCoMo", field(qa, "question_id", "query_id", "qid", "id") or f"{name}-q-{n}", field(qa, "question", "query") or "", category, docs, sorted(truth), False
            place += 1


def message_key(speaker: str, said: str) -> tuple[str, str]:
    return speaker.strip().lower(), said.strip().lower()


def convo_mem(value, path: str):
    inferred = next((c for part in path.split("/") if (c := category_name(part)) in CATEGORIES), None)
    for k, item in enumerate(value["evidence_items"] if isinstance(pick(value, "evidence_items"), list) else roots(value)):
        kind = field(item, "evidence_type", "question_type", "category", "type")
        category = inferred or ("unknown" if kind is None else category_name(kind))
        asked = field(item, "question", "query")
        query = field(item, "question_id", "query_id", "id") or f"convomem-{k}-{hashlib.sha256((json.dumps(item) if asked is None else asked).encode()).hexdigest()[:12]}"
        raw = [(field(d, "evidence_id", "id"), field(d, *SPEAKER) or "", flat_text(d), field(d, "session_id", "conversation_id"), field(d, "dialog_id", "turn_id")) for d in rows(item, "evidence", "documents", "memories")]
        if not raw:
            for n, talk in enumerate(rows(item, "conversations")):
                session = field(talk, "session_id", "conversation_id", "id") or f"conversation-{n}"
                raw += [(None, field(m, *SPEAKER) or "", field(m, "text", "content", "message") or "", session, f"{session}:{i}") for i, m in enumerate(rows(talk, "messages", "turns"))]
        docs, known = [], {}
        for n, (evidence, who, said, session, dialog) in enumerate(raw):
            evidence = evidence or f"{query}-e-{n}"
            known[message_key(who, said)] = evidence
            docs.append((capsule(k, n), f"{who}: {said}" if who else said, session, dialog, evidence))
        abstains = category == "abstention-evidence"
        truth = set() if abstains else set(all_strings(item, "ground_truth_ids", "evidence_ids", "answer_evidence_ids"))
        for e in [] if abstains else rows(item, "message_evidences"):
            key = message_key(field(e, *SPEAKER) or "", field(e, "text", "content", "message") or "")
            truth |= {known[key]} if key in known else set()
        yield k, "ConvoMem", query, asked or "", category, docs, sorted(truth), abstains


PARSERS = {"longmemeval": long_mem_eval, "locomo": locomo, "convomem": convo_mem}


def read_benchmark(spark: SparkSession, path: str, benchmark: str, **options) -> DataFrame:
    """The items of a file, or of all .json files below a folder. LoCoMo takes `dialogs` (documents are dialogs, not sessions). A file that is no JSON is an error."""
    parse = PARSERS[benchmark]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path", F.col("content").cast("string").alias("value"))
    names = [c.split()[0] for c in ITEM.split(", ") if c.split()[0] in ("file", "place", "benchmark", "query_id", "question", "category", "documents", "truth", "abstention")]

    def run(frames):
        for pdf in frames:
            for file, value in zip(pdf["path"], pdf["value"]):
                out = [(file, *item) for item in parse(json.loads(value), file, **options)]
                docs = ("capsule_id", "text", "session_id", "dialog_id", "evidence_id")
                frame = pd.DataFrame(out, columns=list(dict.fromkeys(names)))
                frame["documents"] = [[dict(zip(docs, d)) for d in own] for own in frame["documents"]]
                yield frame

    return files.mapInPandas(run, ITEM)


def item_docs(items: DataFrame) -> DataFrame:
    """One row for each document of an item, with the id that counts for its truth."""
    from memgate.operators.harness import parent_id

    d = items.select("query_id", "truth", F.explode("documents").alias("d")).select("query_id", "truth", "d.*")
    return d.withColumn("parent", parent_id(F.col("truth"), F.col("evidence_id"), F.col("dialog_id"), F.col("session_id"), F.col("capsule_id")))

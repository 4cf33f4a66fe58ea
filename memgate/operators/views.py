"""Conversation views and rule-based extraction of memories."""

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memgate.functions import text
from memgate.operators.folds import in_order

#: Extraction rules in order of priority, (kind, trust, pattern whose first group is the claim).
RULES = (
    ("explicit", 8, r"\b(?:please )?remember (?:that )?(.{8,200})"),
    ("decision", 7, r"\bwe (?:decided|agreed) (?:that |to )?(.{8,200})"),
    ("attribute", 7, r"\b((?:my|our) (?:\w+ ){0,2}(?:name|email|phone|address|birthday|anniversary|manager|team|company|timezone|budget|goal|policy) (?:is|are) .{2,120})"),
    ("preference", 6, r"\b(i (?:prefer|always|never|usually|like to|hate|love) .{4,150})"),
    ("dated", 6, r"\b(the (?:deadline|launch|meeting|renewal|review|migration|audit) (?:is|was|will be) .{2,120})"),
)


def turns(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def five_views(conversations: DataFrame) -> DataFrame:
    """session, user-turn, assistant-turn, turn and native-capsule rows: view, conv_id, turn (null for sessions), text, capsule_id."""
    t = turns(conversations)
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    session = t.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text")).select(F.lit("session").alias("view"), "conv_id", F.lit(None).cast("long").alias("turn"), "text")
    per = t.select(F.explode(F.filter(F.array(F.lit("turn"), F.lit("native-capsule"), F.when(F.col("role") == "user", "user-turn"), F.when(F.col("role") == "assistant", "assistant-turn")), lambda v: v.isNotNull())).alias("view"), "conv_id", "turn", "text")
    both = session.unionByName(per)
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), F.lit("-")), "view")
    return both.withColumn("capsule_id", F.substring(F.sha2(name, 256), 1, 32))


def view_records(views_: DataFrame, tenant: Column, at: Column) -> DataFrame:
    """Records of views: the claim is the first non-blank line, the evidence the view's address, the source its conversation."""
    uri = F.concat_ws("/", F.lit("memory:/"), F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), F.lit("-")), "view")
    claim = F.coalesce(text.first_line(F.col("text")), F.lit(""))
    return views_.select("capsule_id", tenant.alias("tenant_id"), claim.alias("claim"), uri.alias("evidence"), uri.alias("source_uri"), F.xxhash64("conv_id").alias("source_id"), at.alias("valid_from"), at.alias("observed_at"), at.alias("last_verified_at"))


def parse_transcript(lines: DataFrame) -> DataFrame:
    """(line, value) rows of 'Speaker: text' to speaker and utterance."""
    return lines.select("line", F.trim(F.regexp_extract("value", r"^\s*([^:]{1,40}):\s*(.+)$", 1)).alias("speaker"), F.trim(F.regexp_extract("value", r"^\s*([^:]{1,40}):\s*(.+)$", 2)).alias("utterance")).filter("utterance <> ''")


#: Rules see the blanks, letters and word ends of SQL's regular expressions: those of ASCII, but for two folded letters.
BLANKS = " \t\r\f\n"
SPACES = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
FIRST_PERSON = re.compile(r"(i|my|our|we)\b", re.I | re.A)


def compiled(pattern: str) -> re.Pattern:
    """A rule's pattern, with `s` and `k` also as U+017F and U+212A. Patterns hold these letters only outside of sets and escapes."""
    return re.compile(pattern.translate({ord("s"): "[s\u017f]", ord("k"): "[k\u212a]"}), re.I | re.A)


def fold(claim: str) -> str:
    """Letter by letter in lower case, as SQL folds."""
    return "".join(c.lower()[0] for c in claim)


def standalone(fragment: str, speaker: str) -> str:
    """A claim that stands alone: trimmed, blanks squeezed, and a first person at its start replaced by the speaker."""
    claim = re.sub(f"[{BLANKS}]+", " ", fragment.strip(BLANKS).rstrip(".!,;")).strip(SPACES)
    first = FIRST_PERSON.match(claim)
    return f"{speaker} ({first[1].lower()}){claim[first.end():]}" if first else claim


def extract(utterances: DataFrame, by: str | None = None, again: bool = True) -> DataFrame:
    """(line, speaker, utterance) to memories. The first rule of an utterance that gives a claim not seen before wins, so lines
    are read in order: within each transcript, which `by` names; without it all lines are one transcript. Without `again` only
    the first rule that fits counts, and an utterance whose claim was seen gives nothing."""
    patterns = [(k, t, compiled(p)) for k, t, p in RULES]
    key = by or "transcript"
    names = [key, "line", "speaker", "kind", "trust", "claim", "evidence"]

    def read(batches):
        transcript, seen = (), set()
        for b in batches:
            out = []
            for own, line, speaker, said in zip(*(b.column(c).to_pylist() for c in (key, "line", "speaker", "utterance"))):
                if own != transcript:
                    transcript, seen = own, set()
                for kind, trust, pattern in patterns:
                    if (m := pattern.search(said)) is None:
                        continue
                    claim = standalone(m[1], speaker)
                    if (folded := fold(claim)) not in seen:
                        seen.add(folded)
                        out.append((own, line, speaker, kind, trust, claim, said))
                        break
                    if not again:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [()] * len(names), types)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
    rows = (utterances if by else utterances.withColumn(key, F.lit(0).cast("long"))).select(F.col(key).cast("long").alias(key), F.col("line").cast("long").alias("line"), "speaker", "utterance")
    # only lines that some rule fits reach Python: the same patterns without word ends, as Java sees these otherwise
    some = rows.filter(F.col("utterance").rlike("(?iud)" + "|".join(f"(?:{p})" for _, _, p in RULES).replace(r"\b", "")))
    out = in_order(some, [key], F.asc_nulls_last("line"), F.asc_nulls_last("speaker")).mapInArrow(read, f"{key} long, line long, speaker string, kind string, trust int, claim string, evidence string")
    return out if by else out.drop(key)


def extracted_records(memories: DataFrame, tenant: int, source: str, now: int, hint: str | None = None) -> DataFrame:
    """Records of extracted memories; the id is a hash of tenant, claim and source, so extracting again replaces them. hint: a column with a date."""
    uri = F.when(F.col("line") > 0, F.concat(F.lit(f"{source}#L"), F.col("line").cast("string"))).otherwise(F.lit(source))
    from_ = F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.col(hint), F.lit("yyyy-MM-dd"))), F.lit(now)) if hint else F.lit(now)
    name = F.concat(F.lit(str(tenant)), F.lit("\0"), "claim", F.lit("\0"), F.lit(source))
    mask = F.lit(0xFFFF).cast("long")
    return memories.select(
        F.substring(F.sha2(name, 256), 1, 32).alias("capsule_id"), F.lit(tenant).cast("long").alias("tenant_id"), "claim", "evidence", F.lit(source).alias("source_id"), uri.alias("source_uri"), from_.cast("long").alias("valid_from"), F.lit(now).cast("long").alias("observed_at"),
        F.lit(now).cast("long").alias("last_verified_at"), mask.alias("context_mask"), mask.alias("policy_mask"), F.greatest(F.lit(0), F.least(F.lit(10), F.col("trust"))).cast("int").alias("trust_level"), F.lit(1).alias("classification"), F.lit(0).alias("poison_risk"),
    )


def extract_with(utterances: DataFrame, ask) -> DataFrame:
    """Extraction by a model: ask(text) returns JSON {"memories": [{"claim", "evidence", "line", "trust"}]}. Answers that are no
    such JSON give nothing; trust is kept within 0 to 10."""

    def run(frames):
        for pdf in frames:
            out = []
            for line, speaker, said in zip(pdf["line"], pdf["speaker"], pdf["utterance"]):
                try:
                    got = json.loads(ask(f"{speaker}: {said}"))["memories"]
                    out += [(int(m.get("line") or line), speaker, "model", max(0, min(10, int(m["trust"]))), str(m["claim"]), str(m.get("evidence") or said)) for m in got]
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue
            yield pd.DataFrame(out, columns=["line", "speaker", "kind", "trust", "claim", "evidence"])

    return utterances.select(F.col("line").cast("long").alias("line"), "speaker", "utterance").mapInPandas(run, "line long, speaker string, kind string, trust int, claim string, evidence string")

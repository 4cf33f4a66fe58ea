"""Quality rules with host-level verdicts, in DataFrame functions only.

Per document: counts over the whole text and a base rule. Per host (any column): the share of documents that fail a
rule, shrunk by a beta prior that is fitted to all hosts; a host whose lower posterior bound passes `host_limit` is
rejected with all its documents.

Defined cases: a null text has no words and fails; a null host is never judged as a host; repeated rows and ids are
judged row by row; an empty table gives an empty result; other columns, whatever their names, are not touched; texts of
any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memgate.llm._shared import free_name, materialize

BLANK = r"[\x20\x09-\x0D]"
WINDOW = 8
#: A broadcast of host verdicts takes at most so many hosts (below 10 MB); beyond it the join shuffles.
BROADCAST_HOSTS = 100_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words that lie in windows of WINDOW words found twice or more."""

    def covered(win: Column) -> Column:
        order = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        starts = let(order, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: same(s, j - 1, x) | same(s, j + 1, x)), lambda x: x["i"])))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    wins = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    count = let(wins, lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(covered(win)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(count)


def rule_flags(text: Column) -> Column:
    """struct(base, soft): whether a text fails the base rule, and that or one of the softer ones."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]"))

    def flags(w: Column) -> Column:
        n = F.size(w)
        base = (n < 20) | (100 * repeat_words(w) > 30 * n)
        return let(base, lambda b: F.struct(b.alias("base"), (b | (10 * symbols > n) | (F.length(F.array_join(w, "")) > 12 * n)).alias("soft")))

    return let(words_of(text), flags)


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One narrow row per document: id, host, counts, base_failed and soft_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    lines = let(F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")), lambda s: F.size(s) - F.size(F.array_distinct(s)))
    c = F.col("c")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), counted.alias("c"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.cast("long").alias("n_dup_lines"))
    rows = rows.select("doc_id", "host", c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), "n_symbols", "n_dup_lines", c["n_repeat_words"].alias("n_repeat_words"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    soft = base | (10 * F.col("n_symbols") > F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))
    return rows.withColumns({"base_failed": base, "soft_failed": soft})


def host_verdicts(counts: DataFrame, host_limit: float = 0.8, sds: float = 2.0) -> DataFrame:
    """Per host: posterior mean, lower bound and verdict. The prior's mean is the overall rate, its weight comes from the spread of the hosts' rates (moments)."""
    per = counts.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("soft_failed").cast("long")).alias("x"))
    total = per.agg(F.sum("n").alias("sn"), F.sum("x").alias("sx"), F.sum(F.col("n") * F.col("n")).alias("snn"), F.sum(F.col("x") * F.col("x") / F.col("n")).alias("sxx"), F.count("*").alias("k"))
    m = F.col("sx") / F.col("sn")
    spread = F.col("sxx") - F.col("sn") * m * m  # sum of n * (rate - m)^2
    within = m * (1 - m)
    rho = F.try_divide(spread - (F.col("k") - 1) * within, (F.col("sn") - F.col("snn") / F.col("sn") - (F.col("k") - 1)) * within)
    weight = F.when(rho.isNull() | (rho <= 0.001), F.lit(1000.0)).when(rho >= 0.5, F.lit(1.0)).otherwise(1 / rho - 1)
    prior = total.select(m.alias("m"), weight.alias("w")).filter("m IS NOT NULL")
    rated = per.crossJoin(F.broadcast(prior))  # the prior is a single row
    mean = (F.col("x") + F.col("m") * F.col("w")) / (F.col("n") + F.col("w"))
    low = mean - sds * F.sqrt(mean * (1 - mean) / (F.col("n") + F.col("w") + 1))
    return rated.select("host", mean.alias("host_rate"), low.alias("host_low"), (low > host_limit).alias("host_rejected"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.8) -> DataFrame:
    """Counts, base_failed, host_rate and kept for every document."""
    counts = materialize(rule_counts(docs, id_col, text_col, host_col))
    verdicts = materialize(host_verdicts(counts, host_limit).select("host", "host_rate", "host_rejected"))
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    judged = counts.join(verdicts, "host", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.8) -> DataFrame:
    """The rows of docs that judge() keeps, all columns as they were.

    Each text is counted once: rows are written with their flags, those that fail the base rule without their text; the
    hosts are judged on the flags, and rejected hosts leave by an anti join that does not move the text."""
    base, soft = free_name(docs, "base_failed"), free_name(docs, "soft_failed")
    flags = rule_flags(F.col(text_col))
    marked = docs.withColumn(base, flags).withColumns({soft: F.col(f"{base}.soft"), base: F.col(f"{base}.base")})
    kind = docs.schema[text_col].dataType
    marked = materialize(marked.withColumn(text_col, F.when(~F.col(base), F.col(text_col)).cast(kind)))
    bad = host_verdicts(marked.select(F.col(host_col).alias("host"), F.col(soft).alias("soft_failed")), host_limit)
    host = free_name(docs, "host")
    bad = materialize(bad.filter("host_rejected").select(F.col("host").alias(host)))
    if bad.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    return marked.filter(~F.col(base)).join(bad, F.col(host_col) == F.col(host), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

"""Candidates, scores, ranks, budgets and relations over gated (probe, record) pairs.

All scores are taken where the pair is made; only ids and the keys that order them travel further."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memgate.functions import fingerprint
from memgate.operators import gates
from memgate.operators.scratch import materialize

NEAR, CAP, ANN_ABOVE, RRF_K = 180, 2048, 4096, 60
MODES = ("native", "parent", "hybrid", "fusion_parent")


def postings(records: DataFrame, column: str = "anchors") -> DataFrame:
    return records.select("tenant_id", "capsule_id", F.explode(column).alias("term"))


def term_hits(records: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, record) pairs that share terms, with their number, by an equi-join on (tenant, term)."""
    terms = probes.select("probe_id", "tenant_id", F.explode("terms").alias("term"))
    return postings(records).join(terms, ["tenant_id", "term"]).groupBy("probe_id", "capsule_id").agg(F.count("*").alias("hits"))


def overlap(column: str) -> Column:
    return F.size(F.array_intersect(column, "terms"))


def band_candidates(records: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, record) pairs of a tenant that agree in one of the 16 fingerprint lanes."""
    own = records.select("tenant_id", "capsule_id", F.posexplode("fp").alias("band", "key"))
    ask = probes.select("tenant_id", "probe_id", F.posexplode("probe_fp").alias("band", "key"))
    return own.join(ask, ["tenant_id", "band", "key"]).select("probe_id", "capsule_id").distinct()


def dense_candidates(records: DataFrame, probes: DataFrame, flips: int = 0) -> DataFrame:
    """(probe, record) pairs of a tenant whose vectors agree in one band of the sign signature, up to `flips` bits."""
    own = records.select("tenant_id", "capsule_id", F.size("embedding").alias("dim"), F.posexplode(fingerprint.simhash_bands(F.col("embedding"))).alias("band", "key"))
    ask = probes.select("tenant_id", "probe_id", F.size("probe_embedding").alias("dim"), F.posexplode(fingerprint.simhash_bands(F.col("probe_embedding"))).alias("band", "k"))
    ask = ask.select("tenant_id", "probe_id", "dim", "band", F.explode(fingerprint.near_keys(F.col("k"), flips)).alias("key"))
    return own.join(ask, ["tenant_id", "dim", "band", "key"]).select("probe_id", "capsule_id").distinct()


def measured(pairs: DataFrame) -> DataFrame:
    """Pairs with what the scores are made of."""
    return pairs.withColumns({"entity_overlap": overlap("entities"), "anchor_overlap": overlap("anchors"), "hamming": fingerprint.hamming(F.col("fp"), F.col("probe_fp")), "residual_dot": fingerprint.residual_dot(F.col("residual"), F.col("probe_residual"))})


def supported(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Records with the number of their outgoing Supports edges, unless they have it."""
    if "supports" in records.columns:
        return records
    n = edges.filter("kind = 'Supports'").groupBy(F.col("from").alias("capsule_id")).agg(F.count("*").alias("supports"))
    return records.join(n, "capsule_id", "left").na.fill(0, ["supports"])


def age() -> Column:
    return F.greatest(F.col("as_of") - F.col("last_verified_at"), F.lit(0)) / F.lit(86400.0)


def semantic_score() -> Column:
    """4 entities + 1.2 anchors + 2 (1 - hamming / 256) + dot / 128 + bits of the record's context / 128 + trust / 10 + freshness + 0.05 supports - 0.5 poison."""
    return (
        F.lit(4.0) * F.col("entity_overlap") + F.lit(1.2) * F.col("anchor_overlap") + F.lit(2.0) * (1 - F.col("hamming") / F.lit(256.0)) + F.col("residual_dot") / F.lit(128.0)
        + F.bit_count("context_mask") / F.lit(128.0) + F.col("trust_level") / F.lit(10.0) + 1 / (1 + age() / F.lit(365.0)) + F.lit(0.05) * F.col("supports") - F.lit(0.5) * F.col("poison_risk")
    )


def native_score() -> Column:
    return semantic_score() + F.lit(2.0) * F.col("entity_overlap")


def lexical() -> Column:
    """Terms that occur anywhere in the record's text, plus anchors met."""
    whole = F.lower(F.concat_ws(" ", "claim", "evidence"))
    return F.element_at(F.transform(F.array(whole), lambda w: F.size(F.filter("terms", lambda t: F.contains(w, t)))), 1) + F.col("anchor_overlap")


def temporal() -> Column:
    return 1 / (1 + age())


def exact() -> Column:
    return F.col("entity_overlap") + F.col("anchor_overlap")


def hybrid_score() -> Column:
    return F.lit(1.2) * lexical() + semantic_score() + F.lit(2.0) * exact() + temporal()


def fusion_score() -> Column:
    return F.lit(0.8) * lexical() + semantic_score() + F.lit(1.5) * exact() + F.lit(0.5) * temporal()


def hit() -> Column:
    return exact() > 0


def near(most: int = NEAR) -> Column:
    """Within the Hamming distance, or in the same bucket."""
    return (F.col("hamming") <= most) | (F.get("fp", F.lit(0)) == F.get("probe_fp", F.lit(0)))


KEYS = ("probe_id", "capsule_id", "source_id", "trust_level", "last_verified_at")


def pool(records: DataFrame, probes: DataFrame, edges: DataFrame | None, cap: int = CAP, most: int = NEAR) -> DataFrame:
    """The candidates of each probe by the exact path: gated pairs that are hits or near, or all where a probe has none; at most
    `cap`, hits first, then by Hamming distance and id. With native scores (`score`) and `place`."""
    pairs = measured(gates.admitted(records, probes)).select(*KEYS, native_score().alias("score"), (hit() | near(most)).alias("chosen"), hit().alias("hit"), "hamming")
    if edges is not None:
        pairs = gates.not_superseded(pairs, records, probes, edges)
    # chosen rows come first, so the cap keeps them, and the first row tells whether there are any
    order = Window.partitionBy("probe_id").orderBy(~F.col("chosen"), ~F.col("hit"), "hamming", "capsule_id")
    first = pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap)
    some = F.max("chosen").over(Window.partitionBy("probe_id"))
    return first.withColumn("some", some).filter(F.col("chosen") | ~F.col("some")).select(*KEYS, "score", "hamming", "place")


def ann_pool(records: DataFrame, probes: DataFrame, edges: DataFrame | None, cap: int = CAP, flips: int = 0) -> DataFrame:
    """Candidates by equi-joins only: tier 0 shares a band of the dense signature, 1 a term, 2 a lane of the fingerprint; the
    gates hold for every one, and before rows of common terms and lanes move. At most `cap` a probe, by tier, Hamming distance and id."""
    own, ask = records.select(*gates.GATED, F.explode(F.array_union("anchors", "entities")).alias("key")), probes.select(*gates.ASKED, F.explode("terms").alias("key"))
    lanes, asked = records.select(*gates.GATED, F.posexplode("fp").alias("band", "key")), probes.select(*gates.ASKED, F.posexplode("probe_fp").alias("band", "key"))
    met = own.join(ask, ["tenant_id", "key"]), lanes.join(asked, ["tenant_id", "band", "key"])
    tiers = [t.filter(gates.hard()).select("probe_id", "capsule_id", F.lit(k).alias("tier")) for k, t in enumerate(met, 1)]
    if "embedding" in records.columns and "probe_embedding" in probes.columns:
        tiers.append(dense_candidates(records, probes, flips).withColumn("tier", F.lit(0)))
    found = reduce(DataFrame.unionByName, tiers).groupBy("probe_id", "capsule_id").agg(F.min("tier").alias("tier"))
    pairs = found.join(records, "capsule_id").join(probes, ["probe_id", "tenant_id"]).filter(gates.hard())
    pairs = measured(pairs).select(*KEYS, native_score().alias("score"), "hamming", "tier")
    if edges is not None:
        pairs = gates.not_superseded(pairs, records, probes, edges)
    order = Window.partitionBy("probe_id").orderBy("tier", "hamming", "capsule_id")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap).drop("tier")


def candidates(records: DataFrame, probes: DataFrame, edges: DataFrame | None, above: int = ANN_ABOVE, cap: int = CAP, flips: int = 0) -> DataFrame:
    """pool() for probes with at most `above` gated records and for those whose ann_pool() is empty; ann_pool() for all others."""
    gated = gates.admitted(records.select(*gates.GATED), probes.select(*gates.ASKED))
    if edges is not None:
        gated = gates.not_superseded(gated, records, probes, edges)
    many = gated.groupBy("probe_id").count().filter(F.col("count") > above).select("probe_id")
    # read three times below: to tell which probes are left, to count these, and as the result
    found = materialize(ann_pool(records, probes.join(many, "probe_id", "left_semi"), edges, cap, flips))
    rest = probes.join(found.select("probe_id").distinct(), "probe_id", "left_anti")
    return pool(records, rest, edges, cap).unionByName(found)


def top_k(scored: DataFrame, k: int = 8) -> DataFrame:
    """Rank by score, trust, last verification, id; keep k a probe. The limit holds within each task before rows move."""
    order = Window.partitionBy("probe_id").orderBy(F.desc("score"), F.desc("trust_level"), F.desc("last_verified_at"), "capsule_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def retrieve(records: DataFrame, probes: DataFrame, edges: DataFrame, mode: str = "native", k: int = 8, above: int | None = None) -> DataFrame:
    """probe_id, rank, capsule_id, score and the keys. Unknown modes are an error. `above`: the gated count from which candidates
    come from the index (native and parent); None scans."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if k < 1:
        raise ValueError("k must be positive")
    records = supported(records, edges)
    if mode in ("native", "parent"):
        pairs = pool(records, probes, edges) if above is None else candidates(records, probes, edges, above)
        pairs = pairs.withColumn("score", F.round("score", 6))
    else:
        score = hybrid_score if mode == "hybrid" else fusion_score
        pairs = measured(gates.admitted(records, probes)).select(*KEYS, F.round(score(), 6).alias("score"))
    if mode.endswith("parent"):
        pairs = parent_rollup(top_k(pairs, 4 * k) if mode == "parent" else pairs)
    return top_k(pairs, k)


def dense_hybrid(records: DataFrame, probes: DataFrame, edges: DataFrame, k: int = 8) -> DataFrame:
    """The native pool ranked by the sum of reciprocal ranks by native score and by cosine of the vectors (embedding, probe_embedding)."""
    own = pool(supported(records, edges), probes, edges)
    own = own.join(records.select("capsule_id", "embedding"), "capsule_id").join(probes.select("probe_id", "probe_embedding"), "probe_id")
    own = own.select(*KEYS, F.round("score", 6).alias("native"), F.round(fingerprint.cosine(F.col("embedding"), F.col("probe_embedding")), 6).alias("cosine"))
    by = Window.partitionBy("probe_id")
    ranks = [F.row_number().over(by.orderBy(F.desc(c), "capsule_id")) for c in ("native", "cosine")]
    return top_k(own.withColumn("score", F.round(sum(1 / (F.lit(float(RRF_K)) + r) for r in ranks), 9)), k)


def parent_rollup(scored: DataFrame, bonus: float = 0.03) -> DataFrame:
    """Per probe and source the best record; its score grows by bonus for every further one. Combined within each task first."""
    best = F.min(F.struct((-F.col("score")).alias("s"), (-F.col("trust_level")).alias("t"), (-F.col("last_verified_at")).alias("l"), "capsule_id")).alias("b")
    own = scored.groupBy("probe_id", "source_id").agg(best, F.count("*").alias("n"))
    return own.select("probe_id", "b.capsule_id", "source_id", (-F.col("b.t")).alias("trust_level"), (-F.col("b.l")).alias("last_verified_at"), F.round(-F.col("b.s") + F.lit(bonus) * (F.col("n") - 1), 6).alias("score"))


def budgeted(ranked: DataFrame, budget: int) -> DataFrame:
    """Walk each probe's ranks: the first record is always in, a later one if it fits what is left; one that does not fit is passed over."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "capsule_id", "tokens")))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<rank:int,capsule_id:bigint,tokens:int>>").alias("kept"))

    def step(acc, x):
        fits = (F.size(acc["kept"]) == 0) | (acc["used"] + x["tokens"] <= budget)
        return F.when(fits, F.struct((acc["used"] + x["tokens"]).alias("used"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    walked = ranked.groupBy("probe_id").agg(F.aggregate(rows, start, step, lambda a: a["kept"]).alias("kept"))
    return walked.select("probe_id", F.explode("kept").alias("x")).select("probe_id", "x.rank", "x.capsule_id", "x.tokens")


def related(ranked: DataFrame, edges: DataFrame, records: DataFrame, probes: DataFrame, kinds=("Contradicts", "Supersedes", "Supports")) -> DataFrame:
    """One hop from the ranked records: targets of the probe's tenant that pass the authorization gates (all hard gates for Supports), with their notes in edge order."""
    out = ranked.select("probe_id", F.col("capsule_id").alias("from"), "rank").join(edges.filter(F.col("kind").isin(*kinds)).drop("tenant_id"), "from")
    seen = out.join(records.select(*gates.GATED).withColumnRenamed("capsule_id", "to"), "to").join(probes.select(*gates.ASKED), ["probe_id", "tenant_id"])
    seen = seen.filter(F.when(F.col("kind") == "Supports", gates.hard()).otherwise(gates.authorization()))
    note = F.format_string("%s from %s to %s weight %d", "kind", F.col("from").cast("string"), F.col("to").cast("string"), "weight")
    return seen.groupBy("probe_id", F.col("to").alias("capsule_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", note.alias("note")))), lambda x: x["note"]), "; ").alias("notes"))


def reciprocal_rank_fusion(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, item, rank from 1, any number of lists) to the sum of 1 / (k + rank)."""
    return lists.groupBy("query_id", "item").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("rrf"))


def fused_runs(first: DataFrame, *others: DataFrame, k: int = RRF_K) -> DataFrame:
    """The first run decides which queries there are; lists of the others are fused into them."""
    drives = first.select("query_id").distinct()
    lists = reduce(DataFrame.unionByName, [r.select("query_id", "item", "rank") for r in (first, *others)])
    return reciprocal_rank_fusion(lists.join(drives, "query_id", "left_semi"), k)

"""Queries opN_<name> of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memgate.llm import decontam, language_id, licences, ngram_join, pieces, quality_rules, secret_scan, sharding, url_rules, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A small table in fewer files than cores, such as one row group, is dealt out to all cores first."""
    path = f"{sf_dir}/{name}.parquet"
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return rows.repartition(cores) if len(rows.inputFiles()) < cores and size < cores << 27 else rows


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    guessed = language_id.predict(docs, language_id.learn(docs))
    return guessed.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


#: Small shards of some hundred texts, so that tables of any size split.
SHARD_BYTES = 256 << 10


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return placed.select("doc_id", "bytes", "shard", "depth", "shard_bytes", "oversize")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url")).withColumn("rate", F.round("rate", 6))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of all pages against a replica: every 97th page has its first character changed to a '#', every 89th is
    lost, and a copy of every 83rd has come in under a negative id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    i = F.col("page_id")
    hurt = F.when(i % 97 == 13, F.overlay("html", F.lit("#"), F.lit(1), F.lit(1))).otherwise(F.col("html"))
    kept = pages.withColumn("html", hurt).filter((i % 89 != 7) | i.isNull())
    come = pages.filter(i % 83 == 5).withColumn("page_id", -1 - i)
    found = warc.audit(warc.layout(pages), warc.layout(kept.unionByName(come)))
    return found.withColumnRenamed("id", "page_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_pieces, op3_language_id, op4_sharding, op5_decontamination, op6_url_filter, op7_warc_fixity, op8_quality_rules, op9_secret_scan, op10_licence_scan)}

_TEMPLATES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licences.TEMPLATES)

ORACLES = {
    "op4_sharding": f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS k FROM documents),
n AS (SELECT depth, k >> (60 - depth) AS p, sum(bytes)::BIGINT AS b, min(k) = max(k) AS one FROM d, (SELECT unnest(range(0, 61))::INT AS depth) GROUP BY ALL),
r AS (SELECT DISTINCT k FROM d), q AS (SELECT k, min(n.depth) AS depth FROM r, n WHERE n.p = k >> (60 - n.depth) AND (n.b <= {SHARD_BYTES} OR one) GROUP BY k),
f AS (SELECT d.*, q.depth FROM d JOIN q USING (k))
SELECT doc_id, bytes, CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(k >> (60 - f.depth)), f.depth, '0') END AS shard, f.depth, b AS shard_bytes, b > {SHARD_BYTES} AS oversize
FROM f, n WHERE n.depth = f.depth AND n.p = f.k >> (60 - f.depth)
""",
    "op6_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r(rule, h, p, v) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
m AS (SELECT page_id, host, path, (SELECT max_by(rule, length(rule)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule FROM u),
j AS (SELECT m.*, v FROM m LEFT JOIN r ON m.rule = r.rule),
h AS (SELECT host, CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN (SUFFIXES) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain, CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN (SUFFIXES) THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE string_split(host, '.')[-1] END AS suffix, count(v) AS n, count(CASE WHEN v = 'block' THEN 1 END) AS x FROM j GROUP BY host),
t AS (SELECT coalesce(sum(x) / nullif(sum(n), 0)::DOUBLE, 0) AS p0 FROM h),
s0 AS (SELECT suffix, p0, sum(n) AS n, sum(x) AS x FROM h, t GROUP BY ALL),
s1 AS (SELECT (sum((x - n * p0) ** 2) - sum(n * p0 * (1 - p0))) / nullif(sum(n * (n - 1) * p0 * (1 - p0)), 0) AS rho FROM s0),
s2 AS (SELECT coalesce(CASE WHEN rho <= 0 THEN 1000.0 ELSE greatest(1.0, least(1000.0, 1 / rho - 1)) END, 1000.0)::DOUBLE AS w FROM s1),
s AS (SELECT suffix, (x + p0 * w) / (n + w) AS ps FROM s0, s2),
d0 AS (SELECT domain, ps, sum(n) AS n, sum(x) AS x FROM h JOIN s USING (suffix) GROUP BY ALL),
d1 AS (SELECT (sum((x - n * ps) ** 2) - sum(n * ps * (1 - ps))) / nullif(sum(n * (n - 1) * ps * (1 - ps)), 0) AS rho FROM d0),
d2 AS (SELECT coalesce(CASE WHEN rho <= 0 THEN 1000.0 ELSE greatest(1.0, least(1000.0, 1 / rho - 1)) END, 1000.0)::DOUBLE AS w FROM d1),
d AS (SELECT domain, (x + ps * w) / (n + w) AS pd FROM d0, d2),
h0 AS (SELECT host, pd, n, x FROM h JOIN d USING (domain)),
h1 AS (SELECT (sum((x - n * pd) ** 2) - sum(n * pd * (1 - pd))) / nullif(sum(n * (n - 1) * pd * (1 - pd)), 0) AS rho FROM h0),
h2 AS (SELECT coalesce(CASE WHEN rho <= 0 THEN 1000.0 ELSE greatest(1.0, least(1000.0, 1 / rho - 1)) END, 1000.0)::DOUBLE AS w FROM h1),
q AS (SELECT host, (x + pd * w) / (n + w) AS ph, n + w AS size FROM h0, h2)
SELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN ph - 2 * sqrt(ph * (1 - ph) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(ph, 6) AS rate
FROM j JOIN q ON j.host = q.host
""".replace("SUFFIXES", ", ".join(f"'{s}'" for s in url_rules.SUFFIXES)),
    "op7_warc_fixity": r"""
WITH p AS (SELECT page_id, url, html FROM pages),
t AS (SELECT page_id, url, CASE WHEN page_id % 97 = 13 AND html <> '' THEN '#' || html[2:] ELSE html END AS html FROM p WHERE page_id % 89 <> 7 OR page_id IS NULL UNION ALL SELECT -1 - page_id, url, html FROM p WHERE page_id % 83 = 5),
b AS (SELECT 1 AS side, * FROM p UNION ALL SELECT 2, * FROM t),
r AS (SELECT side, page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM b),
s AS (SELECT side, page_id, sha256(rec) AS digest, strlen(rec)::BIGINT AS length FROM r),
o AS (SELECT *, row_number() OVER w - 1 AS ordinal, (sum(length) OVER (w ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS start FROM s WINDOW w AS (PARTITION BY side ORDER BY page_id NULLS FIRST, digest))
SELECT x.page_id, x.ordinal, x.start, x.length, x.digest, CASE WHEN x.digest = y.digest THEN 'same' WHEN y.digest IS NULL THEN 'lost' ELSE 'changed' END AS state FROM o x LEFT JOIN o y ON y.side = 2 AND x.page_id = y.page_id WHERE x.side = 1
UNION ALL SELECT page_id, ordinal, start, length, digest, 'added' FROM o WHERE side = 2 AND page_id NOT IN (SELECT page_id FROM p)
""",
    "op10_licence_scan": rf"""
WITH l(licence, t) AS (VALUES {_TEMPLATES}),
tw AS (SELECT licence, t, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM l),
tg AS (SELECT licence, t, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw),
d AS (SELECT doc_id, list_concat(string_split(coalesce(text, ''), chr(10)), list_filter(string_split_regex(coalesce(text, ''), '\n[\x20\x09\r]*\n'), lambda s: contains(trim(s), chr(10)))) AS us FROM documents),
u AS (SELECT doc_id, i, regexp_extract_all(translate(us[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT doc_id, us, unnest(range(1, len(us) + 1)) AS i FROM d)),
b AS (SELECT doc_id, i, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM u WHERE len(w) BETWEEN 2 AND 300),
c AS (SELECT doc_id, i, licence, 2.0::DOUBLE * len(list_intersect(b.g, tg.g)) / (len(b.g) + len(tg.g)) AS dice FROM b, tg WHERE list_has_any(b.g, tg.g)),
e AS (SELECT doc_id, i, licence, dice FROM c WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY dice DESC, licence) = 1)
SELECT doc_id, licence, count(*) AS n_units, round(max(dice), 6) AS dice FROM e GROUP BY doc_id, licence
""",
    "op8_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
hit AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least(8, i - coalesce(p, i - 8))) AS n FROM (SELECT *, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM hit) GROUP BY rid),
c AS (SELECT w.rid, doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON w.rid = rep.rid),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
s AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR word_chars > 12 * n_words AS soft FROM f),
per AS (SELECT host, count(*) AS n, sum(soft::INT) AS x FROM s WHERE host IS NOT NULL GROUP BY host),
tot AS (SELECT sum(n) AS sn, sum(x) AS sx, sum(n * n) AS snn, sum(x * x / n::DOUBLE) AS sxx, count(*) AS k, sum(x)::DOUBLE / sum(n) AS m FROM per),
rho AS (SELECT m, (sxx - sn * m * m - (k - 1) * m * (1 - m)) / nullif((sn - snn / sn::DOUBLE - (k - 1)) * m * (1 - m), 0) AS r FROM tot),
pri AS (SELECT m, CASE WHEN r IS NULL OR r <= 0.001 THEN 1000.0 WHEN r >= 0.5 THEN 1.0 ELSE 1 / r - 1 END AS w FROM rho),
post AS (SELECT host, n, w, (x + m * w) / (n + w) AS mean FROM per, pri),
bad AS (SELECT host FROM post WHERE mean - 2.0 * sqrt(mean * (1 - mean) / (n + w + 1)) > 0.8)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (host IS NULL OR host NOT IN (SELECT host FROM bad)) AS kept FROM s
""",
}

import re

from memgate.functions import text
from memgate.operators import gates
from memgate.plans import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_coverage_without_moving_pairs(spark, monkeypatch):
    """Counts are taken where pairs are made: no join by probe and record, whose rows would carry the record's terms."""
    one = catalog.coverage_counters(spark, SF)
    assert not re.search(r"Join \[probe_id#\d+L?, capsule_id", one._jdf.queryExecution().executedPlan().toString())
    want = sorted(map(tuple, one.collect()))
    monkeypatch.setattr(gates, "BROADCAST_PAIRS", 0)
    assert sorted(map(tuple, catalog.coverage_counters(spark, SF).collect())) == want and any(r[6] for r in want)


def test_terms_fold_ascii_alone(spark):
    rows = [("Abc ABC abc. -ÉTÉ-xyz aKey İabc ab :A/b@C:",), (None,), ("",)]
    got = spark.createDataFrame(rows, "t string").select(text.extract_terms(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == [["a/b@c", "abc", "akey", "xyz"], None, []]


def test_index_path_reads_records_once(spark, monkeypatch):
    """Terms and fingerprints are made once, and of common terms only gated pairs move."""
    made = []
    keep = catalog.materialize
    monkeypatch.setattr(catalog, "materialize", lambda df: made.append(df.columns) or keep(df))
    rows = catalog.ann_recall(spark, SF)
    assert "sha2" not in rows._jdf.queryExecution().optimizedPlan().toString() and "evidence" not in made[0]
    assert all(r.found <= r.exact for r in rows.collect())

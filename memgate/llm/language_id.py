"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile ranks the most frequent letter 1- to 3-grams (words padded with a boundary). A document takes the language
whose profile is nearest: the sum, over the document's own top n-grams, of how far each lies from its place in the
language's profile, with the profile's length as the penalty for one that is missing.

Profiles are learnt from a bounded sample: of each language the `per_lang` training rows of smallest id hash.
Defined cases: a null text, or one without letters, is `und` with score 0, as is everything when nothing was learnt;
ties go to the language that sorts first; rows with a null id are predicted, held_out false, and never learnt from.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memgate.llm._shared import materialize, small_batches, text_slices

TOP = 400
PER_LANG = 2000
#: The sample's bounds, one row a language, are broadcast up to so many languages (below 10 MB); beyond, the join shuffles.
BROADCAST_LANGS = 100_000
SALTS = 64
_state: dict = {}


def letter_codes() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    if "codes" not in _state:
        _state["codes"] = np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.int64)
    return _state["codes"]


def gram_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, coded by 21 bits a letter, and their counts: 3-grams with a letter in the middle, and
    (as negative numbers) the 2-grams they begin with and the letters."""
    c = letter_codes()[np.frombuffer(raw.decode().lower().encode("utf-32-le"), np.uint32)]
    edge = np.zeros(1, np.int64)
    c = np.concatenate((edge, c, edge))
    keep = c != 0
    keep[1:] |= c[:-1] != 0
    c = c[keep]
    if len(c) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if c[0]:
        c = np.concatenate((edge, c))
    tri = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[c[1:-1] != 0]
    g, n = np.unique(tri, return_counts=True)
    pair, at = np.unique(g >> 21, return_inverse=True)
    one, to = np.unique(pair & 0x1FFFFF, return_inverse=True)
    n2 = np.bincount(at, n).astype(np.int64)
    return np.concatenate((g, -pair, -one - (1 << 62))), np.concatenate((n, n2, np.bincount(to, n2).astype(np.int64)))


def ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The TOP n-grams by count, then code."""
    if len(grams) > 4 * TOP:
        keep = counts >= np.partition(counts, -TOP)[-TOP]
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:TOP]]


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> dict[str, np.ndarray]:
    """Profiles by language. Of each language the per_lang rows of smallest (hash, id) are read."""
    small_batches(docs.sparkSession)
    train = docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    # first within salts of a language, so that no task gets the rows of a frequent one
    least = train.select("lang", "h", F.pmod("h", F.lit(SALTS)).alias("salt"))
    for by in (("lang", "salt"), ("lang",)):
        least = least.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("r") <= per_lang).drop("r")
    last = materialize(least.groupBy("lang").agg(F.max("h").alias("last")))
    sample = train.join(F.broadcast(last) if last.count() <= BROADCAST_LANGS else last, "lang").filter("h <= last").select("lang", "text")

    def count(batches):
        for langs, texts in text_slices(batches):
            got = [(k, g.tobytes(), n.tobytes()) for k, t in zip(langs, texts) for g, n in [gram_counts(t)] if len(g)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.binary()))], ["lang", "grams", "counts"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        g, at = np.unique(np.frombuffer(b"".join(pdf["grams"]), np.int64), return_inverse=True)
        n = np.bincount(at, np.frombuffer(b"".join(pdf["counts"]), np.int64)).astype(np.int64)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "profile": [ranked(g, n).tobytes()]})

    rows = sample.mapInArrow(count, "lang string, grams binary, counts binary").groupBy("lang").applyInPandas(merge, "lang string, profile binary").collect()
    return {r["lang"]: np.frombuffer(r["profile"], np.int64) for r in sorted(rows, key=lambda r: r["lang"])}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (1: the same ranks, 0: nothing shared) for every row."""
    spark = small_batches(docs.sparkSession)
    names = list(profiles)
    # every n-gram of a profile with its language and rank, sorted by n-gram
    grams = np.concatenate([*profiles.values(), np.empty(0, np.int64)])
    lang = np.repeat(np.arange(len(names)), [len(p) for p in profiles.values()])
    rank = np.concatenate([*(np.arange(len(p)) for p in profiles.values()), np.empty(0, np.int64)])
    order = np.argsort(grams, kind="stable")
    shared = spark.sparkContext.broadcast((grams[order], lang[order], rank[order]))

    def run(batches):
        grams, lang, rank = shared.value
        for ids, texts in text_slices(batches):
            pred, score = [], []
            for t in texts:
                top = ranked(*gram_counts(t)) if t and names else ()
                if not len(top):
                    pred.append("und")
                    score.append(0.0)
                    continue
                lo, hi = np.searchsorted(grams, top, "left"), np.searchsorted(grams, top, "right")
                n = hi - lo
                own = np.repeat(np.arange(len(top)), n)
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                near = np.bincount(lang[at], TOP - np.abs(rank[at] - own), minlength=len(names))
                k = int(near.argmax())  # the least distance: TOP for each n-gram but those
                pred.append(names[k])
                score.append(float(near[k]) / (TOP * len(top)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double")

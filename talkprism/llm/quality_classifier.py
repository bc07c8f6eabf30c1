"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of target texts and one of all texts, give
each document a log ratio, its importance weight. Keys are log weights plus Gumbel noise drawn
from a seeded hash of doc_id; the documents with the largest keys are a sample without
replacement in proportion to the weights.

The target is a sample of at most SAMPLE labelled rows (those first in a seeded hash order);
the raw model counts every document. Each bucket's log ratio is shrunk by how far the two counts
differ in standard deviations z, to z^4 / (z^4 + DOUBT) of it: rare words of the labelled rows,
which any other text lacks, hardly count, and no bucket is left out. At most BUCKETS pairs of
numbers reach the driver. How many documents to keep is given, or follows from a bounded sample
of labelled rows.

Defined cases: a null or empty text has log weight 0; a null doc_id is no label's and shares one
noise value; rows of equal key are kept or left together; repeated rows are scored each, a
repeated label counts each time; without labels the ratio is 0 everywhere and all are kept; an
empty table gives an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkprism.llm.common import materialize, words

BUCKETS = 1 << 20
#: Largest number of labelled rows that the target model learns from.
SAMPLE = 20_000
#: A ratio is halved where the counts differ by 2.8 standard deviations.
DOUBT = 64.0
SEED = 42
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> np.ndarray:
    """The bucket of every word and every pair of neighbouring words, A to Z in lower case."""
    own = [w.lower() for w in words(text)]
    ones = np.fromiter((xxhash.xxh64_intdigest(w) for w in own), dtype=np.uint64, count=len(own))
    twos = ones[:-1] * _PAIR + ones[1:]
    both = np.concatenate([ones, twos ^ (twos >> np.uint64(32))])
    return (both % np.uint64(BUCKETS)).astype(np.int64)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for text, chosen in zip(batch["text"], batch["target"], strict=True):
            at = features(text)
            np.add.at(raw, at, 1)
            if chosen:
                np.add.at(target, at, 1)
    full = np.flatnonzero(raw)
    yield pd.DataFrame({"bucket": full, "raw": raw[full], "target": target[full]})


def log_ratios(docs: DataFrame, target_ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, and for each the shrunk log of target to raw probability. ``docs``: doc_id, text; ``target_ids``: doc_id, at most SAMPLE rows."""
    chosen = F.broadcast(target_ids.select("doc_id").distinct().withColumn("target", F.lit(True)))
    rows = docs.join(chosen, "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = rows.mapInPandas(_counted, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = materialize(counts, "ratio-counts")
    all_raw, all_target = counts.agg(F.sum("raw"), F.sum("target")).first()
    if not all_target:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    expected = F.col("raw") * F.lit(all_target / all_raw)
    far = F.pow((F.col("target") - expected) / F.sqrt(expected + 1), F.lit(4.0))
    logs = F.log((F.col("target") + 1) / (expected + 1)) * far / (far + DOUBT)
    found = counts.select("bucket", logs.alias("log")).toArrow()
    return found["bucket"].to_numpy(), found["log"].to_numpy()


def _weigher(shared):
    @F.pandas_udf(T.DoubleType())
    def weigh(texts: pd.Series) -> pd.Series:
        buckets, logs = shared.value
        table = np.zeros(BUCKETS)
        table[buckets] = logs
        return pd.Series([float(table[features(t)].sum()) for t in texts], dtype="float64")

    return weigh


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096, few: int = 1000) -> float:
    """The k-th largest value: counts in ever narrower bins, then at most ``few`` values or one value."""
    above, lo, hi = 0, *rows.agg(F.min(column), F.max(column)).first()
    while lo < hi:
        width = (hi - lo) / bins
        inside = rows.where((F.col(column) >= lo) & (F.col(column) <= hi))
        at = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("int")
        counts = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)), F.min(column), F.max(column)).collect()
        for _, n, least, most in sorted(counts, reverse=True):
            if above + n >= k:
                break
            above += n
        if (least, most) == (lo, hi) or n <= few:
            inside = rows.where((F.col(column) >= least) & (F.col(column) <= most)).select(column)
            if n <= few:
                return sorted((r[0] for r in inside.collect()), reverse=True)[k - above - 1]
        lo, hi = least, most
    return lo


def separating_weight(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut of the log weight that tells good rows from others best, by balanced accuracy; without others the least."""
    if good.all() or not good.any():
        return float(weights.min(initial=-math.inf))
    order = np.argsort(-weights, kind="stable")
    weights, good = weights[order], good[order]
    score = np.cumsum(good) / good.sum() - np.cumsum(~good) / (~good).sum()
    score[:-1][weights[:-1] == weights[1:]] = -1
    return float(weights[int(score.argmax())])


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, log_weight, key, kept) of every row of ``docs`` (doc_id, text). ``labels``: doc_id, quality, toxic; target rows are good and not toxic.

    ``share`` of the rows is kept; if not given, as many as reach the log weight that separates
    the target best from the other rows in a bounded sample of labelled rows.
    """
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    labelled = labels.where(F.col("doc_id").isNotNull()).select("doc_id", good.alias("good")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    ratios = log_ratios(docs.select("doc_id", "text"), labelled.where("good").limit(sample))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ratios)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "doc_id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    rows = docs.select("doc_id", _weigher(shared)("text").alias("log_weight"))
    rows = materialize(rows.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "resample-keys")
    if share is None:
        seen = rows.join(F.broadcast(labelled.limit(sample)), "doc_id").select("log_weight", "good").limit(2 * sample).collect()
        cut = separating_weight(np.array([r[0] for r in seen]), np.array([r[1] for r in seen], dtype=bool)) if seen else -math.inf
        k = rows.where(F.col("log_weight") >= F.lit(cut)).count()
    else:
        k = math.ceil(share * rows.count())
    least = kth_largest(rows, "key", k) if k else math.inf
    return rows.withColumn("kept", F.col("key") >= F.lit(least))

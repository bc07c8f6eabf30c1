"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has 64 bits, each the majority over the XXH64 hashes of its 4-word
shingles. Fingerprints at most 4 bits apart are linked; components of links are the groups.

Search: 4 differing bits leave one 32-bit half with at most 2. So both sides enumerate, for
each half, the Hamming ball of radius 1 (33 keys): halves at most 2 apart share a key. From
MANY fingerprints on, when chance would fill such keys, the segments are three of 21 or 22 bits
taken two at a time: of three pairs, 4 differing bits leave one with at most 2, and a key has 42
or 43 bits. Keys that several fingerprints share are fetched and the complete distance is
verified. A fingerprint with a crowded key (more than ``CROWD`` others) takes another exact way that stays
linear: it enumerates its full radius-2 ball; any two fingerprints that share a point are
within 4 bits, and any two within 4 bits share one, so each point links its members to its
smallest member. Equal fingerprints are one node throughout, so copies cost nothing.

Defined cases: a null or empty text, or one without words, has fingerprint 0 and is linked like
any other; ties and repeated rows share their node; a null doc_id stays in its group but never
names it (if all are null, the name is null); very long texts are read whole; an empty table
gives an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkprism.llm.common import free_name, lookup, materialize, words
from talkprism.llm.components import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
CROWD = 128
#: Different fingerprints from which on keys are pairs of three segments: a ball's key of 32 bits then has one member by chance.
MANY = 1 << 27
#: The bits that a key compares.
HALVES = (0xFFFFFFFF, 0xFFFFFFFF << 32)
PAIRS = ((1 << 42) - 1, (1 << 64) - (1 << 21), (1 << 21) - 1 | (1 << 64) - (1 << 42))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    tokens = words(text)
    if not tokens:
        return 0
    line = b" ".join(tokens).lower()
    ends = np.cumsum([len(w) + 1 for w in tokens]) - 1
    last = max(1, len(tokens) - shingle + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:last].tolist()
    stops = ends[min(shingle, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[i:j], SEED) for i, j in zip(starts, stops, strict=True)], dtype="<u8")
    set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * set_bits > len(hashes), bitorder="little")
    return int(majority.view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _keys(fp: Column, parts: tuple[int, ...]) -> Column:
    """(part, point) for each segment, or pair of segments, and each point at most one bit from the fingerprint's there."""

    def ball(part: int, mask: int) -> Column:
        flips = F.array(*[F.lit(_signed(x)) for x in (0, *(1 << b for b in range(64) if mask >> b & 1))])
        own = fp.bitwiseAND(F.lit(_signed(mask)))
        return F.transform(flips, lambda x: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(x).alias("point")))

    return F.concat(*[ball(i, m) for i, m in enumerate(parts)])


def _ball_of_two(fp: str) -> Column:
    """Every point at most two bits from the fingerprint: 1 + 64 + 2016."""
    one = "transform(sequence(0, 63), i -> shiftleft(1L, i))"
    two = "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) ^ shiftleft(1L, j))))"
    return F.expr(f"transform(concat(array(0L), {one}, {two}), m -> {fp} ^ m)")


def links(fps: DataFrame) -> DataFrame:
    """(a, b) of fingerprints; their components are those of all pairs at most RADIUS bits apart. ``fps``: column fp, distinct."""
    parts = HALVES if fps.count() < MANY else PAIRS
    entries = fps.select("fp", F.explode(_keys(F.col("fp"), parts)).alias("key")).select("fp", "key.part", "key.point")
    shared = entries.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("part", "point"))).where("n > 1")
    shared = shared.withColumn("crowded", F.max("n").over(Window.partitionBy("fp")) > CROWD + 1)
    shared = materialize(shared, "simhash-keys")

    left = shared.where("not crowded").select("part", "point", F.col("fp").alias("a"))
    right = shared.select("part", "point", F.col("fp").alias("b"), "crowded")
    once = (F.col("a") < F.col("b")) | F.col("crowded") & (F.col("a") != F.col("b"))
    near = left.join(right, ["part", "point"]).where(once & (distance(F.col("a"), F.col("b")) <= RADIUS))
    # Of the keys of a part that a pair shares, only the one that flips the lowest differing bit of a counts.
    mask = F.element_at(F.array(*[F.lit(_signed(x)) for x in parts]), F.col("part") + 1)
    own = F.col("a").bitwiseAND(mask)
    differ = own.bitwiseXOR(F.col("b").bitwiseAND(mask))
    top = F.lit(-(1 << 63))  # has no negative in 64 bits
    lowest = F.when(differ == top, top).otherwise(differ.bitwiseAND(-differ))
    near = near.where(own.bitwiseXOR(lowest) == F.col("point")).select("a", "b")

    dense = shared.where("crowded").select("fp").distinct()
    points = dense.select("fp", F.explode(_ball_of_two("fp")).alias("point"))
    stars = points.withColumn("hub", F.min("fp").over(Window.partitionBy("point"))).where("fp <> hub").select("hub", "fp").distinct()
    # A member links its own smallest hub to itself and to its other hubs; most members share both.
    stars = stars.withColumn("first", F.min("hub").over(Window.partitionBy("fp")))
    stars = stars.select(F.col("first").alias("a"), F.explode(F.array("fp", "hub")).alias("b")).where("a <> b").distinct()
    return near.union(stars)


def fingerprint_groups(fps: DataFrame) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``fps`` (column fp)."""
    roots = connected_components(links(fps)).select(F.col("node").alias("fp"), "root")
    return fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id of the row's group."""
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(F.col(text)).alias("fp")), "fingerprints")
    firsts = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-firsts")
    named = materialize(fingerprint_groups(firsts.select("fp")).join(firsts, "fp"), "fingerprint-roots")
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = materialize(lookup(named.select("fp", "root"), names, "root").select("fp", "component_id"), "fingerprint-names")
    return lookup(rows, by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, that of the smallest doc_id, with the columns of ``docs``. Rows with an equal or a null doc_id stay unless another row names their group."""
    keep = near_duplicates(docs, doc_id, text).where("doc_id <> component_id").select(F.col("doc_id").alias(free_name(docs, "gone"))).distinct()
    return docs.join(keep, docs[doc_id] == keep[keep.columns[0]], "left_anti")


def one_row_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one row of each group, with the columns of ``docs``: that of the smallest doc_id, nulls last; of rows with an equal or no doc_id, one."""
    number = free_name(docs, "number")
    # Written once, so a row's number is the same wherever it is read.
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(number).alias("number"))
    fps = materialize(numbered.select(order.alias("first"), _fingerprints(F.col(text)).alias("fp")), "fingerprints")
    firsts = materialize(fps.groupBy("fp").agg(F.min("first").alias("first")), "fingerprint-firsts")
    named = fingerprint_groups(firsts.select("fp")).join(firsts, "fp")
    winners = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.number").alias(number))
    return numbered.join(winners, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

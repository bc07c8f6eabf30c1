"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target number of words. Whole passes over a source come first; what is left
of the budget, less than one pass, is fitted on the counts of documents by exact length by
bounded-knapsack dynamic programming: exactly where some choice of documents adds up to it, else
as near as possible. The table has a state for each word of the budget. A budget above
SLACK_LENGTHS times the longest document (but within SLACK) is first filled proportionally, all
lengths alike, down to that; what is left is fitted with the documents still free, of which every
length has its share. Where that misses the budget, documents of the fill are taken back too, by a
dynamic programme over residues whose table doesn't depend on the budget. Documents of a chosen
length are taken in the order of a seeded hash.

A task sees the histogram of one source (distinct lengths, not documents). Ranks inside a length
are taken inside hash ranges, as many as keep SALT_ROWS rows in one, and offset by counts, so a
length or a text that makes up a third of the table is spread over tasks. Sources are ranked in a
distributed sort and their caps found by sums, so there may be as many as rows.

Defined cases: a null text has size 0; a very long text is counted whole; documents of size 0
take 0; a null source is a source of its own, last in order; equal sizes are told apart by hash,
then by doc_id, and rows that agree in all of these are alike, each counted on its own; an empty
table gives an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkprism.llm.common import free_name, materialize, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 42
#: Words left to the dynamic programme: so many of the longest document, within these bounds. Its table has five bytes a word.
SLACK_LENGTHS = 64
SLACK = (1 << 16, 1 << 24)
#: Hash ranges of a length: at least, and rows of the table to one.
SALTS = 64
SALT_ROWS = 1_000_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code point, null last, and share the total; none gets more than ``cap`` times its size, what is over goes to the others by weight.

    ``sizes``: source, size. Sources are ranked by their place in a sorted partition and the counts
    of the partitions before; each round of resharing is one sum over the sources.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()), "mix-sources")  # partition and place in it
    part, place = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("part", part).join(F.broadcast(counts.select("part", before.alias("before"))), "part")
    rank = (F.col("before") + place) % len(weights)
    rows = rows.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank + 1).cast("int")).alias("weight"), (cap * F.col("source_size")).alias("most"))
    rows = materialize(rows, "mix-weights")
    total, left_weight = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, share = total, 0.0
    while left_weight:
        share = left / left_weight
        over = F.col("most") < F.col("weight") * F.lit(share)
        full, free = rows.agg(F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        if (left, left_weight) == (total - (full or 0), free or 0):
            break
        left, left_weight = total - (full or 0), free or 0
    return rows.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(share))).alias("target"))


def _fill(lengths: list[int], counts: list[int], budget: int, slack: int) -> list[int]:
    """How many documents of each length go proportionally, then from the longest on, until at most ``slack`` words of the budget are left."""
    total, take = sum(n * c for n, c in zip(lengths, counts, strict=True)), []
    # Every length keeps its share, so free documents of every length remain.
    take = [c * max(0, budget - slack) // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        more = min(counts[i] - take[i], max(0, left - slack) // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    return take


def _halves(n: int) -> list[int]:
    """Parts 1, 2, 4, ... and a rest, which add up to any number up to ``n``."""
    parts, step = [], 1
    while n > 0:
        parts.append(min(step, n))
        n, step = n - step, step * 2
    return parts


def _add(lengths: list[int], free: list[int], left: int) -> list[int]:
    """How many free documents of each length come nearest to ``left`` words: a table with a state for each word."""
    take = [0] * len(lengths)
    end = left + max(lengths) + 1
    reached, first, parts, top = np.zeros(end, dtype=bool), np.zeros(end, dtype=np.int32), [], 0
    reached[0] = True  # first[s] is the part that first made s words
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        for n in _halves(min(free[i], left // lengths[i] + 1)):
            words = n * lengths[i]
            if words < end and not reached[left]:
                stop = min(end, top + words + 1)
                new = np.flatnonzero(reached[: stop - words] & ~reached[words:stop]) + words
                if len(new):
                    first[new], reached[new], top = len(parts), True, max(top, int(new[-1]))
                    parts.append((i, n))
    below = int(np.flatnonzero(reached[: left + 1])[-1])
    above = np.flatnonzero(reached[left + 1 : 2 * left - below])  # nearer than what lies below
    at = left + 1 + int(above[0]) if len(above) else below
    while at:  # what a part was added to was made by parts before it
        i, n = parts[first[at]]
        take[i] += n
        at -= n * lengths[i]
    return take


def _exchange(lengths: list[int], counts: list[int], take: list[int], gap: int, pivot: int, far: np.ndarray) -> tuple[list[int] | None, bool]:
    """``take`` changed by ``gap`` words or, if no choice does that, by the offset from it that ``far`` puts first; and whether none before that can be had.

    One length is the pivot. For every residue modulo it the table holds the fewest words that must
    be taken or taken back of the other lengths to reach it; the pivot makes up the rest. A residue
    needs fewer documents than the pivot has words, since of as many some add up to nothing modulo
    it. So parts are few, and if the pivot has documents enough on both sides, a sum that isn't
    found doesn't exist. The lengths have no common divisor.
    """
    modulus, none = lengths[pivot], 1 << 61
    cost, parts = np.full(modulus, none, dtype=np.int64), []
    words = np.zeros(modulus, dtype=np.int64)  # what the cheapest choice changes
    cost[0] = 0

    def made(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which offsets have a choice, and which of these the pivot can make up."""
        at = (gap + offsets) % modulus
        by = (gap + offsets - words[at]) // modulus
        return cost[at] < none, (cost[at] < none) & (by >= -take[pivot]) & (by <= counts[pivot] - take[pivot])

    others = sorted((i for i in range(len(lengths)) if i != pivot), key=lambda i: lengths[i])
    sides = ((i, sign, most) for i in others for sign, most in ((1, counts[i] - take[i]), (-1, take[i])))
    for i, n in ((i, sign * n) for i, sign, most in sides for n in _halves(min(most, modulus - 1))):
        if made(far[:1])[1][0]:
            break
        step = n * lengths[i]
        moved = np.roll(cost, step % modulus) + abs(step)
        new = np.flatnonzero(moved < np.minimum(cost, none))
        if len(new):
            words[new] = np.roll(words, step % modulus)[new] + step
            cost[new] = moved[new]
            parts.append((i, n, new))
    some, good = made(far)
    if not good.any():
        return None, not some.any()
    first = int(np.argmax(good))
    offset, out = int(far[first]), list(take)
    at = (gap + offset) % modulus
    out[pivot] += (gap + offset - int(words[at])) // modulus
    for i, n, new in reversed(parts):  # a state's cost came from the last part that changed it
        where = np.searchsorted(new, at)
        if where < len(new) and new[where] == at:
            out[i] += n
            at = (at - n * lengths[i]) % modulus
    return out, not some[:first].any()


def _nearest(lengths: list[int], counts: list[int], budget: int, slack: int) -> list[int]:
    """fit_counts for positive lengths and counts, and a budget below their sum."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if total - budget <= slack < budget:  # what is left out is the smaller sum
        return [c - n for c, n in zip(counts, _nearest(lengths, counts, total - budget, slack), strict=True)]

    def missed(take: list[int]) -> int:
        return abs(budget - sum(n * t for n, t in zip(lengths, take, strict=True)))

    fill = _fill(lengths, counts, budget, slack)
    more = _add(lengths, [c - t for c, t in zip(counts, fill, strict=True)], budget - sum(n * t for n, t in zip(lengths, fill, strict=True)))
    chosen = [t + m for t, m in zip(fill, more, strict=True)]
    unit = math.gcd(*lengths)
    if budget <= slack or missed(chosen) <= min(budget % unit, -budget % unit):
        return chosen
    sizes, goal = [n // unit for n in lengths], budget // unit
    fill = _fill(sizes, counts, goal, 0)
    gap = goal - sum(n * t for n, t in zip(sizes, fill, strict=True))
    # The length with the most documents on both sides is the likeliest to make up for the others.
    for pivot in sorted(range(len(sizes)), key=lambda i: (-min(fill[i], counts[i] - fill[i]), sizes[i])):
        span = missed(chosen) // unit + 2
        offsets = np.arange(-span, span + 1)
        apart = np.abs((goal + offsets) * unit - budget)
        far = offsets[np.argsort(apart, kind="stable")]
        far = far[np.sort(apart) < missed(chosen)]
        found, sure = _exchange(sizes, counts, fill, gap, pivot, far) if len(far) else (None, True)
        chosen = found or chosen
        if sure:
            return chosen
        if budget <= SLACK[1]:
            return _add(lengths, counts, budget)
    return chosen


def fit_counts(lengths: list[int], counts: list[int], budget: int, slack: int | None = None) -> list[int]:
    """How many documents of each length to take so that the words come to ``budget``, or as near as any choice does.

    Within the slack (from either end) the table of words holds every sum. Above it, the
    proportional fill and the documents still free make nearly every budget; where they don't,
    documents are exchanged by residues of one length after the other, until a sum is exact or sure
    to be the nearest.
    """
    own = [i for i in range(len(lengths)) if lengths[i] > 0 and counts[i] > 0]
    sizes, most = [lengths[i] for i in own], [counts[i] for i in own]
    take = [0] * len(lengths)
    if budget <= 0 or not own:
        return take
    if budget >= sum(n * c for n, c in zip(sizes, most, strict=True)):
        return [c if n > 0 else 0 for n, c in zip(lengths, counts, strict=True)]
    if slack is None:
        slack = min(SLACK[1], max(SLACK[0], SLACK_LENGTHS * max(sizes)))
    for i, n in zip(own, _nearest(sizes, most, budget, slack), strict=True):
        take[i] = n
    return take


def _fit(histogram: pd.DataFrame) -> pd.DataFrame:
    rows = histogram.sort_values("size")
    passes, size, target = 0, int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    if size:
        passes = min(CAP, int(target // size))
    budget = round(target) - passes * size if passes < CAP else 0
    extra = fit_counts(rows["size"].tolist(), rows["n"].tolist(), budget)
    return pd.DataFrame({"source": rows["source"], "size": rows["size"], "passes": passes, "extra": extra})


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, carry: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row, and the column ``carry`` as ``carried`` if one is given; taken is size times the passes over the document."""
    lot = F.xxhash64(F.lit(seed), F.col(doc_id))
    carried = [] if carry is None else [F.col(carry).alias("carried")]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), lot.alias("lot"), *carried)
    rows = materialize(rows, "mix-sizes")
    salts = max(SALTS, -(-rows.count() // SALT_ROWS))
    rows = rows.withColumn("salt", F.pmod(F.shiftright("lot", 7), F.lit(salts)))
    salted = materialize(rows.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    goal = targets(salted.select("source", (F.col("size") * F.col("n")).alias("size")), weights)
    histogram = salted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    histogram = histogram.join(goal, histogram["source"].eqNullSafe(goal["source"])).select(histogram["source"], "size", "n", "source_size", "target")
    kind = dict(rows.dtypes)["source"]
    chosen = histogram.groupBy("source").applyInPandas(_fit, f"source {kind}, size long, passes long, extra long")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = salted.withColumn("earlier", earlier).alias("s").join(chosen.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.size") == F.col("c.size")))
    plan = plan.select(F.col("s.source").alias("source"), F.col("s.size").alias("size"), "salt", "passes", (F.col("extra") - F.col("earlier")).alias("extra"))
    plan = plan.join(goal.alias("g"), plan["source"].eqNullSafe(F.col("g.source"))).select(plan["source"], "size", "salt", "passes", "extra", "source_size", "target")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("lot", "doc_id")))
    out = ranked.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size")) & (F.col("r.salt") == F.col("p.salt")))
    passes = F.col("passes") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)
    return out.select("doc_id", F.col("r.size").alias("size"), "source_size", "target", (F.col("r.size") * passes).cast("long").alias("taken"), *(["carried"] if carried else []))


MIX_COLUMNS = ("size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their columns and MIX_COLUMNS, which stand for columns of these names."""
    number = free_name(docs, "number")
    # Written once, so a row's number is the same wherever it is read.
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "mix-numbered")
    taken = mix(numbered, doc_id, text, source, weights, seed, carry=number).where("taken > 0").select(F.col("carried").alias(number), *MIX_COLUMNS)
    own = [c for c in docs.columns if c.lower() not in MIX_COLUMNS]
    return numbered.select(number, *[F.col(f"`{c}`") for c in own]).join(taken, number).drop(number)

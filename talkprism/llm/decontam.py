"""Benchmark decontamination by spaced-seed hashing.

Texts become tokens (lower-cased runs of letters and digits). A seed is the hash of the tokens
that a fixed mask selects over a span; the positions it ignores may hold other words, so a
substitution does not hide a passage. Items of WINDOW tokens or more have the seeds of MASKS at
every start. A shorter item has masks over its whole length, cut into two blocks more than it may
have substitutions, one mask for each choice of that many blocks to ignore. Either way every
window within the allowed substitutions keeps a seed.

The benchmark's seeds and the documents' meet in a Spark join. One pass reads the documents: a
bitmap of the benchmark's seeds, of bounded size, tells nearly all other seeds apart in the tasks;
what is left, with the tokens around it, is joined with the benchmark's seeds (broadcast up to
BROADCAST_SEEDS, else shuffled with the heavy seeds dealt over several tasks). Around each hit
the two are compared in place; a document overlaps an item if in some window of WINDOW tokens
(the whole item if shorter) at least SIMILARITY of the tokens agree.

Equal texts are one text throughout, by a 128-bit hash, so copies cost nothing.

Defined cases: null or empty texts, and texts without a letter or digit, overlap nothing, on
either side; very long texts are read whole; repeated items and rows are each reported; an empty
benchmark or table gives an empty result; other columns, whatever their names, are left alone;
null ids are carried as null.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkprism.llm.common import free_name, materialize, spread_join

#: Fixed masks: 1 is compared, 0 ignored. Weight 6 each; any two substitutions in 13 tokens leave a seed.
MASKS = ("111111", "11011011", "1101100011", "10101101001")
WINDOW = 13
SIMILARITY = 0.8
#: Seeds of the benchmark, some 300 bytes each, that may be broadcast.
BROADCAST_SEEDS = 200_000
#: Texts that overlap the benchmark, some 50 bytes each, that may be broadcast.
BROADCAST_TEXTS = 1_000_000
#: Bits of the bitmap, as powers of two: at least, at most (128 MB), and for each seed. A larger benchmark lets more seeds through to the join.
BITMAP = (25, 30, 7)
_CHUNK = 20
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def needed(width: int) -> int:
    """Tokens of a window that must agree."""
    return math.ceil(SIMILARITY * width)


def short_masks(length: int) -> list[tuple[int, ...]]:
    """Masks over a whole item of fewer than WINDOW tokens."""
    spare = length - needed(length)
    if not spare:
        return [tuple(range(length))]
    blocks = np.array_split(np.arange(length), spare + 2)
    return [tuple(int(p) for b in kept for p in b) for kept in itertools.combinations(blocks, 2)]


#: Every mask: the compared positions, and the length of the items it is for (0: those of WINDOW tokens or more).
ALL_MASKS = [(tuple(i for i, bit in enumerate(mask) if bit == "1"), 0) for mask in MASKS] + [(p, n) for n in range(1, WINDOW) for p in short_masks(n)]


def token_hashes(text: str | None) -> np.ndarray:
    own = tokens(text)
    return np.fromiter((xxhash.xxh64_intdigest(t) for t in own), dtype=np.uint64, count=len(own))


def _multiplier(position: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (2 * position + 1) ** 3 | 1) & 0xFFFFFFFFFFFFFFFF)


def seeds(hashes: np.ndarray, mask: int) -> np.ndarray:
    """The hash of the mask's seed at each start where its whole span, or its items' length, has room."""
    positions, length = ALL_MASKS[mask]
    count = len(hashes) - (length or positions[-1] + 1) + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(count, mask * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for p in positions:
        out += hashes[p : p + count] * _multiplier(p)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def around(hashes: np.ndarray, mask: int, start: int) -> tuple[bytes, int]:
    """The tokens that any window over the seed can reach, and how many of them lie before it."""
    positions, length = ALL_MASKS[mask]
    if length:
        return hashes[start : start + length].tobytes(), 0
    first = max(0, start - WINDOW + 1)
    return hashes[first : start + positions[-1] + WINDOW].tobytes(), start - first


_SEEDS = "item long, seed long, mask int, width int, i_around binary, i_left int"


def _item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for item, text in zip(batch["item"], batch["text"], strict=True):
            hashes = token_hashes(text)
            found = {}
            for mask, (_, length) in enumerate(ALL_MASKS):
                if length == len(hashes) or not length and len(hashes) >= WINDOW:
                    for start, seed in enumerate(seeds(hashes, mask).view(np.int64).tolist()):
                        found[(seed, mask, min(WINDOW, len(hashes)), *around(hashes, mask, start))] = True
            rows += [(item, *f) for f in found]
        yield pd.DataFrame(rows, columns=["item", "seed", "mask", "width", "i_around", "i_left"])


def bitmap(rows: DataFrame, seed: str = "seed") -> tuple[int, bytes]:
    """The power of two of its bits, and the bits: set where a seed's top bits say. Chunks of 128 KB are packed in tasks."""
    low, high, each = BITMAP
    power = min(high, max(low, max(1, rows.count()).bit_length() + each))
    at = F.shiftrightunsigned(F.col(seed), 64 - power)
    places = rows.select(F.shiftright(at, _CHUNK).alias("chunk"), at.bitwiseAND(F.lit((1 << _CHUNK) - 1)).alias("bit")).distinct()

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << _CHUNK, dtype=bool)
        bits[group["bit"].to_numpy()] = True
        return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    out = bytearray(1 << power - 3)
    for row in places.groupBy("chunk").applyInPandas(packed, "chunk long, bits binary").collect():
        out[row["chunk"] << _CHUNK - 3 : row["chunk"] + 1 << _CHUNK - 3] = row["bits"]
    return power, bytes(out)


def _passing(masks: list[int], shared):
    """Task function: the seeds of each text that the bitmap lets through, once for equal surroundings."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        power, raw = shared.value
        bits = np.frombuffer(raw, dtype=np.uint8)
        rows: list[tuple] = []
        out = lambda: pd.DataFrame(rows, columns=["text_key", "seed", "start", "d_around", "d_left"])
        for batch in batches:
            for key, text in zip(batch["text_key"], batch["text"], strict=True):
                hashes = token_hashes(text)
                for mask in masks:
                    own = seeds(hashes, mask)
                    at = own >> np.uint64(64 - power)
                    hit = np.flatnonzero(bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
                    met = set()
                    for start, seed in zip(hit.tolist(), own[hit].view(np.int64).tolist(), strict=True):
                        place = (seed, *around(hashes, mask, start))
                        if place not in met:
                            met.add(place)
                            rows.append((key, seed, start, *place[1:]))
                            if len(rows) >= 50_000:
                                yield out()
                                rows = []
        if rows:
            yield out()

    return find


@F.pandas_udf(T.StructType([T.StructField("n_equal", T.IntegerType()), T.StructField("start", T.LongType())]))
def _compared(d_around: pd.Series, d_left: pd.Series, start: pd.Series, i_around: pd.Series, i_left: pd.Series, width: pd.Series) -> pd.DataFrame:
    """The best window over a hit, laid so that the seeds meet: its equal tokens and its start in the text; 0 if no window has room."""
    out = []
    for a, left, at, b, before, n in zip(d_around, d_left, start, i_around, i_left, width, strict=True):
        back = min(left, before)
        x = np.frombuffer(a, dtype=np.uint64)[left - back :]
        y = np.frombuffer(b, dtype=np.uint64)[before - back :]
        room = min(len(x), len(y))
        if room < n:
            out.append((0, 0))
            continue
        sums = np.concatenate([[0], np.cumsum(x[:room] == y[:room])])
        sums = sums[n:] - sums[:-n]
        best = int(sums.argmax())
        out.append((int(sums[best]), at - back + best))
    return pd.DataFrame(out, columns=["n_equal", "start"])


def overlapping_texts(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(text_key, item, item_id, start, n_equal, n_compared): each different text (by its md5) and each item it overlaps, with the best window."""
    items = materialize(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), "benchmark-items")
    table = materialize(items.where(F.col("text").isNotNull()).select("item", "text").mapInPandas(_item_seeds, _SEEDS), "benchmark-seeds")
    masks = sorted(r["mask"] for r in table.select("mask").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(table))
    rows = docs.where(F.col(text).isNotNull()).select(F.md5(F.col(text).cast("binary")).alias("text_key"), F.col(text).alias("text"))
    passing = rows.mapInPandas(_passing(masks, shared), "text_key string, seed long, start long, d_around binary, d_left int")
    passing = materialize(passing.dropDuplicates(["text_key", "seed", "start"]), "passing-seeds")
    own = table.select("item", "seed", "width", "i_around", "i_left")
    if table.count() <= BROADCAST_SEEDS:
        met = passing.join(F.broadcast(own), "seed")
    else:
        met = spread_join(passing, own, ["seed"], F.xxhash64("text_key", "start"))
    hits = met.select("text_key", "item", "width", _compared("d_around", "d_left", "start", "i_around", "i_left", "width").alias("c"))
    enough = F.ceil(F.lit(SIMILARITY) * F.col("width") - 1e-9)
    best = F.max(F.struct("c.n_equal", (-F.col("c.start")).alias("back"), "width"))
    found = hits.where(F.col("c.n_equal") >= enough).groupBy("text_key", "item").agg(best.alias("b"))
    found = found.join(items.select("item", "item_id"), "item")
    return materialize(found.select("text_key", "item", "item_id", (-F.col("b.back")).alias("start"), F.col("b.n_equal").cast("long").alias("n_equal"), F.col("b.width").cast("long").alias("n_compared")), "benchmark-overlaps")


def _join_texts(rows: DataFrame, found: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` with ``found`` by the text's hash: broadcast if the overlapping texts are few, else shuffled with heavy texts dealt out."""
    if found.count() <= BROADCAST_TEXTS:
        return rows.join(F.broadcast(found), key, how)
    return spread_join(rows, found, [key], F.xxhash64(F.monotonically_increasing_id()), how)


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_equal, n_compared): each document and benchmark item that overlap, with the best window."""
    found = overlapping_texts(docs, benchmark, text, item_id, item_text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.col(text).cast("binary")).alias("text_key"))
    return _join_texts(rows, found, "text_key", "inner").select("doc_id", "item_id", "start", "n_equal", "n_compared")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, with the columns of ``docs``."""
    key = free_name(docs, "text_key")
    found = overlapping_texts(docs, benchmark, text, item_id, item_text).select(F.col("text_key").alias(key)).distinct()
    rows = docs.withColumn(key, F.md5(F.col(text).cast("binary")))
    return _join_texts(rows, found, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

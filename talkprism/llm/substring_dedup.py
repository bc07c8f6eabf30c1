"""Substring deduplication by level-wise doubling.

To find windows of W words that repeat, windows of about half the length come first: a window
can only repeat if the two halves that cover it (overlapping by a word where W is odd) do. So
W is halved down to FIRST words or fewer, and only windows whose halves are shared by several
documents are extended to the next length, until W is reached or none survives. The first level
is sampled: of the short windows inside each window of the next length, the one with the
smallest hash stands for all, which is the same in every document that holds the passage.

Documents lie in shards by a hash of doc_id; every level lists a shard's distinct window hashes
once, so a passage in a third of all documents is at most one row a shard. Rows of one hash meet
in a Spark window, which tells the shards concerned; rows grow in proportion to the text. Shards
are as many as the session's shuffle partitions, and more where that leaves over SHARD_BYTES of
text in a shard, so a task's memory doesn't grow with the table. Texts are shuffled once and that
exchange is reused by all levels. Lower levels only choose candidates, by hashes of 64 bits; at
the last level windows are equal if two independent hashes are, 96 bits in all: of 10^13 windows
in 100 TB of text a wrong pair is expected with probability 0.001.

Defined cases: a null or empty text has no words; a text shorter than the window keeps all; a
null doc_id keeps all its words and removes none elsewhere; very long texts are read whole; rows of equal doc_id, repeated rows
among them, remove nothing from each other; an empty table gives an empty result; other
columns, whatever their names, are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkprism.llm.common import shuffle_partitions, words

WINDOW = 13
FIRST = 8
#: Text in a shard, on average; a task holds one shard at a time.
SHARD_BYTES = 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def levels(window: int, first: int = FIRST) -> list[int]:
    """Window lengths from the first level to ``window``; each is at most twice the one before."""
    out = [window]
    while out[0] > first:
        out.insert(0, (out[0] + 1) // 2)
    return out


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of n words, by doubling; empty if the text is shorter."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out, length, power = hashes, 1, _BASE
    rest = [int(b) for b in bin(n)[3:]]
    with np.errstate(over="ignore"):
        for bit in rest:
            out = out[:-length] * power + out[length:]
            length, power = 2 * length, power * power
            if bit:
                out = out[:-1] * _BASE + hashes[length : length + len(out) - 1]
                length, power = length + 1, power * _BASE
        out = out ^ (out >> np.uint64(31))
        out = out * _MIX
    return out ^ (out >> np.uint64(29))


def smallest_inside(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    count = len(values) - width + 1
    out = values[: max(0, count)].copy()
    for i in range(1, width if count > 0 else 0):
        np.minimum(out, values[i : i + count], out=out)
    return out


def _word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def _other_hashes(tokens: list[bytes]) -> np.ndarray:
    """A second hash of the words, independent of the first."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def _second(tokens: list[bytes], length: int) -> np.ndarray:
    """32 bits of a second hash of each window."""
    return (window_hashes(_other_hashes(tokens), length) >> np.uint64(32)).astype(np.uint32)


def _found(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which values are in the sorted list."""
    if not len(listed):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
    return listed[at] == values


def _joined(arrays: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(arrays or [np.zeros(0, dtype=kind)])


def _entries(docs: pd.DataFrame, hashes: list[np.ndarray]) -> pd.DataFrame:
    """The shard's distinct hashes; ``place`` is twice the shard, and one more where several of its documents have the hash."""
    every = _joined(hashes)
    owner = np.repeat(docs["doc_id"].to_numpy(dtype=np.int64), [len(h) for h in hashes])
    order = np.lexsort((owner, every))
    every, owner = every[order], owner[order]
    first = np.ones(len(every), dtype=bool)
    first[1:] = every[1:] != every[:-1]
    starts = np.flatnonzero(first)
    several = owner[starts] != owner[np.append(starts[1:], len(every)) - 1] if len(starts) else np.zeros(0, dtype=bool)
    return pd.DataFrame({"hash": every[starts].view(np.int64), "place": several.astype(np.int64) + 2 * int(docs["shard"].iloc[0])})


_ENTRIES = "hash long, place long"
_WINDOWS = "hash long, other int, shard long, id long"


def _first_level(docs: pd.DataFrame, *, short: int, long: int) -> pd.DataFrame:
    """Entries of the sampled short windows."""
    docs = docs[docs["doc_id"].notna()]
    if not len(docs):
        return pd.DataFrame({"hash": [], "place": []}, dtype="int64")
    return _entries(docs, [np.unique(smallest_inside(window_hashes(_word_hashes(words(t)), short), long - short + 1)) for t in docs["text"]])


def _alive(own: np.ndarray, shared: np.ndarray, before: int, length: int, sampled: bool) -> np.ndarray:
    """The starts of the windows of ``length`` words whose halves of ``before`` words are shared."""
    halves = window_hashes(own, before)
    if sampled:
        return np.flatnonzero(_found(smallest_inside(halves, length - before + 1), shared))
    alive = _found(halves, shared)
    return np.flatnonzero(alive[: max(0, len(alive) - (length - before))] & alive[length - before :])


def _next_level(docs: pd.DataFrame, replies: pd.DataFrame, *, before: int, length: int, sampled: bool) -> pd.DataFrame:
    """Entries of the windows of ``length`` words whose halves are shared."""
    shared = np.sort(replies["hash"].to_numpy(dtype=np.int64).view(np.uint64))
    docs = docs[docs["doc_id"].notna()]
    if not len(shared) or not len(docs):
        return pd.DataFrame({"hash": [], "place": []}, dtype="int64")
    hashes = []
    for text in docs["text"]:
        own = _word_hashes(words(text))
        hashes.append(window_hashes(own, length)[_alive(own, shared, before, length, sampled)])
    return _entries(docs, hashes)


def _same(hashes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each pair, the same for equal ones, and how many there are."""
    order = np.lexsort((others, hashes))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (others[order][1:] != others[order][:-1])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(first) - 1
    return out, int(first.sum())


_LAST = np.iinfo(np.int64).max


def _last_level(docs: pd.DataFrame, replies: pd.DataFrame, *, before: int, length: int, sampled: bool) -> pd.DataFrame:
    """The shard's different windows whose halves are shared, by two hashes, with the smallest doc_id of each."""
    shared = np.sort(replies["hash"].to_numpy(dtype=np.int64).view(np.uint64))
    docs = docs[docs["doc_id"].notna()]
    hashes, others, sizes = [], [], []
    for text in docs["text"] if len(shared) else ():
        tokens = words(text)
        own = _word_hashes(tokens)
        at = _alive(own, shared, before, length, sampled)
        sizes.append(len(at))
        if len(at):
            hashes.append(window_hashes(own, length)[at])
            others.append(_second(tokens, length)[at])
    every, second = _joined(hashes), _joined(others, np.uint32)
    owner = np.repeat(docs["doc_id"].to_numpy(dtype=np.int64), sizes) if sizes else np.zeros(0, dtype=np.int64)
    number, n = _same(every, second)
    least = np.full(n, _LAST)
    np.minimum.at(least, number, owner)
    one = np.zeros(n, dtype=np.int64)
    one[number[::-1]] = np.arange(len(number))[::-1]
    order = np.argsort(one)  # in the order of the documents, whose ids then compress well
    one, least = one[order], least[order]
    shard = int(docs["shard"].iloc[0]) if len(docs) else 0
    return pd.DataFrame({"hash": every[one].view(np.int64), "other": second[one].view(np.int32), "shard": np.full(n, shard), "id": least})


def _removed(docs: pd.DataFrame, replies: pd.DataFrame, *, length: int) -> pd.DataFrame:
    """Each document without the words of its repeated windows. ``replies``: windows that a smaller doc_id of another shard has, and that id."""
    tokens = [words(t) for t in docs["text"]]
    known = docs["doc_id"].notna().tolist()
    hashes = [window_hashes(_word_hashes(ws), length) if k else np.zeros(0, dtype=np.uint64) for ws, k in zip(tokens, known, strict=True)]
    # Only hashes that the shard has twice, or an earlier document elsewhere, can remove words.
    every = np.sort(_joined(hashes))
    told = replies["hash"].to_numpy(dtype=np.int64).view(np.uint64)
    listed = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], told]))
    starts = [np.flatnonzero(_found(h, listed)) for h in hashes]
    some = [i for i, at in enumerate(starts) if len(at)]
    first = np.concatenate([told, *[hashes[i][starts[i]] for i in some]])
    second = np.concatenate([replies["other"].to_numpy(dtype=np.int32).view(np.uint32), *[_second(tokens[i], length)[starts[i]] for i in some]])
    owner = np.repeat(np.array([int(docs["doc_id"].iloc[i]) for i in some], dtype=np.int64), [len(starts[i]) for i in some])
    number, n = _same(first, second)
    least = np.full(n, _LAST)
    np.minimum.at(least, number, np.concatenate([replies["id"].to_numpy(dtype=np.int64), owner]))
    hit = least[number[len(told) :]] < owner
    cuts = np.cumsum([len(starts[i]) for i in some])
    repeated = {i: starts[i][h] for i, h in zip(some, np.split(hit, cuts[:-1]), strict=True)} if some else {}
    out = []
    for i, ws in enumerate(tokens):
        gone = np.zeros(len(ws) + 1, dtype=np.int64)
        at = repeated.get(i, np.zeros(0, dtype=np.int64))
        gone[at] += 1
        gone[at + length] -= 1
        mask = np.cumsum(gone)[: len(ws)] > 0
        kept = b" ".join(w for w, g in zip(ws, mask.tolist(), strict=True) if not g) if len(at) else b" ".join(ws)
        out.append((docs["doc_id"].iloc[i] if known[i] else None, len(ws), int(mask.sum()), kept.decode("utf-8", "surrogatepass")))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"]).astype({"doc_id": "Int64"})


def _one(f, **options):
    def call(group: pd.DataFrame) -> pd.DataFrame:
        return f(group, **options)

    return call


def _two(f, **options):
    def call(docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        return f(docs, replies, **options)

    return call


def shard_count(docs: DataFrame, text: str, shard_bytes: int) -> int:
    """Shards for the text of the table."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // shard_bytes))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row: kept has the words, joined by a space, outside windows that also start in a document of smaller doc_id."""
    shards = shard_count(docs, text, shard_bytes)
    shard = F.coalesce(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(shards)), F.lit(0)).cast("long")
    # A null doc_id would all share a shard; their texts spread them.
    shard = F.when(F.col(doc_id).isNull(), F.pmod(F.xxhash64(F.col(text)), F.lit(shards)).cast("long")).otherwise(shard)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), shard.alias("shard"))
    lengths = levels(window)
    if len(lengths) == 1:
        lengths = [window, window]
    entries = rows.groupBy("shard").applyInPandas(_one(_first_level, short=lengths[0], long=lengths[1]), _ENTRIES)
    for i, length in enumerate(lengths[1:], 1):
        same = Window.partitionBy("hash")
        met = entries.select("hash", "place", F.count(F.lit(1)).over(same).alias("n"), F.max(F.col("place").bitwiseAND(F.lit(1))).over(same).alias("several"))
        replies = met.where((F.col("n") > 1) | (F.col("several") > 0)).select(F.shiftright("place", 1).alias("shard"), "hash")
        last = i == len(lengths) - 1
        step = _two(_last_level if last else _next_level, before=lengths[i - 1], length=length, sampled=i == 1)
        entries = rows.groupBy("shard").cogroup(replies.groupBy("shard")).applyInPandas(step, _WINDOWS if last else _ENTRIES)
    least = F.min("id").over(Window.partitionBy("hash", "other"))
    replies = entries.withColumn("least", least).where("least < id").select("shard", "hash", "other", F.col("least").alias("id"))
    return rows.groupBy("shard").cogroup(replies.groupBy("shard")).applyInPandas(_two(_removed, length=window), "doc_id long, n_words long, n_removed long, kept string")

"""Prefix trie of rebuilt conversations by smallest-member ownership.

A node is a distinct sequence of first turns; the conversations that start with it are its
members, and the smallest of them owns it. A conversation that owns a node owns all deeper nodes
of its path, so each conversation owns a suffix of its path. Windows over the members of a node
mark the owner's row, and whether it is a leaf. Every other count follows from one aggregation by
prefix: over a node's members, the tokens from this depth on less those of owned nodes are what
sharing saves in the subtree, and the owned leaves are its leaves.

A turn is 128 bits of hash; a prefix is the exclusive or of its turns' hashes with their depths,
a running value, so no conversation is walked turn by turn. Running values are taken in blocks of
BLOCK turns and carried over by block, and a node's members are windowed by salt before their
first rows meet, so neither a conversation nor a node that holds a third of the rows fills one
task. A list of members' ids is joined in chunks of CHUNK by order, and hashed as a stream of
chunks: one task reads all chunks of a node, as its digest is one chain, but holds a batch at a
time.

Defined cases: a null turn comes first; turns of a conversation with equal numbers stand in the
order of their hashes; a null role or text is an empty one, so is a turn of both; very long texts
are hashed whole; repeated rows are turns of their own; rows without a conv_id belong to no
conversation and are left out; an empty table gives an empty result; other columns, whatever
their names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkprism.llm.common import lookup, materialize, shuffle_partitions
from talkprism.llm.ordering import placed, ranked

#: Conversations that share the opening of the first of them, and turns that it may have at most.
FAMILY, OPENING = 5, 8
BLOCK = 4096
CHUNK = 512
NODE = ("depth", "k1", "k2")


def turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, n, h1, h2, bytes) of every turn, and ``lead`` and ``head``: the turns that its conversation takes from another, and those of its own that these replace."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    own = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.xxhash64(F.lit(1), *said).alias("h1"),
        F.xxhash64(F.lit(2), *said).alias("h2"),
        F.octet_length(said[1]).cast("long").alias("bytes"),
    )
    return ranked(materialize(own, "turns"), "conv_id", [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")], attach=_openings).drop("turn")


def _openings(groups: DataFrame) -> DataFrame:
    """(conv_id, n, head, lead) of every conversation."""
    base = groups.select(F.col("conv_id").alias("base"), F.col("n").alias("base_turns"))
    own = groups.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("head", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (OPENING + 1))
    return own.join(base, "base", "left").select("conv_id", "n", "head", F.least("head", F.coalesce("base_turns", F.lit(0))).alias("lead"))


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, total, depth, q1, q2, bytes): the turns of every rebuilt conversation by depth, and a row of depth 0 for each."""
    convs = own.groupBy("conv_id").agg(F.any_value("head").alias("head"), F.any_value("lead").alias("lead"), F.any_value("n").alias("n"))
    convs = materialize(convs.withColumn("total", F.col("lead") + F.greatest(F.lit(0), F.col("n") - F.col("head"))), "conversations")
    rest = own.where("place >= head").select("conv_id", (F.col("lead") + F.col("n") - F.col("head")).alias("total"), (F.col("lead") + F.col("place") - F.col("head") + 1).alias("depth"), "h1", "h2", "bytes")
    near = F.filter(F.transform(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1)), lambda k: F.try_add(F.col("base"), k)), lambda c: c - c % FAMILY == F.col("base"))
    opening = own.where(F.col("place") < OPENING).withColumnRenamed("conv_id", "base").select("place", "h1", "h2", "bytes", F.explode(near).alias("conv_id"))
    taken = opening.join(convs, "conv_id").where("place < head").select("conv_id", "total", (F.col("place") + 1).alias("depth"), "h1", "h2", "bytes")
    said = rest.unionByName(taken)
    q = lambda h: F.xxhash64("depth", h)
    said = said.select("conv_id", "total", "depth", q("h1").alias("q1"), q("h2").alias("q2"), "bytes")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", "total", zero.alias("depth"), zero.alias("q1"), zero.alias("q2"), zero.alias("bytes"))
    return materialize(said.unionByName(roots), "occurrences")


def running(rows: DataFrame, columns: dict[str, str], fold: Callable[[str], Column], both: Callable[[Column, Column], Column], down: bool = True) -> DataFrame:
    """``rows`` with running values of ``columns`` (new name: column) along the depth of a conversation, its own row included; from the deepest up if not ``down``. ``rows`` come from a table, as they are read twice."""
    rows = rows.withColumn("block", F.expr(f"depth div {BLOCK}"))
    way = lambda c: F.col(c).asc() if down else F.col(c).desc()
    sums = rows.groupBy("conv_id", "block").agg(*[fold(c).alias(f"all_{name}") for name, c in columns.items()])
    before = Window.partitionBy("conv_id").orderBy(way("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv_id", "block", *[fold(f"all_{name}").over(before).alias(f"carry_{name}") for name in columns])
    carried = carried.where(" or ".join(f"carry_{name} is not null" for name in columns))  # of conversations of several blocks
    inside = Window.partitionBy("conv_id", "block").orderBy(way("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", *[fold(c).over(inside).alias(f"in_{name}") for name, c in columns.items()]).join(carried, ["conv_id", "block"], "left")
    out = [both(F.col(f"in_{name}"), F.coalesce(f"carry_{name}", F.lit(0))).alias(name) for name in columns]
    return rows.select("*", *out).drop("block", *[f"{p}_{name}" for p in ("in", "carry") for name in columns])


def owned(rows: DataFrame) -> DataFrame:
    """Occurrences with ``owner`` (the row's conversation is its node's smallest member) and ``leaf`` (it is, and no member goes on)."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(max(16, shuffle_partitions(rows.sparkSession)))))
    few = Window.partitionBy(*NODE, "salt")
    marked = salted.withColumn("least", F.min("conv_id").over(few)).withColumn("on", F.max(F.col("depth") < F.col("total")).over(few)).drop("salt")
    marked = materialize(marked, "smallest-by-salt")
    one = Window.partitionBy(*NODE)
    firsts = marked.where("conv_id = least").withColumn("owner", F.min("conv_id").over(one) == F.col("conv_id")).withColumn("on", F.max("on").over(one))
    firsts = firsts.withColumn("leaf", F.col("owner") & ~F.col("on"))
    others = marked.where("conv_id <> least").withColumns({"owner": F.lit(False), "leaf": F.lit(False)})
    return firsts.unionByName(others).drop("least", "on")


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's chunks, which come in order, joined by commas."""
    node, chain, done = None, None, []
    for batch in batches:
        for *key, ids in zip(*[batch[c].tolist() for c in (*NODE, "ids")], strict=True):
            if key == node:
                chain.update(b",")
            else:
                if node:
                    done.append((*node, chain.hexdigest()))
                node, chain = key, hashlib.sha256()
            chain.update(ids.encode())
        yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
        done = []
    if node:
        yield pd.DataFrame([(*node, chain.hexdigest())], columns=[*NODE, "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of every node at which conversations end."""
    table = placed(rows.where("depth = total").select(*NODE, "conv_id"), [*NODE, "conv_id"])
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    # Chunks follow the partitions of the sorted table and places in them, so they are in order and of at most CHUNK ids.
    chunks = table.groupBy(*NODE, F.expr(f"at div {CHUNK}").alias("chunk")).agg(ids.alias("ids"))
    chunks = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return chunks.mapInPandas(_chains, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    said = rebuilt(materialize(turns(rows, conv_id, turn, role, text), "turns-in-order"))
    path = running(said, {"k1": "q1", "k2": "q2"}, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    path = materialize(path.select("conv_id", "total", *NODE, F.col("k1").bitwiseXOR(F.col("q1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("q2")).alias("p2"), "bytes"), "paths")
    marked = owned(path).withColumns({"extra": F.when(F.col("owner"), F.lit(0)).otherwise(F.col("bytes")), "leaves": F.col("leaf").cast("long")})
    marked = materialize(marked.drop("owner", "leaf"), "owned")
    below = running(marked, {"saved": "extra", "ended": "leaves"}, F.sum, lambda a, b: a + b, down=False)
    nodes = below.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("ended").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.any_value("p1").alias("p1"), F.any_value("p2").alias("p2"))
    nodes = materialize(nodes, "nodes")
    up = (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.struct(*NODE).alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    own = [c for c in nodes.columns if c not in ("p1", "p2")]
    deep = lookup(nodes.where("depth > 0").withColumn("parent", F.struct(*up)), parents, "parent").select(*own, "parent_conv_id")
    every = deep.unionByName(nodes.where("depth = 0").select(*own, F.lit(None).cast("long").alias("parent_conv_id")))
    every = every.join(children, [*NODE], "left").join(ends(path), [*NODE], "left")
    none = F.sha2(F.lit(""), 256)
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))

"""Merkle manifest of a dataset with coordinate lookup proofs.

Every row is a leaf, every group (a source) a tree over its leaves in order, and the groups' roots
are the leaves of one more tree, whose root stands for the dataset. A node has up to FAN children:
consecutive ones, while more than one remains.

The node table is built STEP levels at a time from FAN ** STEP neighbours in a group. A proof
comes from coordinates: index and group size say which siblings a leaf needs in the next STEP
levels; these coordinates are exploded, joined with the node table, put in order and
concatenated. What lies above is the proof of the leaf's ancestor STEP levels up, found in the
same way once for all leaves below it. So every join has at most FAN ** STEP rows to a key, and
no node near a root is asked for by all leaves. Folding a leaf along its path gives a root.

Defined cases: a null is written as ``-``, so it differs from an empty text; very long texts are
hashed whole; rows of a group with equal keys stand in the order of their leaves, and rows alike
in both give the same nodes in either order; null keys come first; a null group is a group of its
own, the first; a group of one row has its leaf as root, and one group's root is that of the
dataset; an empty table gives an empty result; other columns, whatever their names, are left
alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkprism.llm.common import materialize
from talkprism.llm.ordering import ranked

FAN = 3
STEP = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: n and height are those of the tree.
NODE = ("tree", "n", "height", "level", "place", "hash")
_PATH = "array<struct<before:string,after:string>>"


@dataclass(frozen=True)
class Manifest:
    """``leaves``: key, tree, place, hash and carried columns of every row; ``nodes``: tables of NODE, the leaves and then STEP levels each; ``groups``: (place, leaf_tree) of the trees in the tree of groups; ``above``: its nodes."""

    leaves: DataFrame
    nodes: list[DataFrame]
    groups: DataFrame
    above: list[DataFrame]


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(columns: list[Column]) -> Column:
    """The hash of a row's values, each with its length in bytes."""
    one = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return digest(F.concat(*[one(c.cast("string")) for c in columns]))


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.size(F.filter(F.array(*[F.lit(FAN**k) for k in range(39)]), lambda p: p < n))


def _parents(run: str) -> Column:
    """The hashes one level above a run of hashes that starts at a first child."""
    firsts = F.sequence(F.lit(0), F.expr(f"int((size({run}) - 1) div {FAN})"))
    return F.transform(firsts, lambda i: digest(F.array_join(F.slice(run, i * FAN + 1, FAN), "")))


def _as_nodes(run: str, level: int, width: int) -> Column:
    """A run of hashes as nodes of ``level``; a group has at most ``width`` of them."""
    return F.transform(run, lambda h, i: F.struct(F.lit(level).alias("level"), (F.col("group") * width + i).alias("place"), h.alias("hash")))


def node_tables(leaves: DataFrame) -> list[DataFrame]:
    """Tables of NODE: the leaves, then STEP levels each."""
    tables = [leaves.withColumn("level", F.lit(0)).select(*NODE)]
    highest = leaves.agg(F.max("height")).first()[0] or 0
    for level in range(0, highest, STEP):
        base = tables[-1].where((F.col("level") == level) & (F.col("height") > level))
        rows = base.groupBy("tree", "n", "height", F.expr(f"place div {FAN**STEP}").alias("group")).agg(F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("run"))
        rows = rows.select("tree", "n", "height", "group", F.transform("run", lambda x: x["hash"]).alias("run0"))
        for k in range(STEP):
            rows = rows.withColumn(f"run{k + 1}", _parents(f"run{k}"))
        nodes = F.concat(*[_as_nodes(f"run{k}", level + k, FAN ** (STEP - k)) for k in range(1, STEP + 1)])
        found = rows.select("tree", "n", "height", F.explode(nodes).alias("node")).select("tree", "n", "height", "node.*")
        tables.append(materialize(found.where(F.col("level") <= F.col("height")), f"nodes-{level}"))
    return tables


def tops(tables: list[DataFrame]) -> DataFrame:
    """(tree, hash): each tree's root."""
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    return rows.where(F.col("level") == F.col("height")).select("tree", "hash")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", key: str = "doc_id", carry: dict[str, Column] | None = None) -> Manifest:
    """Leaves in order, and all nodes above them. ``carry``: more columns of the leaves, by expressions over ``docs``."""
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("."), F.col(group).cast("string")))
    own = [c.alias(name) for name, c in (carry or {}).items()]
    rows = docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf([F.col(c) for c in columns]).alias("hash"), *own)
    rows = ranked(materialize(rows, "leaves"), "tree", [F.col("key").asc_nulls_first(), F.col("hash")])
    leaves = materialize(rows.withColumn("height", height(F.col("n"))), "leaves-in-order")
    nodes = node_tables(leaves)
    subroots = materialize(tops(nodes), "subroots").withColumn("all", F.lit(""))
    above = ranked(subroots, "all", [F.col("tree")]).select(F.col("all").alias("tree"), F.col("tree").alias("leaf_tree"), "n", height(F.col("n")).alias("height"), "place", "hash")
    above = materialize(above, "subroots-in-order")
    return Manifest(leaves, nodes, above.select("place", "leaf_tree"), node_tables(above))


def _up(k: int) -> Column:
    """The place of a node's ancestor k levels above."""
    return F.expr(f"place div {FAN**k}")


def _wanted(level: int, k: int) -> Column:
    """Coordinates of the siblings, k levels above, of a node of ``level``; none above the tree's root."""
    run, last = _up(k) - _up(k) % FAN, F.expr(f"(n - 1) div {FAN ** (level + k)}")
    places = F.filter(F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda i: run + i), lambda p: (p <= last) & (p != _up(k)))
    return F.when(F.col("height") > level + k, F.transform(places, lambda p: F.struct(F.lit(level + k).alias("level"), p.alias("at")))).otherwise(F.array().cast("array<struct<level:int,at:bigint>>"))


def _step(level: int, k: int) -> Column:
    """The siblings of that level that were found, as texts before and after the node."""
    own = F.filter("found", lambda x: x["level"] == level + k)
    text = lambda run: F.array_join(F.transform(run, lambda x: x["hash"]), "")
    return F.struct(text(F.filter(own, lambda x: x["at"] < _up(k))).alias("before"), text(F.filter(own, lambda x: x["at"] > _up(k))).alias("after"))


def _segments(nodes: DataFrame, level: int) -> DataFrame:
    """(tree, n, height, place, hash, path): the siblings in the next STEP levels of every node of ``level``, looked up by coordinates in ``nodes``, which has these levels. A node's own coordinate is looked up as well, for its hash."""
    starts = nodes.where((F.col("level") == level) & ((F.col("height") > level) | (F.lit(level) == 0)))
    itself = F.array(F.struct(F.lit(level).alias("level"), F.col("place").alias("at")))
    wants = starts.select("tree", "n", "height", "place", F.explode(F.concat(itself, *[_wanted(level, k) for k in range(STEP)])).alias("want"))
    table = nodes.select("tree", "level", F.col("place").alias("at"), "hash")
    found = wants.select("tree", "n", "height", "place", "want.level", "want.at").join(table, ["tree", "level", "at"])
    found = found.groupBy("tree", "n", "height", "place").agg(F.sort_array(F.collect_list(F.struct("level", "at", "hash"))).alias("found"))
    levels = F.least(F.lit(STEP), F.greatest(F.lit(0), F.col("height") - level))
    own = F.filter("found", lambda x: (x["level"] == level) & (x["at"] == F.col("place")))[0]["hash"]
    path = F.slice(F.array(*[_step(level, k) for k in range(STEP)]), F.lit(1), levels).cast(_PATH)
    return found.select("tree", "n", "height", "place", own.alias("hash"), path.alias("path"))


def paths(nodes: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, place, hash, path) of every leaf, and the other columns of ``above``: the path goes up its tree and then along that of ``above`` (tree, path), one row a tree."""
    more = [c for c in above.columns if c not in ("tree", "path")]
    rest = above.withColumnRenamed("path", "rest")
    rounds = max(1, len(nodes) - 1)
    up = None
    for j in reversed(range(rounds)):
        level = j * STEP
        around = nodes[j].where(F.col("level") == level).select(*NODE)
        if j + 1 < len(nodes):
            around = around.unionByName(nodes[j + 1].where(F.col("level") < level + STEP))
        rows = _segments(around, level)
        ends = (F.col("height") <= level + STEP) if up is not None else F.lit(True)
        full = lambda df: df.select("tree", "place", "hash", F.concat("path", "rest").alias("path"), *more)
        out = full(rows.where(ends).join(rest, "tree"))
        if up is not None:
            higher = up.select("tree", F.col("place").alias("ancestor"), F.col("path").alias("rest"), *more)
            below = rows.where(~ends).withColumn("ancestor", F.expr(f"place div {FAN**STEP}"))
            out = out.unionByName(full(below.join(higher, ["tree", "ancestor"])))
        up = materialize(out, f"paths-{level}") if j else out
    return up


def fold(path: Column, start: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda acc, step: digest(F.concat(step["before"], acc, step["after"])))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def proofs(found: Manifest) -> DataFrame:
    """Every leaf with its columns, ``subroot``, ``root`` and the ``path`` from the one to the other."""
    root = tops(found.above).select("tree", F.col("hash").alias("root"), F.array().cast(_PATH).alias("path"))
    above = paths(found.above, root).join(found.groups, "place")
    above = materialize(above.select(F.col("leaf_tree").alias("tree"), "path", F.col("hash").alias("subroot"), "root"), "source-paths")
    return found.leaves.join(paths(found.nodes, above).drop("hash"), ["tree", "place"])


def changed(text: Column, key: Column) -> Column:
    """Leaves that the audit tampers with: those of an even CRC-32 of their key, and only where there is a line break to delete."""
    return (F.crc32(key.cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))


def audit(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document, the proofs checked on texts some of which have lost their line breaks."""
    bare = [F.col(c) if c != "text" else F.replace("text", F.lit("\n"), F.lit("")) for c in COLUMNS]
    found = proofs(manifest(docs, carry={"tampered": F.when(changed(F.col("text"), F.col("doc_id")), leaf(bare))}))
    folded = found.withColumn("folded_root", fold(F.col("path"), F.coalesce("tampered", "hash")))
    return folded.select(F.col("key").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

"""Publication of the index: generations of catalog tables and one view that names the current one.

A refresh writes the tables of a new generation with ``saveAsTable`` and then replaces the view
``current``, one statement of the session's catalog, if it still names the generation that the
refresh started from. A reader takes the generation's name once, so it sees one snapshot. Nothing
is published from an incomplete scan; nothing is read where no file has changed; and nothing if
the digest of all rows is unchanged. The catalog (a metastore on a cluster) decides between
writers in the same moment: the last view stands, and each generation is whole.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkprism.errors import CollectionUnavailable, FragileReferenceStale
from talkprism.plans import model
from talkprism.sources.jsonl import Root, Scan, discover, scan

TABLES = ("sessions", "subagents", "outputs", "segments", "blocks")


@dataclass(frozen=True)
class Snapshot:
    generation: str
    digest: str
    tables: dict[str, DataFrame]


@dataclass(frozen=True)
class Pointer:
    """What the view says: the generation, the digests of its rows and of the files read, and the generations kept."""

    generation: str
    digest: str
    files: str
    kept: tuple[str, ...]


class Store:
    """The index in the catalog's database ``name``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")

    def _table(self, generation: str, table: str) -> str:
        return f"`{self.name}`.`{generation}_{table}`"

    def pointer(self) -> Pointer | None:
        if not self.spark.catalog.tableExists(f"`{self.name}`.`current`"):
            return None
        row = self.spark.table(f"`{self.name}`.`current`").first()
        return Pointer(row["generation"], row["digest"], row["files"], tuple(row["kept"].split(",")))

    def point(self, value: Pointer, expected: Pointer | None) -> None:
        """Name ``value`` as current, unless another writer has published since ``expected`` was read."""
        if self.pointer() != expected:
            raise FragileReferenceStale("another writer has published")
        self.spark.sql(f"CREATE OR REPLACE VIEW `{self.name}`.`current` AS SELECT '{value.generation}' AS generation, '{value.digest}' AS digest, '{value.files}' AS files, '{','.join(value.kept)}' AS kept")

    def snapshot(self) -> Snapshot:
        now = self.pointer()
        if now is None:
            raise CollectionUnavailable("nothing is published")
        return Snapshot(now.generation, now.digest, {t: self.spark.table(self._table(now.generation, t)) for t in TABLES})

    def drop(self, generation: str) -> None:
        for table in ("records", *TABLES):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(generation, table)}")

    def clean(self, hours: float = 24) -> list[str]:
        """Drop the generations that no pointer keeps, left by writers that failed; those begun less than ``hours`` ago may belong to one at work. Returns their names."""
        now = self.pointer()
        found = {t.name.rsplit("_", 1)[0] for t in self.spark.catalog.listTables(self.name) if t.name.startswith("gen")}
        begun = {g: int(m[1]) if (m := re.match(r"gen(\d{13})x", g)) else 0 for g in found - set(now.kept if now else ())}
        gone = sorted(g for g, at in begun.items() if at <= (time.time() - hours * 3600) * 1000)
        for generation in gone:
            self.drop(generation)
        return gone

    def publish(self, records: DataFrame, keep: int = 2, files: str = "") -> Snapshot:
        before = self.pointer()
        generation = f"gen{int(time.time() * 1000):013d}x{uuid.uuid4().hex}"
        # Lines are parsed and keyed once; the tables are made from what was written.
        model.unique(model.keyed(records)).write.partitionBy("source").saveAsTable(self._table(generation, "records"))
        rows = self.spark.table(self._table(generation, "records"))
        # File states are part of an output's reference, so a touched file changes the digest.
        found = model.digest(rows, "output_reference").first()["digest"]
        if before and before.digest == found:
            self.drop(generation)
            return self.snapshot()
        outs = model.outputs(rows)
        tables = {"sessions": model.sessions(rows), "subagents": model.subagents(rows), "outputs": outs, "segments": model.segments(outs).drop("text"), "blocks": model.blocks(rows)}
        for name, table in tables.items():
            writer = table.write
            (writer.partitionBy("source") if name in ("outputs", "blocks") else writer).saveAsTable(self._table(generation, name))
        kept = (generation, *(before.kept if before else ()))
        self.point(Pointer(generation, found, files, kept[:keep]), before)
        for old in kept[keep:]:
            self.drop(old)
        return self.snapshot()

    def files_digest(self, roots: list[Root]) -> str:
        """A digest of the roots, their limits and the names, lengths and times of their files; no content is read."""
        parts = []
        for root in roots:
            state = F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modified").cast("string"))
            parts.append(f"{root}{model.digest(discover(self.spark, root).select(state.alias('state')), 'state').first()}")
        return uuid.uuid5(uuid.NAMESPACE_OID, "\n".join(parts)).hex

    def refresh(self, roots: list[Root], partial: bool = False) -> tuple[Snapshot, list[Scan]]:
        """Scan all roots and publish; an incomplete scan keeps the last complete generation unless ``partial``."""
        scans = [scan(self.spark, r) for r in roots]
        if not scans:
            raise CollectionUnavailable("no source is configured")
        files, now = self.files_digest(roots), self.pointer()
        if now and now.files == files:
            return self.snapshot(), scans
        # Completeness and publication read the same parsed lines; they spill to disk where memory is short.
        for s in scans:
            s.lines.persist()
        try:
            broken = any(not s.failures.isEmpty() or not s.truncations.isEmpty() for s in scans)
            if broken and not partial:
                return self.snapshot(), scans
            records = scans[0].records
            for s in scans[1:]:
                records = records.unionByName(s.records)
            return self.publish(records, files="" if broken else files), scans
        finally:
            for s in scans:
                s.lines.unpersist()


def changed_groups(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Tombstones: keys of ``old`` that ``new`` lacks."""
    return old.select(key).distinct().join(new.select(key).distinct(), key, "left_anti").withColumn("state", F.lit("Removed"))

"""An index of slots: every configured source has its own generations and is refreshed alone.

The tables are partitioned by slot and generation. A refresh resumes the scan of each source from
the states of its files, writes a new generation of that source's partitions (dynamic partition
overwrite, which stages each job's files apart, so sources are written at the same time) and then
names it in the view ``slots``; partitions of other sources aren't touched. A source that was scanned whole is Complete; one with failures or
caps is Incomplete: what was found is provisional beside the last complete generation; one that
can't be listed is Failed and stays as it was. Readers take the last complete generation of every
source, or with ``partial`` the newest.

Contents of new lines are read once: the parsed lines are written, counts of records and reports
are observed while their tables are written, and the other tables come from the records. The view
is one row a configured source. Two writers of one slot in the same moment are told apart by the
catalog: the last view stands, and each generation is whole.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from talkprism.errors import CollectionUnavailable, FragileReferenceStale
from talkprism.operators.store import TABLES, Snapshot
from talkprism.plans import health, model, postings
from talkprism.schema import FAILURE, RECORD, RECORD_COLUMNS
from talkprism.sources.jsonl import Root, exists
from talkprism.sources.resume import CAPS, STATE_SCHEMA, UNSEEN, Whole, merged, resume

_KEYS = ("slot", "generation")
#: Tables in buckets of a reference and sorted by another inside them: children lie in the bucket of their output, so outputs, segments and blocks join without a shuffle, and one bucket answers for a reference.
BUCKETS = 16
BUCKETED = {"outputs": ("output_reference", "output_reference"), "segments": ("output_reference", "segment_reference"), "blocks": ("output_reference", "block_reference"), "sessions": ("session_reference", "session_reference"), "subagents": ("session_reference", "subagent_reference")}
ALL_TABLES = ("records", "reports", "files", "postings", *TABLES)
#: Sources refreshed at the same time.
SOURCES = 8


@dataclass(frozen=True)
class Slot:
    """State of a source; the counts are those of its newest generation, ``parsed`` the lines that its last refresh parsed."""

    slot: str
    source: str
    source_identifier: str
    coverage: str = "Failed"
    complete: str | None = None
    provisional: str | None = None
    earlier: str | None = None
    records: int = 0
    files: int = 0
    malformed: int = 0
    unreadable: int = 0
    truncations: int = 0
    parsed: int = 0

    @property
    def newest(self) -> str | None:
        return self.provisional or self.complete

    @property
    def named(self) -> set[str]:
        return {g for g in (self.complete, self.provisional, self.earlier) if g}


_COLUMNS = ", ".join(Slot.__dataclass_fields__)


def slot_name(source: str, identifier: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{source}|{identifier}").hex


def _literal(value: str | int | None) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _observed(found: Observation, *names: str) -> dict[str, int]:
    """What was counted during a write; zeros where Spark knew the rows to be none and counted nothing."""
    try:
        return found.get
    except Py4JJavaError as e:
        if "AssertionError" not in e.java_exception.toString():
            raise
        return dict.fromkeys(names, 0)


class SlotStore:
    """The index in the catalog's database ``name``."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        """``buckets``: of the tables' references, fixed when the tables are made; a file of a generation each."""
        self.spark, self.name, self._view, self._buckets = spark, name, Lock(), buckets
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")

    def _table(self, table: str) -> str:
        return f"`{self.name}`.`{table}`"

    # --- state -------------------------------------------------------------------------------

    def slots(self) -> dict[str, Slot]:
        if not self.spark.catalog.tableExists(self._table("slots")):
            return {}
        return {r["slot"]: Slot(**r.asDict()) for r in self.spark.table(self._table("slots")).collect()}

    def _point(self, new: Slot | None, expected: Slot | None) -> None:
        """Name ``new`` as the state of its slot, unless another writer has changed that since ``expected`` was read; None takes the slot out."""
        with self._view:
            self._replace_view(new, expected)

    def _replace_view(self, new: Slot | None, expected: Slot | None) -> None:
        now = self.slots()
        name = (new or expected).slot
        if now.get(name) != expected:
            raise FragileReferenceStale("another writer has published this source")
        rows = [s for k, s in now.items() if k != name] + ([new] if new else [])
        values = ", ".join("(" + ", ".join(_literal(v) for v in asdict(s).values()) + ")" for s in rows)
        body = f"SELECT * FROM VALUES {values} AS t({_COLUMNS})" if rows else f"SELECT * FROM VALUES ({', '.join(_literal(v) for v in asdict(Slot('', '', '')).values())}) AS t({_COLUMNS}) WHERE false"
        self.spark.sql(f"CREATE OR REPLACE VIEW {self._table('slots')} AS {body}")

    def health(self) -> DataFrame:
        """State of every source, with the columns of ``health.source_health`` and ``coverage``."""
        rows = self.spark.createDataFrame([tuple(asdict(s).values()) for s in self.slots().values()], ", ".join(f"{c} {'long' if f.type == 'int' else 'string'}" for c, f in Slot.__dataclass_fields__.items()))
        graded = health.graded(rows)
        failed = F.col("coverage") == "Failed"
        return graded.withColumns({"status": F.when(failed, "Unreadable").otherwise(F.col("status")), "completeness": F.when(failed, "Failed").otherwise(F.col("completeness"))})

    # --- tables ------------------------------------------------------------------------------

    def _part(self, table: str, schema: str, slot: str, generation: str | None) -> DataFrame:
        """One generation of a slot; empty where there is none."""
        if generation is None or not self.spark.catalog.tableExists(self._table(table)):
            return self.spark.createDataFrame([], schema)
        return self.spark.table(self._table(table)).where((F.col("slot") == slot) & (F.col("generation") == generation)).drop(*_KEYS)

    def _write(self, table: str, rows: DataFrame, slot: str, generation: str) -> None:
        rows = rows.withColumns({"slot": F.lit(slot), "generation": F.lit(generation)})
        key, order = BUCKETED.get(table, (None, None))
        if not self.spark.catalog.tableExists(self._table(table)):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
            # Filters of the sorted reference let the reader pass over files and row groups.
            options = "partitionOverwriteMode 'dynamic'" + (f", `parquet.bloom.filter.enabled#{order}` 'true'" if key else "")
            layout = f"CLUSTERED BY ({key}) SORTED BY ({order}) INTO {self._buckets} BUCKETS" if key else ""
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(table)} ({columns}) USING parquet OPTIONS ({options}) PARTITIONED BY (slot, generation) {layout}")
        if key:
            rows = rows.repartition(self._buckets, key)
        columns = self.spark.table(self._table(table)).columns
        rows.select(*columns).write.mode("overwrite").insertInto(self._table(table))

    def _write_all(self, tables: dict[str, DataFrame], slot: str, generation: str) -> None:
        """Independent jobs, at the same time."""
        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(lambda item: self._write(*item, slot, generation), tables.items()))

    def _publish(self, before: Slot, found: Whole, parsed: int = 0) -> Slot:
        """A new generation of one slot; complete if nothing was reported."""
        generation, slot = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex}", before.slot
        seen, told = Observation(), Observation()
        files = Observation()
        keyed = model.keyed(found.records.select(*RECORD_COLUMNS))
        kinds = {"malformed": F.col("reason") == "Malformed", "truncations": F.col("reason").isin("LineBytes", *CAPS), "reports": F.lit(True)}
        scanned = {
            "records": keyed.observe(seen, F.count(F.lit(1)).alias("records")),
            "reports": found.reports.observe(told, *[F.count_if(c).alias(k) for k, c in kinds.items()]),
            "files": found.states.observe(files, F.count(F.lit(1)).alias("files")),
        }
        self._write_all(scanned, slot, generation)
        rows = self.spark.table(self._table("records")).where((F.col("slot") == slot) & (F.col("generation") == generation)).drop(*_KEYS)
        outs = model.outputs(rows)
        self._write_all({"sessions": model.sessions(rows), "subagents": model.subagents(rows), "outputs": outs, "segments": model.segments(outs).drop("text"), "blocks": model.blocks(rows), "postings": postings.postings(model.blocks(rows))}, slot, generation)
        counts = _observed(told, *kinds)
        whole = counts["reports"] == 0
        return replace(
            before,
            coverage="Complete" if whole else "Incomplete",
            complete=generation if whole else before.complete,
            provisional=None if whole else generation,
            earlier=before.newest,
            records=_observed(seen, "records")["records"],
            files=_observed(files, "files")["files"],
            malformed=counts["malformed"],
            unreadable=counts["reports"] - counts["malformed"] - counts["truncations"],
            truncations=counts["truncations"],
            parsed=parsed,
        )

    # --- refresh ------------------------------------------------------------------------------

    def refresh(self, roots: list[Root]) -> list[Slot]:
        """Resume the scan of every root; sources that are no longer configured leave the index."""
        if not roots:
            raise CollectionUnavailable("no source is configured")
        wanted = {slot_name(r.source, r.identifier) for r in roots}
        for name, slot in self.slots().items():
            if name not in wanted:
                self._point(None, slot)
                self._drop(slot, slot.named)
        with ThreadPoolExecutor(min(SOURCES, len(roots))) as pool:
            return list(pool.map(self._refresh, roots))

    def _refresh(self, root: Root) -> Slot:
        name = slot_name(root.source, root.identifier)
        known = self.slots().get(name)
        before = known or Slot(name, root.source, root.identifier)
        base = Whole(self._part("records", RECORD, name, before.newest), self._part("reports", FAILURE, name, before.newest), self._part("files", STATE_SCHEMA, name, before.newest))
        base = Whole(base.records.select(*RECORD_COLUMNS), base.reports, base.states)
        if not exists(self.spark, root.path):
            return self._settle(replace(before, coverage="Failed", parsed=0), known)
        step = resume(self.spark, root, base.states)
        seen = not step.caps & set(UNSEEN)
        if before.newest and not step.read and not (seen and step.gone) and step.caps == self._caps(before):
            return self._settle(replace(before, coverage="Incomplete" if before.provisional else "Complete", parsed=0), known)
        staged = f"staged_{uuid.uuid4().hex}"
        try:
            lines = Observation()
            step.lines.observe(lines, F.count("line_number").alias("lines")).write.saveAsTable(self._table(staged))
            found = merged(root, base, step, self.spark.table(self._table(staged)), seen)
            return self._settle(self._publish(before, found, _observed(lines, "lines")["lines"]), known)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(staged)}")

    def _caps(self, slot: Slot) -> set[str]:
        rows = self._part("reports", FAILURE, slot.slot, slot.newest).where(F.col("reason").isin(*CAPS))
        return {r["reason"] for r in rows.select("reason").distinct().collect()}

    def _settle(self, after: Slot, known: Slot | None) -> Slot:
        self._point(after, known)
        if known:
            self._drop(after, known.named - after.named)
        return after

    def replace(self, records: DataFrame, source: str, identifier: str) -> Slot:
        """``records`` of one source as its new complete generation; other sources' partitions stay."""
        name = slot_name(source, identifier)
        known = self.slots().get(name)
        own = records.where((F.col("source") == source) & (F.col("source_identifier") == identifier))
        empty = lambda schema: self.spark.createDataFrame([], schema)
        return self._settle(self._publish(known or Slot(name, source, identifier), Whole(own, empty(FAILURE), empty(STATE_SCHEMA))), known)

    def _drop(self, slot: Slot, generations: set[str]) -> None:
        for table in ALL_TABLES:
            for generation in generations:
                if self.spark.catalog.tableExists(self._table(table)):
                    self.spark.sql(f"ALTER TABLE {self._table(table)} DROP IF EXISTS PARTITION (slot = '{slot.slot}', generation = '{generation}')")

    def clean(self, hours: float = 24) -> list[str]:
        """Drop the generations that no slot names, left by writers that failed; those younger than ``hours`` may belong to one at work. Returns their names."""
        named = {g for s in self.slots().values() for g in s.named}
        oldest, gone = f"{int((time.time() - hours * 3600) * 1000):013d}", set()
        for table in ALL_TABLES:
            if self.spark.catalog.tableExists(self._table(table)):
                for row in self.spark.sql(f"SHOW PARTITIONS {self._table(table)}").collect():
                    slot, generation = (part.split("=", 1)[1] for part in row[0].split("/"))
                    if generation not in named and generation < oldest:
                        self._drop(Slot(slot, "", ""), {generation})
                        gone.add(generation)
        return sorted(gone)

    # --- reading ------------------------------------------------------------------------------

    def snapshot(self, partial: bool = False) -> Snapshot:
        """The tables of every source's last complete generation, or with ``partial`` of its newest; partitions are chosen when the plan is made."""
        chosen = {k: s.newest if partial else s.complete for k, s in self.slots().items()}
        chosen = {k: g for k, g in chosen.items() if g}
        if not chosen:
            raise CollectionUnavailable("nothing is published")
        pairs = " OR ".join(f"(slot = '{k}' AND generation = '{g}')" for k, g in sorted(chosen.items()))
        state = uuid.uuid5(uuid.NAMESPACE_OID, pairs).hex
        tables = {t: self.spark.table(self._table(t)).where(pairs).drop(*_KEYS) for t in ALL_TABLES}
        return Snapshot(state, state, tables)

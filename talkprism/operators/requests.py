"""The requests: listings, searches, estimates, reads, health and inventory over one snapshot.

Listings and searches are lazy plans; only a page's rows reach the driver. Checks come in the
same order for every request: limits, query shape, references, window.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from talkprism.errors import FragileReferenceBroken, FragileReferenceStale, InvalidRange, Missing, Oversized
from talkprism.functions import text as tx
from talkprism.functions import textquery
from talkprism.functions.timestamps import Clock
from talkprism.operators import backing
from talkprism.operators.config import VERSION, InterfaceLimits
from talkprism.plans import health, paging, postings
from talkprism.plans.filters import Filter
from talkprism.sources.jsonl import Root


@dataclass(frozen=True)
class PageRequest:
    limit: int
    order: str = "OldestFirst"
    cursor: str | None = None


@dataclass(frozen=True)
class Index:
    """A snapshot's tables with limits and a clock. With ``roots``, reads are checked against the lines of the backing files as they are now, and session cards tell whether their files are there."""

    tables: dict[str, DataFrame]
    limits: InterfaceLimits = field(default_factory=InterfaceLimits)
    clock: Clock = field(default_factory=lambda: Clock(dt.datetime.now(dt.timezone.utc)))
    snapshot: str = "snapshot"
    roots: tuple[Root, ...] = ()

    @classmethod
    def of(cls, snapshot, limits: InterfaceLimits, clock: Clock, roots: tuple[Root, ...] = ()) -> Index:
        """The index of a published snapshot (``store.Snapshot``); its digest binds the cursors."""
        return cls(snapshot.tables, limits, clock, snapshot.digest, roots)

    def version(self) -> str:
        return f"talkprism {VERSION}"

    # --- plans ---------------------------------------------------------------------------

    def sessions(self, wanted: Filter = Filter()) -> DataFrame:
        rows = self.tables["sessions"].withColumn("observed", F.coalesce("last_observed_at", "started_at"))
        if self.roots:
            rows = backing.with_lifecycle(rows, backing.listed(rows.sparkSession, list(self.roots)))
        return self._filtered(rows, wanted, "observed")

    def subagents(self, wanted: Filter = Filter()) -> DataFrame:
        rows = self.tables["subagents"].withColumn("observed", F.coalesce("last_observed_at", "first_observed_at"))
        return self._filtered(rows, wanted, "observed")

    def outputs(self, wanted: Filter = Filter(), preview: int | None = None) -> DataFrame:
        return self._previewed(self._filtered(self.tables["outputs"], wanted, "produced_at"), preview)

    def segments(self, output: str, preview: int | None = None) -> DataFrame:
        rows = self.tables["segments"].where(F.col("output_reference") == output)
        if "text" not in rows.columns:
            rows = rows.join(self.tables["outputs"].where(F.col("output_reference") == output).select("output_reference", "text"), "output_reference")
        return self._previewed(rows, preview)

    def blocks(self, wanted: Filter = Filter(), preview: int | None = None) -> DataFrame:
        return self._previewed(self._filtered(self.tables["blocks"], wanted, "timestamp"), preview)

    def search(self, query: textquery.Query, wanted: Filter = Filter(), preview: int | None = None) -> DataFrame:
        """Readable blocks that match, with evidence: by the search index where the snapshot has one, else by their texts."""
        textquery.check(query)
        if "postings" in self.tables:
            rows = self._filtered(self.tables["blocks"], wanted, "timestamp")
            return self._previewed(postings.search(self.tables["postings"], rows, query), preview)
        rows = self._filtered(self.tables["blocks"], wanted, "timestamp").where(F.col("availability") == "ReadableText")
        rows = rows.where(textquery.bind(tx.tokens("text"), query.matches))
        return self._previewed(rows.withColumn("evidence", textquery.bind(tx.tokens("text"), lambda t: textquery.evidence(query, t))), preview)

    def _filtered(self, rows: DataFrame, wanted: Filter, time: str) -> DataFrame:
        return replace(wanted, window=self.clock.lower(wanted.window)).apply(rows, time)

    @staticmethod
    def _previewed(rows: DataFrame, preview: int | None) -> DataFrame:
        """Without a preview no text is read; with one, a prefix and whether it is cut."""
        if preview is None:
            return rows.drop("text")
        cut = F.when(F.octet_length("text") > preview, "Truncated").when(F.col("text").isNotNull(), "Complete")
        return rows.withColumn("preview", tx.utf8_prefix("text", preview)).withColumn("preview_state", cut).drop("text")

    # --- pages ---------------------------------------------------------------------------

    def list_sessions(self, wanted: Filter, page: PageRequest) -> paging.Page:
        return self._page("sessions", lambda: self.sessions(wanted), page, wanted, paging.keys(page.order, "session_reference", "observed", "modified"))

    def list_subagents(self, wanted: Filter, page: PageRequest) -> paging.Page:
        return self._page("subagents", lambda: self.subagents(self._resolved(wanted)), page, wanted, paging.keys(page.order, "subagent_reference", "observed"))

    def list_outputs(self, wanted: Filter, page: PageRequest, preview: int | None = None) -> paging.Page:
        self._check_preview(preview)
        return self._page("outputs", lambda: self.outputs(self._resolved(wanted), preview), page, (wanted, preview), paging.keys(page.order, "output_reference", "produced_at"))

    def list_segments(self, output: str, page: PageRequest, preview: int | None = None) -> paging.Page:
        self._check_preview(preview)
        sort = [paging.Key("segment_index", page.order.startswith("Newest")), paging.Key("segment_reference")]
        return self._page("segments", lambda: self.segments(self._one("outputs", output)["output_reference"], preview), page, (output, preview), sort)

    def list_blocks(self, wanted: Filter, page: PageRequest, preview: int | None = None) -> paging.Page:
        self._check_preview(preview)
        return self._page("blocks", lambda: self.blocks(self._resolved(wanted), preview), page, (wanted, preview), self._block_keys(page))

    def search_blocks(self, query: textquery.Query, wanted: Filter, page: PageRequest, preview: int | None = None) -> paging.Page:
        self._check_preview(preview)
        return self._page("search", lambda: self.search(query, self._resolved(wanted), preview), page, (query, wanted, preview), self._block_keys(page))

    @staticmethod
    def _block_keys(page: PageRequest) -> list[paging.Key]:
        return paging.keys(page.order, "block_reference", "timestamp", None, paging.BLOCK_TIES)

    def _page(self, name, plan, page: PageRequest, query, sort) -> paging.Page:
        paging.check_limit(page.limit, self.limits.page_items, "page items")
        bound = paging.signature(name, page.order, page.limit, query, self.snapshot)
        return paging.page(plan(), sort, page.limit, bound, page.cursor)

    def _check_preview(self, preview: int | None) -> None:
        if preview is not None:
            paging.check_limit(preview, self.limits.preview_bytes, "preview bytes")

    def _resolved(self, wanted: Filter) -> Filter:
        for table, reference in (("sessions", wanted.session), ("subagents", wanted.subagent), ("outputs", wanted.output)):
            if reference is not None:
                self._one(table, reference)
        return wanted

    def _one(self, table: str, reference: str) -> Row:
        found = self.tables[table].where(F.col(f"{table[:-1]}_reference") == reference).take(1)
        if not found:
            raise Missing(reference, table, reference=reference)
        return found[0]

    # --- sizes and reads ------------------------------------------------------------------

    def estimate_output(self, reference: str, byte_range: tuple[int, int] | None = None, line_range: tuple[int, int] | None = None) -> dict[str, Any]:
        """Size of an output or a range of it. Bytes are exact; the bytes of a line range are an estimate: its share of the lines."""
        row = self._one("outputs", reference)
        size, lines = F.lit(row["bytes"]), F.lit(row["lines"])
        if byte_range is not None:
            return {"bytes": self._inside(tx.byte_estimate(size, *byte_range)), "certainty": "Exact"}
        if line_range is not None:
            return {"bytes": self._inside(tx.line_estimate(size, lines, *line_range)), "lines": line_range[1] - line_range[0], "certainty": "Estimated"}
        return {"bytes": row["bytes"], "lines": row["lines"], "certainty": "Exact"}

    def _inside(self, size) -> int:
        found = self.tables["outputs"].sparkSession.range(1).select(size.alias("bytes")).first()[0]
        if found is None:
            raise InvalidRange("the range leaves the text")
        return found

    def read_output(self, reference: str, maximum: int, byte_range: tuple[int, int] | None = None, line_range: tuple[int, int] | None = None, current: DataFrame | None = None) -> dict[str, Any]:
        """Text of an output or a range, at most ``maximum`` bytes. ``current``: (path, fingerprint) of the files as they are now, or their records, whose texts are then compared too."""
        paging.check_limit(maximum, self.limits.read_bytes, "read bytes")
        row = self._one("outputs", reference)
        self._fresh(row, current)
        self._backed("outputs", row, reference)
        rows = self.tables["outputs"].where(F.col("output_reference") == reference)
        part = tx.byte_range("text", *byte_range) if byte_range else tx.line_range("text", *line_range) if line_range else F.col("text")
        return self._bounded(rows.select(part.alias("text")), maximum)

    def estimate_block(self, reference: str) -> dict[str, Any]:
        row = self._one("blocks", reference)
        return {"bytes": row["bytes"], "lines": row["lines"], "certainty": "Exact"}

    def read_block(self, reference: str, maximum: int, current: DataFrame | None = None) -> dict[str, Any]:
        paging.check_limit(maximum, self.limits.read_bytes, "read bytes")
        row = self._one("blocks", reference)
        self._fresh(row, current)
        if row["availability"] != "ReadableText":
            raise Missing("the block has no text", "ReadTranscriptBlock", reference=reference)
        self._backed("blocks", row, reference)
        return self._bounded(self.tables["blocks"].where(F.col("block_reference") == reference).select("text"), maximum)

    @staticmethod
    def _bounded(rows: DataFrame, maximum: int) -> dict[str, Any]:
        row = rows.select(tx.utf8_prefix("text", maximum).alias("text"), F.octet_length("text").alias("bytes")).first()
        if row["bytes"] is None:
            raise InvalidRange("the range is outside the text or cuts a character")
        return {"text": row["text"], "state": "Truncated" if row["bytes"] > maximum else "Complete"}

    def _backed(self, collection: str, row: Row, reference: str) -> None:
        """Stale or broken as the backing file tells now, where the roots are known."""
        if not self.roots:
            return
        batch = self.tables[collection].sparkSession.createDataFrame([(reference,)], "reference string")
        state = backing.read_many(self.tables, batch, list(self.roots), 1, collection).first()["state"]
        if state != "Fresh":
            raise (FragileReferenceStale if state == "Stale" else FragileReferenceBroken)(row["path"])

    @staticmethod
    def _fresh(row: Row, current: DataFrame | None) -> None:
        """Broken if the file or the line is gone; stale if the file's state, or the text or kind of what is read, differs."""
        if current is None:
            return
        now = current.where(F.col("path") == row["path"])
        if "line_number" in current.columns:
            now = now.where(F.col("line_number") == row["line_number"])
        content = ["fingerprint"]
        if "block_index" in row and "blocks" in current.columns:
            block = F.get("blocks", F.lit(row["block_index"]))
            content += [F.md5(block["text"].cast("binary")).alias("text_hash"), block["kind"].alias("kind")]
        elif "text" in current.columns:
            content.append(F.md5(F.col("text").cast("binary")).alias("text_hash"))
        found = now.select(*content).take(1)
        if not found:
            raise FragileReferenceBroken(row["path"])
        if any(found[0][c] != row[c] for c in found[0].__fields__ if c in row):
            raise FragileReferenceStale(row["path"])

    # --- state ------------------------------------------------------------------------------

    def observe_health(self, sources: DataFrame) -> dict[str, Any]:
        """Counts of the index, health of each source (from ``health.source_health``), overall completeness."""
        counts = {t: self.tables[t].count() for t in ("sessions", "subagents", "outputs", "blocks")}
        return {"version": self.version(), "counts": counts, "sources": sources, "completeness": health.completeness(sources).first()[0]}

    def inventory(self, sources: tuple[str, ...] | None = None, archived: DataFrame | None = None, configured: DataFrame | None = None) -> DataFrame:
        """All session cards with their archive status, by reference; above the page limit the request is oversized.

        ``configured``, from ``health.source_health``, adds the state and scan report of each card's
        source; a source that isn't configured is Unconfigured.
        """
        rows = self.sessions(Filter(sources=sources))
        if rows.limit(self.limits.page_items + 1).count() > self.limits.page_items:
            raise Oversized(f"more than {self.limits.page_items} sessions", "InventorySessions")
        if configured is not None:
            rows = health.with_source_state(rows, configured)
        return health.archive_status(rows, archived).orderBy("session_reference")

    def lookup_session(self, reference: str | None = None, producer: tuple[str, str] | None = None, locator: tuple[str, str] | None = None, archived: DataFrame | None = None) -> DataFrame:
        """Session cards by reference, by (source, producer's id) or by (source, path)."""
        rows = self.sessions()
        if reference is not None:
            rows = rows.where(F.col("session_reference") == reference)
        for pair, column in ((producer, "session_identifier"), (locator, "path")):
            if pair is not None:
                rows = rows.where((F.col("source") == pair[0]) & (F.col(column) == pair[1]))
        return health.archive_status(rows, archived).orderBy("session_reference")

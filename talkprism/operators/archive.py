"""The summary archive: an append-only Parquet table of session summaries, each record in a folder of its own, so that writers don't meet."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from talkprism.errors import Missing, Unauthorized
from talkprism.functions.text import utf8_prefix

SCHEMA = "sequence long, record_identifier string, session_reference string, source string, title string, started_at string, last_observed_at string, output_count long, summary string, provenance string, created_at string"


def record_identifier(sequence) -> F.Column:
    return F.format_string("archive-record-%016d", sequence)


#: Creation is exclusive in stores that several drivers share; writers in one driver take turns, as local file systems check and create in two steps.
_CLAIMS = Lock()


class Archive:
    """``path`` is relative to ``root`` and stays below it."""

    def __init__(self, spark: SparkSession, root: str, path: str):
        if path.startswith("/") or ":" in path or ".." in path.split("/") or not path.strip("/"):
            raise Unauthorized(f"the archive's path leaves its root: {path}", "archive")
        self.spark, self.path = spark, f"{root.rstrip('/')}/{path}"

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def _claim(self, number: int) -> bool:
        """Whether the number is ours now: its file, hidden from readers, is created only where there is none."""
        claim = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_claims/{number:016d}")
        with _CLAIMS:
            return claim.getFileSystem(self.spark._jsc.hadoopConfiguration()).createNewFile(claim)

    def write(self, session: dict, summary: str, provenance: str, created_at: str) -> str:
        """Append one record with the next free number; returns its identifier. A number is claimed before it is used, so two writers never share one; that of a writer that failed stays unused."""
        last = self.rows().agg(F.max("sequence")).first()[0]
        number = 0 if last is None else last + 1
        while not self._claim(number):
            number += 1
        names = ("session_reference", "source", "title", "started_at", "last_observed_at", "output_count")
        row = (number, f"archive-record-{number:016d}", *[session.get(n) for n in names], summary, provenance, created_at)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.parquet(f"{self.path}/{row[1]}")
        return row[1]

    def query(self, session_reference: str | None = None) -> DataFrame:
        rows = self.rows()
        if session_reference is not None:
            rows = rows.where(F.col("session_reference") == session_reference)
        return rows.orderBy("sequence")

    def read(self, identifier: str, summary_bytes: int, provenance_bytes: int) -> Row:
        """One record with bounded texts, and whether each is truncated."""
        texts = [(c, n) for c, n in (("summary", summary_bytes), ("provenance", provenance_bytes))]
        cut = [F.when(F.octet_length(c) > n, "Truncated").otherwise("Complete").alias(f"{c}_state") for c, n in texts]
        rows = self.rows().where(F.col("record_identifier") == identifier)
        found = rows.select("record_identifier", "session_reference", "created_at", *[utf8_prefix(c, n).alias(c) for c, n in texts], *cut).take(1)
        if not found:
            raise Missing(identifier, "ReadSessionArchive")
        return found[0]

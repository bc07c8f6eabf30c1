"""Exact deduplication by a tree-merge of sorted digest runs.

Every row becomes a short signature: SHA-256 of the text without white space, and its length and
XXH64 to verify that. Signatures are dealt evenly over slots, one partition each, where they
become sorted runs that hold a text once. The slots' numbers have ``rounds`` digits of base
``fan``. In each round the slots that differ in one digit exchange runs: a signature goes to the
slot whose digit is that of the signature's home, and each slot merges the ``fan`` runs that it
gets, keeping the first row of equal signatures. After the last round a text is in its home slot
alone. The answers go back the same way, from each merged run to those that it was made of, for
texts found more than once.

A slot gets at most ``fan`` rows of a text in a round, and one row for each row in a run on the
way back, so a text that makes up a third of the table makes no large group. The runs of each
round are tables in the shared folder.

Equal signatures are equal texts but for a collision of SHA-256, of the length and of XXH64 at
once; texts that agree in SHA-256 alone stay apart.

Defined cases: a null text is an empty one, equal to texts of white space only; very long texts
are hashed whole; of equal texts the one with the most code points stays, then that with the
smallest doc_id, a null one last; of rows with equal or no ids one stays; an empty table gives an
empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkprism.llm.common import free_name, materialize, shuffle_partitions

#: Runs that a slot merges in a round, at most.
FAN = 8
SIGNATURE = ("digest", "n_bytes", "verify")
_SPACE = (" ", "\t", "\n", "\v", "\f", "\r")


def normalised(text: Column) -> Column:
    """The text without its white space; null is empty."""
    return reduce(lambda rest, c: F.replace(rest, F.lit(c), F.lit("")), _SPACE, F.coalesce(text, F.lit("")))


def shape(partitions: int, fan: int = FAN) -> tuple[int, int]:
    """(fan, rounds): as few rounds as the largest fan allows, and the smallest fan for them, so that there is a slot for every partition."""
    rounds = 1
    while fan**rounds < partitions:
        rounds += 1
    least = 2
    while least**rounds < partitions:
        least += 1
    return least, rounds


def _moved(fan: int, rounds: int, turn: int) -> Column:
    """The slot whose digit ``turn`` is that of the signature's home, the others those of ``slot``."""
    size = fan**turn
    return F.expr(f"int(slot + (pmod(xxhash64(digest), {fan**rounds}) div {size} % {fan} - slot div {size} % {fan}) * {size})")


def _run(rows: DataFrame, slots: int) -> DataFrame:
    """Rows brought to their slots and merged there: each slot's signatures in order, once, with their first row and the number of rows."""
    there = rows.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", *SIGNATURE)
    return there.groupBy("slot", *SIGNATURE).agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def signatures(docs: DataFrame, doc_id: str, text: str, slots: int, carry: str | None = None) -> DataFrame:
    """(doc_id, slot, digest, n_bytes, verify, first) of every row, written once; ``first`` orders rows of equal texts."""
    row, plain = F.monotonically_increasing_id(), normalised(F.col(text))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
        F.unhex(F.sha2(plain, 256)).alias("digest"),
        F.octet_length(plain).alias("n_bytes"),
        F.xxhash64(plain).alias("verify"),
        row.alias("row"),
        *([] if carry is None else [F.col(carry).alias("carried")]),
    )
    first = F.struct((-F.col("points")).alias("fewer"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    return materialize(rows.withColumn("slot", F.pmod(F.col("row"), F.lit(slots)).cast("int")).withColumn("first", first).drop("points", "row"), "signatures")


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan: int = FAN, carry: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, and the column ``carry`` as ``carried`` if one is given."""
    fan, rounds = shape(shuffle_partitions(docs.sparkSession), fan)
    slots = fan**rounds
    rows = signatures(docs, doc_id, text, slots, carry)
    runs = [materialize(_run(rows.withColumn("n", F.lit(1).cast("long")), slots), "run-0")]
    for turn in range(rounds):
        runs.append(materialize(_run(runs[-1].withColumn("slot", _moved(fan, rounds, turn)), slots), f"run-{turn + 1}"))
    answers = runs[-1].where("n > 1")
    for turn in reversed(range(rounds)):
        below = runs[turn].select("slot", *SIGNATURE, _moved(fan, rounds, turn).alias("up"))
        answers = below.join(answers.withColumnRenamed("slot", "up"), ["up", *SIGNATURE]).drop("up")
    answers = answers.withColumnRenamed("first", "winner")
    found = rows.join(answers, ["slot", *SIGNATURE], "left")
    alone = F.col("n").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("winner.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("winner.row") == F.col("first.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *([] if carry is None else ["carried"]),
    )


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with their columns."""
    number = free_name(docs, "number")
    # Written once, so a row's number is the same wherever it is read.
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    kept = duplicates(numbered, doc_id, text, carry=number).where("kept").select(F.col("carried").alias(number))
    return numbered.join(kept, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

"""The search index: for every word of a block the places where it stands.

A search reads the rows of its words alone (the table is sorted by word, so the reader skips row
groups by their least and greatest word), gathers them by block, which gives at most a row a word
of the query, and evaluates the query on places. Texts aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkprism.functions import textquery
from talkprism.functions import text as tx

SCHEMA = "token string, block_reference string, places array<int>"


def postings(blocks: DataFrame) -> DataFrame:
    """(token, block_reference, places) of all readable blocks, in ranges of (token, block): a frequent word fills several ranges."""
    rows = blocks.where(F.col("availability") == "ReadableText").select("block_reference", F.posexplode(tx.tokens("text")).alias("place", "token"))
    rows = rows.groupBy("block_reference", "token").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return rows.repartitionByRange("token", "block_reference").sortWithinPartitions("token", "block_reference").select("token", "block_reference", "places")


def search(index: DataFrame, blocks: DataFrame, query: textquery.Query) -> DataFrame:
    """The rows of ``blocks`` that match, with evidence; ``index`` is that of their texts."""
    textquery.check(query)
    rows = index.where(F.col("token").isin(sorted(query.words())))
    at = rows.groupBy("block_reference").agg(F.map_from_entries(F.collect_list(F.struct("token", "places"))).alias("at"))
    blocks = blocks.where(F.col("availability") == "ReadableText")
    if textquery.holds_without_words(query):
        found = blocks.join(at, "block_reference", "left").withColumn("at", F.coalesce("at", F.create_map().cast("map<string,array<int>>")))
        found = found.where(query.holds(F.col("at")))
    else:
        found = blocks.join(at.where(query.holds(F.col("at"))), "block_reference")
    return found.withColumn("evidence", textquery.indexed_evidence(query, F.col("at"))).drop("at")

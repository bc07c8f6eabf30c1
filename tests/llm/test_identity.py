"""Exact dedup, the Merkle manifest and the prefix trie against their plain versions."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from talkprism.llm import exact_dedup, merkle, ordering, prefix_trie

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"
#: Columns that the operators use inside, and other spellings of them.
CLASH = ("row", "SLOT", "n", "first", "digest", "tree", "place", "hash", "at", "part", "number", "path", "depth", "k1", "salt", "owner", "key", "carried")


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASH if c.lower() not in df.columns})


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def texts():
    rng = random.Random(3)
    forms = ["a b", "ab", " a\tb\n", "a b", "", None, " \n", "é\x0b", "é", " ", "x" * 300_000, " ".join("x" * 300_000)]
    return [(rng.choice([None, *range(30)]), rng.choice(forms)) for _ in range(400)]


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_exact_duplicates(spark, fan):
    """Several rounds, ties, repeated rows, null ids and texts; of each group exactly one row stays."""
    rows = texts()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = exact_dedup.duplicates(df, fan=fan)
    want, kept = brute.exact_duplicates(rows)
    assert rows_of(got.drop("kept").select("doc_id", "keep_id", "group_size", "text_sha256")) == sorted(want, key=str)
    assert rows_of(got.where("kept").select("keep_id")) == sorted([(d,) for d, _ in kept], key=str)
    left = exact_dedup.distinct_documents(df)
    assert left.columns == df.columns
    assert rows_of(left.select("doc_id", F.coalesce(F.length("text"), F.lit(0)))) == sorted(kept, key=str)


def test_exact_duplicates_of_nothing_and_of_one_text(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(exact_dedup.duplicates(df)) == [] and rows_of(exact_dedup.distinct_documents(df)) == []
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"))
    assert exact_dedup.duplicates(many).where("keep_id = 0 and group_size = 5000 and kept = (doc_id = 0)").count() == 5000


def test_runs_are_sorted_and_hold_a_text_once_in_a_slot(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("text"))
    signed = exact_dedup.signatures(rows, "doc_id", "text", 4)
    run = exact_dedup._run(signed.withColumn("n", F.lit(1).cast("long")), 4)
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
    parts = [[(r["slot"], bytes(r["digest"])) for r in p] for p in run.rdd.glom().collect()]
    assert all(p == sorted(set(p)) and len({s for s, _ in p}) <= 1 for p in parts) and sum(map(len, parts)) == 28


@pytest.mark.parametrize("partitions,fan,want", [(1, 8, (2, 1)), (4, 8, (4, 1)), (8, 8, (8, 1)), (12, 8, (4, 2)), (211, 8, (6, 3)), (20_000, 8, (8, 5)), (7, 2, (2, 3))])
def test_shape_has_a_slot_for_every_partition(partitions, fan, want):
    assert exact_dedup.shape(partitions, fan) == want and want[0] ** want[1] >= partitions


def test_equal_digests_of_other_texts_stay_apart(spark, monkeypatch):
    """A digest of two values alone: length and hash of the text still tell texts apart."""
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.when(F.length(c) > 2, F.lit("aa" * 32)).otherwise(F.lit("bb" * 32)))
    rows = [(i, t) for i, t in enumerate(["abc", "abd", "a b c", "x", "y", "x ", "abcd"])]
    got = exact_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "keep_id")
    assert dict(rows_of(got)) == {0: 2, 1: 1, 2: 2, 3: 5, 4: 4, 5: 5, 6: 6}


def test_places_in_groups(spark):
    """One group with most rows, ties over many partitions; places are those of the sorted group."""
    rng = random.Random(1)
    rows = [(rng.choice("aaaab"), rng.randrange(50)) for _ in range(4000)]
    df = ordering.ranked(spark.createDataFrame(rows, "g string, x int").repartition(6), "g", [F.col("x")])
    got = rows_of(df.select("g", "place", "x", "n"))
    want = []
    for g in "ab":
        xs = sorted(x for h, x in rows if h == g)
        want += [(g, i, x, len(xs)) for i, x in enumerate(xs)]
    assert got == sorted(want, key=str)


def documents(n):
    return [(i % 7 if i % 5 else None, None if i % 3 == 0 else "ab"[i % 2] * (i % 4), None, i % 2, None if i % 4 == 0 else "x\ny" * (1 + (i == 9) * 200_000)) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 200])
def test_manifest_of_awkward_rows(spark, n):
    rows = documents(n)
    df = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    assert rows_of(merkle.audit(df)) == sorted(brute.merkle_audit(rows), key=str)


@pytest.mark.parametrize("sizes", [(82, 729), (1, 2, 3, 4, 9, 10, 27, 28)])
def test_manifest_of_trees_of_every_height(spark, sizes):
    rows = [(i, f"s{k}", "en", i, f"t\n{i}") for k, n in enumerate(sizes) for i in range(n)]
    assert rows_of(merkle.audit(spark.createDataFrame(rows, DOCS))) == sorted(brute.merkle_audit(rows), key=str)


def test_manifest_of_many_sources(spark):
    rows = [(i, f"s{i % 100}", None, i, "x") for i in range(130)]
    assert rows_of(merkle.audit(spark.createDataFrame(rows, DOCS))) == sorted(brute.merkle_audit(rows), key=str)


def test_manifest_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*merkle.COLUMNS).collect()]
    got = rows_of(merkle.audit(docs))
    assert got == sorted(brute.merkle_audit(rows), key=str)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_a_proof_shows_one_changed_row_and_no_other(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(60)]
    found = merkle.proofs(merkle.manifest(spark.createDataFrame(rows, DOCS)))
    other = merkle.leaf([F.col(c) for c in merkle.COLUMNS])
    now = spark.createDataFrame([(*r[:4], r[4] + "!" * (r[0] == 17)) for r in rows], DOCS).select(F.col("doc_id").alias("key"), other.alias("now"))
    bad = found.join(now, "key").where(merkle.fold(F.col("path"), F.col("now")) != F.col("root"))
    assert [r["key"] for r in bad.collect()] == [17]


CONVS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block,chunk", [(4096, 512), (3, 2)])
def test_trie_of_awkward_rows(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rng = random.Random(7)
    rows = {}
    for i in range(500):
        conv, turn = rng.choice([None, 1, 2, 3, 4, 5, 7, 8, 10, 12, 13, 10**12, 2**63 - 1, -3]), None if rng.random() < 0.05 else i
        rows[conv, turn] = (conv, turn, rng.choice([None, "user", ""]), rng.choice([None, "", "é", "xx"] + ["long " * 50_000] * (i < 2)))
    rows = list(rows.values())
    df = clashing(spark.createDataFrame(rows, CONVS).repartition(4))
    assert rows_of(prefix_trie.trie(df)) == sorted(brute.prefix_trie(rows), key=str)


def test_trie_of_equal_conversations_and_of_none(spark):
    rows = [(i, t, "u", f"same {t}") for i in range(300) for t in range(3)]
    assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, CONVS))) == sorted(brute.prefix_trie(rows), key=str)
    assert rows_of(prefix_trie.trie(spark.createDataFrame([], CONVS))) == []


def test_turns_with_equal_numbers_have_one_order(spark):
    rows = [(5, 1, r, t) for r in ("a", "b", None) for t in ("x", "y", "x")]
    one = rows_of(prefix_trie.trie(spark.createDataFrame(rows, CONVS)))
    assert one == rows_of(prefix_trie.trie(spark.createDataFrame(rows[::-1], CONVS).repartition(7)))
    assert max(r[1] for r in one) == 9


def test_turns_of_the_table(spark):
    convs = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in convs.select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(prefix_trie.trie(convs)) == sorted(brute.prefix_trie(rows), key=str)

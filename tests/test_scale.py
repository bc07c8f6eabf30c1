"""Operations whose cost must follow their input, against plain versions."""

import datetime as dt
import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from talkprism.functions import text as tx
from talkprism.functions import textquery as tq
from talkprism.functions.timestamps import Clock
from talkprism.operators.archive import Archive
from talkprism.operators.requests import Index
from talkprism.plans import collect, postings


def plain_near(words, left, right, distance):
    places = lambda w: [i for i, x in enumerate(words) if x == w]
    return [(min(i, j), max(i, j)) for i in places(left) for j in places(right) if i != j and abs(i - j) - 1 <= distance]


def near_spans(df, query):
    return df.select("id", tq.bind(tx.tokens("text"), query.matches).alias("hit"), F.transform(tq.bind(tx.tokens("text"), query.spans), lambda s: F.array(s["start"], s["end"])).alias("spans"))


@pytest.mark.parametrize("left,right", [("a", "b"), ("a", "a"), ("b", "none")])
@pytest.mark.parametrize("distance", [0, 1, 3, 10_000])
def test_near_by_counts_before_each_place(spark, left, right, distance):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (0, 1, 2, 3, 8, 20, 60)] + ["a b", "b a", "a c c c b", "a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in near_spans(df, tq.Near(left, right, distance)).collect():
        want = plain_near(texts[row["id"]].split(), left, right, distance)
        assert [tuple(s) for s in row["spans"]] == want and row["hit"] == bool(want)


def test_near_in_a_long_text(spark):
    """100,000 words, a fifth of them each of the two words: seconds, as pairs aren't tried."""
    rng = random.Random(6)
    words = [rng.choice("abcde") for _ in range(100_000)]
    df = spark.createDataFrame([(0, " ".join(words))], "id int, text string")
    began = time.time()
    row = near_spans(df, tq.Near("a", "b", 2)).first()
    assert time.time() - began < 60
    want = [(min(i, j), max(i, j)) for i, x in enumerate(words) if x == "a" for j in range(max(0, i - 3), i + 4) if j < len(words) and words[j] == "b"]
    assert row["hit"] and [tuple(s) for s in row["spans"]] == want


def plain_budget(texts, segments, total, bound):
    left, out = total, []
    for text in texts[:segments]:
        whole = text.encode()
        limit = min(bound, left)
        cut = whole if len(whole) <= limit else whole[:limit].decode(errors="ignore").encode()
        reason = None if len(cut) == len(whole) else "RequestLimit" if left < bound else "ProjectionLimit"
        out.append((cut.decode(), len(whole), reason))
        left -= len(cut)
    return out


def records(spark, texts):
    rows = [("Claude", "main", f"p{i:07d}", 1, None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "source string, source_identifier string, path string, line_number long, timestamp string, text string")


@pytest.mark.parametrize("seed", range(12))
def test_budget_is_cut_as_by_a_loop(spark, seed):
    """Characters of one to four bytes around the place where the budget ends."""
    rng = random.Random(seed)
    texts = ["".join(rng.choice("aé€😀") for _ in range(rng.randrange(5))) for _ in range(60)]
    segments, total, bound = rng.choice([5, 40, 100]), rng.randrange(1, 120), rng.choice([1, 2, 3, 7, 100])
    found = collect.bounded_texts(records(spark, texts).repartition(3), collect.Budget(segments, total, bound)).orderBy("place")
    assert [(r["excerpt"], r["bytes"], r["truncation"]) for r in found.collect()] == plain_budget(texts, segments, total, bound)


def test_budget_of_many_segments(spark):
    """100,000 segments of one source, with the budget's end in the middle."""
    texts = [("é" * (i % 7) + "😀") for i in range(100_000)]
    began = time.time()
    found = collect.bounded_texts(records(spark, texts), collect.Budget(100_000, 500_001, 9)).select("place", "excerpt", "bytes", "truncation").collect()
    assert time.time() - began < 60
    got = [(r["excerpt"], r["bytes"], r["truncation"]) for r in sorted(found)]
    assert got == plain_budget(texts, 100_000, 500_001, 9)


def test_budget_adds_no_shuffle_to_the_cap(spark):
    plan = collect.bounded_texts(records(spark, ["a"]), collect.Budget(5, 10, 5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_writers_of_the_archive_never_share_a_number(spark, tmp_path):
    archives = [Archive(spark, str(tmp_path), "summaries") for _ in range(2)]
    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda i: archives[i % 2].write({"session_reference": f"s{i}"}, "x", "y", "2025-01-01T00:00:00Z"), range(16)))
    assert len(set(found)) == 16
    assert archives[0]._claim(99) and not archives[1]._claim(99)
    assert [r["record_identifier"] for r in archives[0].query().collect()] == sorted(found)


def some_queries(rng):
    word = lambda: rng.choice("abcdx")
    leaf = lambda: rng.choice([tq.Word(word()), tq.Phrase(" ".join(word() for _ in range(rng.randrange(1, 4)))), tq.Near(word(), word(), rng.randrange(3))])
    made = [leaf() for _ in range(8)]
    for _ in range(16):
        kind = rng.choice([tq.AllOf, tq.AnyOf])
        made.append(kind(tuple(rng.choice([q, tq.Not(q)]) for q in rng.sample(made, rng.randrange(1, 4)))))
    return made


def test_searches_by_index_are_those_of_the_texts(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 2, 5, 12]))) for _ in range(80)] + ["A, b! É", None, "", "..."]
    blocks = spark.createDataFrame([(f"b{i}", t, "ReadableText" if t is not None else "Unavailable", "2025-01-01T00:00:00Z") for i, t in enumerate(texts)], "block_reference string, text string, availability string, timestamp string")
    postings.postings(blocks).write.parquet(str(tmp_path / "postings"))
    index = spark.read.parquet(str(tmp_path / "postings"))
    plain, indexed = Index({"blocks": blocks}, clock=None), Index({"blocks": blocks, "postings": index}, clock=None)
    evidence = lambda df: sorted(((r["block_reference"], [(e["term"], sorted((s["start"], s["end"]) for s in e["spans"])) for e in r["evidence"]]) for r in df.collect()), key=str)
    for q in some_queries(rng):
        if not tq.holds_without_words(q) or rng.random() < 0.5:
            found = [replace(i, clock=Clock(dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc))).search(q) for i in (plain, indexed)]
            assert evidence(found[0]) == evidence(found[1]), q


def test_a_search_by_index_reads_no_text(spark, tmp_path):
    blocks = spark.range(20_000).select(F.format_string("b%05d", "id").alias("block_reference"), F.concat_ws(" ", F.lit("common"), F.md5(F.col("id").cast("string")), F.repeat(F.lit("other words "), 20)).alias("text"), F.lit("ReadableText").alias("availability"), F.lit("2025-01-01T00:00:00Z").alias("timestamp"))
    blocks.write.parquet(str(tmp_path / "blocks"))
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    postings.postings(blocks).write.option("parquet.block.size", 64 * 1024).parquet(str(tmp_path / "postings"))
    word = blocks.where("block_reference = 'b00777'").select(F.split("text", " ")[1]).first()[0]
    found = postings.search(spark.read.parquet(str(tmp_path / "postings")), blocks, tq.Word(word)).select("block_reference", "evidence")
    assert [r["block_reference"] for r in found.collect()] == ["b00777"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [x.split("ReadSchema: ")[1] for x in plan.split("\n") if "ReadSchema: " in x]
    assert not any("text:string" in x for x in scans) and "EqualTo(token" in plan

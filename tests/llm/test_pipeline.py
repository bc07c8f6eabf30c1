"""The pipeline against a plain version of its stages."""

import brute

import corpus_pipeline
from talkprism.llm import quality_rules

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]

    limits = quality_rules.NGRAM_LIMITS, quality_rules.AGAIN_LIMITS, quality_rules.LINE_LIMIT
    left = {k: r["text"] for k, r in docs.items() if brute.rule_verdict(r["text"], *limits)}
    groups = brute.components([(k, brute.fingerprint(t)) for k, t in left.items()], lambda a, b: (a ^ b).bit_count() <= 4)
    left = {k: left[k] for k, _, c in groups if k == c}
    leaked = {d for d, _ in brute.leaks(left.items(), items)}
    left = {k: t for k, t in left.items() if k not in leaked}

    stage, kept = None, spark.read.parquet(f"{SF}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:4]:
        stage = f(spark, kept, SF)
        assert stage.columns == kept.columns, name
        kept = stage
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(texts) == set(left)
    for k, t in texts.items():
        spans = brute.secret_base(left[k])[4]
        assert t == left[k] if not spans else "[SECRET]" in t and not brute.secret_base(t)[4]

    rows = corpus_pipeline.run(spark, SF).collect()
    sizes, taken, target = {}, {}, {}
    for k, t in texts.items():
        sizes[docs[k]["source"]] = sizes.get(docs[k]["source"], 0) + len(brute.words(t))
    want = brute.targets(sizes)
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        taken[source] = taken.get(source, 0) + r["taken"]
        target[source] = r["target"]
        assert r["text"] == texts[r["doc_id"]] and 0 < r["taken"] <= 3 * r["size"] and r["size"] == len(brute.words(texts[r["doc_id"]]))
    assert {s: round(t, 6) for s, t in target.items()} == {s: round(want[s], 6) for s in target}
    longest = max(len(brute.words(t)) for t in texts.values())
    assert all(abs(taken.get(s, 0) - want[s]) <= longest for s in want)


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, SF).count() == 0

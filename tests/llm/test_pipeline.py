"""The pipeline's settings, on small inputs of known shares."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import mixing, queries
from folioscope.llm.common import alnum_words
from tests.llm import brute


def test_mixing_stage_takes_toxic_tokens_away(spark, tmp_path):
    draw = np.random.default_rng(3)
    kinds = ["clean"] * 260 + ["low"] * 12 + ["toxic"] * 45
    rows = [(k, " ".join(f"{kind}{draw.integers(30)}" for _ in range(60))) for k, kind in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(k, int(kind != "low"), int(kind == "toxic")) for k, kind in enumerate(kinds)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    mixed = corpus_pipeline.mixing_stage(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    got = mixed.collect()
    n = {kind: sum(len(alnum_words(r["text"])) for r in got if kinds[r["doc_id"]] == kind) for kind in queries.DOMAINS}
    assert {r["doc_id"] for r in got} >= {k for k, kind in enumerate(kinds) if kind == "clean"}
    assert n["toxic"] / sum(n.values()) < 0.06 and abs(n["clean"] / sum(n.values()) - 0.9) < 0.03  # 14 % came in toxic


def test_least_rates_by_leading_domain(spark):
    draw = np.random.default_rng(5)
    rows = [(k, int(draw.integers(1, 500)), draw.dirichlet([0.3, 0.03, 0.04]).tolist()) for k in range(500)]
    df = spark.createDataFrame(rows, "rid long, n_tokens long, posterior array<double>")
    got, figures = mixing.fit_rates(df, list(queries.DOMAINS.values()), total_factor=1.25, least_rate=[1.0, 0.0, 0.0])
    out = got.withColumn("leads", F.expr("array_position(posterior, array_max(posterior))")).toPandas()
    assert out["rate"][out["leads"] == 1].min() >= 1 and 0 <= out["rate"][out["leads"] > 1].min() < 0.5
    assert all(abs(f["expected"] / f["target"] - 1) < 0.01 for f in figures)


def tables(spark, path, rows, labels, items):
    """Documents with columns whose names clash with those that stages use."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' as lang", "cast(null as string) as source", "doc_id as score", "1 as rid", "'x' as rate", "text as words", "2 as n_copies", "struct(1 as a) as row", "cast(null as map<string,int>) as `odd.name`"
    )
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def ids(df):
    return sorted((r["doc_id"] is not None, r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect())


def test_stages_on_awkward_tables(spark, tmp_path, hard):
    draw = np.random.default_rng(9)
    bench = "the quick brown fox jumps over the lazy dog and then sleeps for hours"
    good = [f"this is a good text about {' '.join(f'w{x}' for x in draw.integers(0, 300, 40))} and more of it" for _ in range(60)]
    junk = [f"!!! $$$ BUY {k} ### {' '.join('$%#' for _ in range(30))}" for k in range(60)]
    rows = [(i, t) for i, t in hard[1]] + [(5000 + k, t) for k, t in enumerate(good + junk)] + [(7000, f"see: {bench}"), (None, f"and {bench}!"), (7001, good[0]), (7001, good[0])]
    marks = [(5000 + k, 1, 0) for k in range(60)] + [(5060 + k, 0, 0) for k in range(30)] + [(5000, None, None), (None, 1, 1), (5001, 1, 1), (5001, 1, 1)]
    docs = tables(spark, str(tmp_path), rows, marks, [(1, bench), (2, None), (None, "one two"), (3, "")])
    stages = dict(corpus_pipeline.STAGES)
    scored = stages["quality classifier"](spark, docs, str(tmp_path))
    assert scored.columns == docs.columns
    kept = {r["doc_id"] for r in scored.collect()}
    assert sum(5000 + k in kept for k in range(60)) >= 58 and sum(5090 + k in kept for k in range(30)) <= 2
    assert {r["score"] for r in scored.where("doc_id = 5000").collect()} == {5000}

    near = stages["near-duplicates"](spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    wanted = {(i, t) for (i, t), (_, _, c) in zip(rows, brute.near_groups(rows, 80), strict=True) if i == c}
    assert ids(near) == sorted((i is not None, i, t or "") for i, t in wanted)

    clean = stages["benchmark decontamination"](spark, docs, str(tmp_path))
    hit = [bool(h) for _, _, h, _ in brute.contamination(rows, [(1, bench), (2, None), (None, "one two"), (3, "")])]
    assert clean.columns == docs.columns and sum(hit) == 2
    assert ids(clean) == sorted((i is not None, i, t or "") for (i, t), h in zip(rows, hit, strict=True) if not h)

    mixed = stages["mixing to target weights"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and {x[1:] for x in ids(mixed)} <= {(i, t or "") for i, t in rows}
    shards = stages["sharding"](spark, docs, str(tmp_path))
    assert ids(shards) == sorted((i is not None, i, t or "") for i, t in rows)
    for s in range(8):
        slots = sorted(r["slot"] for r in shards.where(F.col("shard") == s).collect())
        assert slots == list(range(len(slots)))


def test_stages_on_empty_tables(spark, tmp_path):
    docs = tables(spark, str(tmp_path), [], [], [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_is_the_stages_in_turn(spark, sf):
    """Each row of the run against what plain versions say of its stages' inputs."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    now = spark.read.parquet(f"{sf}/documents.parquet")
    scored = corpus_pipeline.quality_stage(spark, now, sf)
    passed = {r["doc_id"] for r in scored.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, sf).select("doc_id", "text", "shard", "slot").collect()
    rest = [(i, docs[i]) for i in sorted(passed)]
    heads = [(i, t) for (i, t), (_, _, c) in zip(rest, brute.near_groups(rest, corpus_pipeline.NEAR_PERCENT), strict=True) if i == c]
    clean = {i for (i, _), (_, _, h, _) in zip(heads, brute.contamination(heads, items), strict=True) if not h}
    assert {r["doc_id"] for r in out} <= clean and all(r["text"] == docs[r["doc_id"]] for r in out)
    # Mixing keeps every document that the domain `clean` leads, so nearly all that are labelled clean.
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    assert len(good & clean & {r["doc_id"] for r in out}) >= 0.95 * len(good & clean)
    sizes = [sum(r["shard"] == s for r in out) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1

"""What learns is tested on held-out rows, or by what must hold of its result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import common, mixing, quality, queries, warc_store
from folioscope.llm.features import Sample
from tests.llm import brute


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = label.sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


@pytest.fixture(scope="session")
def larger():
    return "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark, larger):
    got = queries.op7_quality(spark, larger)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    held = got.where("held_out").join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").select("score", "predicted", "quality").toPandas()
    assert auc(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.97
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    assert got.where("score is null or score < 0 or score > 1").count() == 0


def test_prior_is_estimated(spark):
    draw = np.random.default_rng(1)
    for prior in (0.3, 0.8):
        positive = draw.normal(2, 1, 3000)
        mixed = np.where(draw.random(5000) < prior, draw.normal(2, 1, 5000), draw.normal(-2, 1, 5000))
        assert abs(quality.estimate_prior(positive, mixed) - prior) < 0.06
    assert quality.estimate_prior(np.array([]), np.array([1.0])) == 0.5


def test_scores_of_awkward_texts(spark, empty):
    good = spark.createDataFrame([(k, f"this is the good text number {k} of the kind") for k in range(30)], "doc_id long, text string")
    other = good.limit(10).unionByName(spark.createDataFrame([(100 + k, f"!!! BAD {k} $$$ BAD!!") for k in range(30)], "doc_id long, text string"))
    model, prior = quality.fit_quality(good, other)
    assert 0 < prior < 1
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "é" * 5), (2, "é" * 5), (3, "x" * 200000)], "doc_id long, text string").withColumn("score", F.lit("old"))
    got = quality.score_quality(odd, model)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == 5
    assert got.where("doc_id = 2").select("score").distinct().count() == 1
    assert quality.score_quality(empty, model).count() == 0
    none, prior = quality.fit_quality(empty, empty)
    assert prior == 0.5 and quality.score_quality(good, none).count() == 30


def members(spark):
    draw = np.random.default_rng(5)
    rows = [(int(k), int(draw.integers(1, 500)), draw.dirichlet([0.5, 0.3, 0.2]).tolist()) for k in range(300)]
    return spark.createDataFrame(rows, "rid long, n_tokens long, posterior array<double>")


@pytest.mark.parametrize("weights,total,least", [([1, 1, 1], None, 0.0), ([0.7, 0.2, 0.1], 60000.0, 0.0), ([0.5, 0.4, 0.1], 200000.0, 1.0)])
def test_rates_meet_targets(spark, weights, total, least):
    rows = members(spark)
    got, figures = mixing.fit_rates(rows, weights, total, least_rate=least)
    out = got.toPandas()
    assert out["rate"].min() >= least
    tokens = out["n_tokens"].sum() if total is None else total
    expected = (np.stack(out["posterior"]) * (out["rate"] * out["n_tokens"]).to_numpy()[:, None]).sum(0)
    assert np.allclose(expected, [f["expected"] for f in figures])
    assert np.allclose(expected, np.array(weights) / sum(weights) * tokens, rtol=0.01)


def test_rates_are_projected(spark):
    got, figures = mixing.fit_rates(members(spark), [1, 0, 0], 20000.0)
    out = got.toPandas()
    assert out["rate"].min() == 0 and out["rate"].max() > 0
    # No feasible direction makes the squared error less: the gradient is nonnegative where the rate is at its bound.
    p, n = np.stack(out["posterior"]), out["n_tokens"].to_numpy()
    residual = np.array([f["expected"] - f["target"] for f in figures])
    slope = p @ np.linalg.inv((p * n[:, None]).T @ p) @ residual
    assert slope[out["rate"] == 0].min() > -0.02 and np.abs(slope[out["rate"] > 1e-6]).max() < 0.1


@pytest.mark.parametrize("kind", [[0.3, 1.5, 0.2], [0.1, 0.5, 0.07]])
def test_rates_meet_targets_of_a_dominant_domain(spark, kind):
    draw = np.random.default_rng(7)
    rows = [(k, int(draw.integers(1, 800)), draw.dirichlet(kind).tolist()) for k in range(3000)]
    df = spark.createDataFrame(rows, "rid long, n_tokens long, posterior array<double>").cache()
    got, figures = mixing.fit_rates(df, [0.9, 0.07, 0.03])
    out = got.toPandas()
    expected = (np.stack(out["posterior"]) * (out["rate"] * out["n_tokens"]).to_numpy()[:, None]).sum(0)
    assert out["rate"].min() >= 0 and np.allclose(expected, np.array([0.9, 0.07, 0.03]) * out["n_tokens"].sum(), rtol=0.01)


def plain_rates(n, p, target, least, most, steps=60000):
    """Projected gradient of the plain kind: accelerated, one metric, restarted when the error grows."""
    gram = (p * n[:, None]).T @ p
    size, axes = np.linalg.eigh(gram)
    kept = size > 1e-9 * size.max()
    metric = (axes[:, kept] / size[kept]) @ axes[:, kept].T
    r = z = np.clip(np.ones(len(n)), least, most)
    a = az = (n * r) @ p
    t, error = 1.0, np.inf
    for _ in range(steps):
        new = np.clip(z - p @ (metric @ (az - target)), least, most)
        an = (n * new) @ p
        now = (an - target) @ metric @ (an - target)
        if now > error and az is not a:
            t, z, az = 1.0, r, a
            continue
        if np.abs(new - z).max() < 1e-10:
            break
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, az = new + (last - 1) / t * (new - r), an + (last - 1) / t * (an - a)
        r, a, error = new, an, now
    return a


@pytest.mark.parametrize("most", [1.3, 4.0, None])
def test_rates_within_bounds_against_a_plain_solver(spark, most):
    """Targets that bounds keep out of reach are missed as a plain solver misses them; others are met."""
    draw = np.random.default_rng(3)
    rows = [(k, 100, [0.98, 0.01, 0.01]) for k in range(300)] + [(300, 5, [0.02, 0.96, 0.02])] + [(301 + k, 100, [0.02, 0.01, 0.97]) for k in range(20)]
    df = spark.createDataFrame([rows[k] for k in draw.permutation(len(rows))], "rid long, n_tokens long, posterior array<double>")
    got, figures = mixing.fit_rates(df, [0.9, 0.07, 0.03], total_factor=1.25, least_rate=[1.0, 0.0, 0.0], most_rate=most)
    out = got.orderBy("rid").toPandas()
    p, n = np.stack(out["posterior"]), out["n_tokens"].to_numpy(float)
    lead = p.argmax(1)
    target = np.array([0.9, 0.07, 0.03]) * 1.25 * n.sum()
    expected = plain_rates(n, p, target, np.where(lead == 0, 1.0, 0.0), np.inf if most is None else most)
    assert np.allclose([f["expected"] for f in figures], expected, rtol=0.02, atol=0.002 * n.sum())
    assert [f["met"] for f in figures] == (np.abs(np.array([f["expected"] for f in figures]) - target) <= 1e-3 * np.maximum(target, 1e-3 * n.sum())).tolist()
    assert out["rate"][lead == 0].min() >= 1 and (most is None or out["rate"].max() <= most)
    assert not figures[1]["met"] if most else all(f["met"] for f in figures)


def test_mixture_of_given_documents_against_a_plain_solver(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labelled = queries.domain_labels(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rated, report = mixing.fitted_mixture(docs, labelled, queries.DOMAINS, total_factor=1.25, least_rate={"clean": 1.0}, most_rate=4.0)
    out = rated.toPandas()
    p, n = np.stack(out["posterior"]), out["n_tokens"].to_numpy(float)
    target = np.array(list(queries.DOMAINS.values())) * 1.25 * n.sum()
    expected = plain_rates(n, p, target, np.where(p.argmax(1) == 0, 1.0, 0.0), 4.0)
    rows = {r["domain"]: r for r in report.collect()}
    assert np.allclose([rows[d]["expected"] for d in queries.DOMAINS], expected, rtol=0.02)
    assert np.isclose(sum(r["share"] for r in rows.values()), 1) and np.allclose([rows[d]["target"] for d in queries.DOMAINS], target)


def test_rates_that_do_not_settle_are_an_error(spark):
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.fit_rates(members(spark), [1, 0, 0], 20000.0, rounds=1)


def test_mixing_repeats_and_keeps_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("rate", F.lit("x"))
    labelled = queries.domain_labels(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    tokens = docs.count() * 500.0
    mixed = mixing.mix(docs, labelled, {"clean": 0.9, "low": 0.05, "toxic": 0.05}, total=2 * tokens, least_rate=1.0)
    assert mixed.columns == docs.columns
    assert mixed.select("doc_id").distinct().count() == docs.count() and mixed.count() > docs.count()
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a text")], "doc_id long, text string")
    assert mixing.mixture(odd, labelled, {"clean": 1.0, "low": 1.0}).count() == 4
    assert mixing.mixture(odd.limit(0), labelled, {"clean": 1.0}).count() == 0
    assert mixing.mixture(odd, labelled.limit(0), {"clean": 1.0, "low": 1.0}).count() == 4


def test_no_row_is_repeated_too_often(spark):
    rows = [(k, f"clean words number {k} of a clean text") for k in range(40)] + [(40, "low")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = docs.withColumn("domain", F.when(F.col("doc_id") == 40, "low").otherwise("clean"))
    mixed = mixing.mix(docs, labelled, {"clean": 0.5, "low": 0.5}, most_rate=4.0)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 4


def test_posteriors_on_held_out_labels(spark, larger):
    docs, labels = (spark.read.parquet(f"{larger}/{n}.parquet") for n in ("documents", "labels"))
    known = queries.domain_labels(docs, labels)
    model = mixing.fit_domains(known.where("doc_id % 2 = 0"), list(queries.DOMAINS))
    got = mixing.domain_posteriors(docs, model).join(known.where("doc_id % 2 = 1"), F.col("rid") == F.col("doc_id")).toPandas()
    guess = np.array(list(queries.DOMAINS))[np.stack(got["posterior"]).argmax(1)]
    assert (guess == got["domain"]).mean() > max(0.8, (got["domain"] == "clean").mean() + 0.03)  # some 200 texts are learnt from


def test_copies_have_the_rate_as_mean(spark):
    got = spark.range(20000).select(mixing.copies(F.lit(1.3), F.col("id")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert abs(got[0] - 1.3) < 0.02 and got[1] == 1 and got[2] == 2


def test_sample_part():
    s = Sample(np.zeros((3, 18)), np.array([1, 2, 3], np.int32), np.ones(3, np.float32), np.array([0, 2, 2]), np.array([1, 0, 1]))
    part = s.part(s.label == 1)
    assert part.row.tolist() == [0, 1, 1] and part.index.tolist() == [1, 2, 3]


def test_sample_is_dealt_whole():
    s = Sample(np.arange(5 * 18).reshape(5, 18), np.arange(5, dtype=np.int32), np.ones(5, np.float32), np.arange(5), np.arange(5))
    parts = s.dealt(2)
    assert sorted(np.concatenate([rows for rows, _ in parts]).tolist()) == [0, 1, 2, 3, 4]
    assert all(len(rows) <= 2 and part.label.tolist() == rows.tolist() == part.index.tolist() for rows, part in parts)
    assert [len(part) for _, part in s.part(s.label > 9).dealt(2)] == [0]


@pytest.mark.parametrize("hot_keys", [1000, 7])
def test_archive_round_trip(spark, sf, tmp_path, monkeypatch, hot_keys):
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()]
    rows += [(9001, "u", None), (9000, None, ""), (9002, "a\r\nb", rows[3][2]), (9003, "é", "ß" * 9), (9004, "v", "ß" * 9)]
    got = warc_store.archived(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha256", F.lit(1))).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(brute.warc([(p, h) for p, _, h in rows]))
    html = {p: (h or "").encode() for p, _, h in rows}
    for r in got:
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        length = int(warc_store.parse_head(bytes(r["record"]))["Content-Length"])
        assert length == len(body) - 4
        if r["record_type"] == "response":
            assert body.endswith(html[r["page_id"]] + b"\r\n\r\n")
    path = str(tmp_path / "a")
    warc_store.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == pages.select("html").distinct().count()


def test_archive_of_awkward_pages(spark):
    rows = [(None, "a", "same"), (None, "b", "same"), (4, "c", "same"), (4, "d", "same"), (5, "e", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"]) for r in warc_store.archived(df).collect())
    assert got == [(0, "revisit", 4), (0, "revisit", 4), (4, "response", None), (4, "revisit", 4), (5, "response", None)]
    assert warc_store.archived(df, min_bytes=4 + 1).where("record_type = 'revisit'").count() == 0
    assert warc_store.archived(df.limit(0)).count() == 0


def test_a_changed_payload_is_noticed(spark, tmp_path):
    import zstandard

    path = str(tmp_path / "a")
    warc_store.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), path)
    bad = spark.read.parquet(f"{path}/payloads").toPandas().assign(packed=zstandard.compress(b"other"))
    spark.createDataFrame(bad, "sha256 string, packed binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not have its digest"):
        warc_store.read_archive(spark, path).collect()

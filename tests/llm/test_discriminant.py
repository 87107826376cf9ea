import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from semgraph.llm import discriminant

QUERY = discriminant.QUERIES.queries["op11_quality_discriminant"]


def test_counts_of_a_text():
    text = "The the, CAT!! cat!! **sat** here.\n\nThe line\nThe line\nx 12"
    got = dict(zip(discriminant.COUNTS, discriminant.count_text(text)))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert got["words"] == len(words) and got["characters"] == sum(map(len, words))
    assert (got["again"], got["capitals"], got["marked"], got["symbols"], got["stops"], got["digits"]) == (0, 6, 1, 4, 1, 2)
    assert (got["calls"], got["copied_lines"], got["lines"], got["frequent"]) == (4, 1, 4, 3)
    assert discriminant.count_text("a a a\U0001F600 a a")[2] == 2


def test_scores_are_those_of_normal_densities():
    rng = np.random.default_rng(2)
    n = discriminant.SIZE
    rows = [rng.standard_normal((200, n)) @ rng.standard_normal((n, n)) + k for k in (0, 1)]
    counts, means = np.array([200.0, 200.0]), np.array([r.mean(0) for r in rows])
    scatters = np.array([(r - m).T @ (r - m) for r, m in zip(rows, means)])
    model = discriminant.discriminant(counts, means, scatters, 0.1, 0.1)
    pooled = scatters.sum(0) / 400
    logs = []
    for m, s in zip(means, scatters):
        cov = 0.9 * (0.9 * s / 200 + 0.1 * pooled) + 0.1 * np.diag(pooled.diagonal())
        off = rows[0] - m
        logs.append(-0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (off @ np.linalg.inv(cov) * off).sum(1))
    assert np.allclose(model.score(rows[0]), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))))


def test_labels_left_out_of_the_fit(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in QUERY(spark, sf).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    pairs = [(r.quality, got[r.doc_id]) for r in labels.collect()]
    tried = [(q, r.predicted) for q, r in pairs if r.held_out]
    assert len(tried) > 50 and sum(q == p for q, p in tried) / len(tried) > 0.97
    turned = labels.withColumn("quality", F.when(discriminant.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = discriminant.score_quality(docs.select("doc_id", "text"), turned).collect()
    assert all(abs(r.score - got[r.doc_id].score) < 1e-9 for r in again)


def test_odd_rows(spark):
    long = "word after word of a very long text. " * 30_000
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "no id"), (4, "x x x x"), (5, "!!! ###"), (6, "fine text it is.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"score": F.lit("mine"), "stats": F.lit(1), "held_out": F.lit(2), "good": F.lit(3)})
    labels = spark.createDataFrame([(1, None), (3, 1), (4, 0), (4, 0), (5, 0), (6, 1), (None, 1), (99, 7)], "doc_id long, quality int")
    out = discriminant.score_quality(docs, labels)
    assert out.columns == ["doc_id", "score", "stats", "held_out", "good", "_held_out", "_score"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r._score <= 1 for r in got)
    assert [r._held_out for r in got if r.doc_id is None] == [False]
    assert len({r._score for r in got if r.doc_id == 3}) == 1 == len({r._score for r in got if r.doc_id in (1, 2)})
    for some, share in ((labels.filter("quality = 1"), None), (labels.limit(0), 0.5)):
        scores = {r._score for r in discriminant.score_quality(docs, some).collect()}
        assert len(scores) == 1 and (share is None or scores == {share})
    assert discriminant.score_quality(docs.limit(0), labels).count() == 0

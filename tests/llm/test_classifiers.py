"""Fits of the text classifiers against direct computation."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunledger.llm import common, quality, toxicity

GOOD = ["A first line of a good text.\nAnother one, that goes on.", "Well written prose stands here."]
BAD = ["$$$ 1234 ### 99\n!!! buy ^^^", "@@ ## 00 11 22\n== 7 7 7\n%%"]


def table_of(spark, n, rarer):
    rows = [(i, (BAD if i < rarer else GOOD)[i % 2] + f"\nline {i}") for i in range(n)]
    labels = [(i, int(i >= rarer)) for i in range(n)]
    return (spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("label", F.lit("clash")),
            spark.createDataFrame(labels, "doc_id bigint, quality int").withColumn("text", F.lit("clash")))


@pytest.mark.parametrize("n, rarer, shards", [(12, 2, 1), (60, 6, 1), (300, 60, None), (40, 0, 0)])
def test_no_labelled_row_is_left_out(spark, n, rarer, shards):
    docs, labels = table_of(spark, n, rarer)
    rows = common.labelled(docs, labels, "quality", 6000)
    dealt = quality.dealt_rows(rows, 12).groupBy("_shard", "label").count().collect()
    assert sum(r["count"] for r in dealt) == rows.count()
    weights = quality.fit(docs, labels)
    if shards == 0:
        assert len(weights) == 0
        return
    found = {r["_shard"] for r in dealt}
    assert all({r["label"] for r in dealt if r["_shard"] == s} == {0, 1} for s in found)
    assert len(found) == shards if shards else 1 < len(found) <= 12
    scores = dict(zip(("good", "bad"), quality.score_texts([GOOD[0].encode(), BAD[0].encode()], weights)))
    assert scores["good"] > 0.5 > scores["bad"]


def test_field_maximises_the_likelihood_of_all_labellings():
    """The fitted weights are a maximum of the penalised likelihood that enumeration gives."""
    texts, labels, ridge = [t.encode() for t in GOOD + BAD], [1, 1, 0, 0], 0.1
    docs = [quality.document_lines(t) for t in texts]

    def loss(x):
        w, step = x[:-4], x[-4:].reshape(2, 2)
        total = ridge / 2 * (x @ x)
        for lines, y in zip(docs, labels):
            unary = lines @ w

            def weight(path):
                return unary @ np.array(path) + sum(step[a, b] for a, b in itertools.pairwise(path))
            every = [weight(p) for p in itertools.product((0, 1), repeat=len(lines))]
            total += math.log(sum(math.exp(v) for v in every)) - weight([y] * len(lines))
        return total

    fitted = quality.fit_field(texts, labels, ridge)
    best, rng = loss(fitted), np.random.default_rng(0)
    for _ in range(20):
        assert loss(fitted + rng.normal(0, 0.05, len(fitted))) > best - 1e-6


def test_document_score_is_the_length_weighted_mean_of_its_lines():
    rng = np.random.default_rng(1)
    weights = rng.normal(0, 0.1, quality.document_lines(b"x").shape[1] + 4)
    text = b"one line\n\na second and longer line here\nx"
    unary, lengths = quality.line_scores(text, weights[:-4])
    _, good, _ = quality.Chains([len(unary)]).marginals(unary, weights[-4:].reshape(2, 2))
    assert quality.score_texts([text], weights) == pytest.approx([(good * lengths).sum() / lengths.sum()])


def test_log_count_ratios_by_counting(spark):
    texts = [(b"you awful thing", 1), (b"awful awful words", 1), (b"such a nice day", 0), (b"nice words here", 0),
             (b"a day of words", 0), (b"", 0)]
    rows = spark.createDataFrame(texts, "text binary, label int")
    counts = {0: Counter(), 1: Counter()}
    for text, label in texts:
        counts[label].update(set(toxicity.text_grams(text)))
    got = toxicity.ratios(rows, 2, 4, 10_000)
    want = {g: math.log((counts[1][g] + 0.5) / 3) - math.log((counts[0][g] + 0.5) / 5)
            for g in counts[0].keys() | counts[1].keys() if counts[0][g] + counts[1][g] >= 3}
    assert len(want) > 3 and got == pytest.approx(want)

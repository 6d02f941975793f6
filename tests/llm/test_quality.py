"""Held-out accuracy, and site posteriors against plain sums."""

from __future__ import annotations

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wiretally.llm import quality
from wiretally.llm.queries import queries

SF_DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    truth = {r.id: r.good for r in quality.labelled(labels).collect()}
    picked = {r.id for r in quality.labelled(labels).orderBy(F.xxhash64("id"), "id").limit(3000).collect()}
    model = quality.fitted(docs, labels, fit_rows=3000)
    judged = quality.site_posteriors(docs, model, F.col("source"), F.col("lang")).collect()
    rest = [(r.keep, bool(truth[r.id])) for r in judged if r.id in truth and r.id not in picked]
    assert len(rest) > 100
    assert sum(a == b for a, b in rest) / len(rest) >= 0.9
    clean = [keep for keep, good in rest if good]
    assert sum(clean) / len(clean) >= 0.96


def test_query_returns_every_document(spark):
    found = queries()["op4_quality_classifier"](spark, "/root/testdata/sf0.001")
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_posteriors_equal_plain_sums(spark):
    rows = [(i, ("bad " if i % 7 < 2 or i % 5 == 0 else "good ") * 9, f"h{i % 5}", f"p{i % 3}") for i in range(200)]
    rows += [(500, "good text", None, None), (501, "bad text", None, "p1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = [(i, int(t.startswith("good")), None) for i, t, *_ in rows]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fitted(docs, labels)
    found = {r.id: r for r in quality.site_posteriors(docs, model, F.col("host"), F.col("path")).collect()}
    p = {i: found[i].p_text for i, *_ in rows}
    paths, hosts = defaultdict(list), defaultdict(list)
    for i, _, host, path in rows:
        paths[host, path].append(p[i])
        hosts[host].append(p[i])

    def strength(groups) -> float:
        n = sum(map(len, groups))
        mean = sum(map(sum, groups)) / n
        between = sum(sum(g) ** 2 / len(g) for g in groups)
        within = max(sum(x * x for g in groups for x in g) - between, 0) / max(n - len(groups), 1)
        spread = between - n * mean**2 - (len(groups) - 1) * within
        variance = spread / (n - sum(len(g) ** 2 for g in groups) / n)
        return min(max(within / variance if variance > 0 else 1e6, 1.0), 1e6)

    k_host, k_path = strength(list(hosts.values())), strength(list(paths.values()))
    mean = sum(p.values()) / len(p)
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    for i, _, host, path in rows:
        p_host = (sum(hosts[host]) + k_host * mean) / (len(hosts[host]) + k_host)
        own = paths[host, path]
        p_path = (sum(own) - p[i] + k_path * p_host) / (len(own) - 1 + k_path)
        assert found[i].p_host == pytest.approx(p_host)
        assert found[i].p_path == pytest.approx(p_path)
        assert logit(found[i].p_good) == pytest.approx(logit(p[i]) + logit(p_path) - logit(mean), abs=1e-4)


def test_edge_rows(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "x" * 200_000, None), (3, "x" * 200_000, None), (None, "good words", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string").withColumn("p", F.lit(3))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, 1), (None, 1, 0), (3, 1, None), (3, 0, None), (9, 1, 0)], none.schema)
    for labels in (none, odd):
        model = quality.fitted(docs, labels)
        assert quality.site_posteriors(docs, model, F.col("host"), F.col("p")).count() == len(rows)
    kept = quality.drop_low_quality(docs, none, F.col("host"), F.col("p"))
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert quality.drop_low_quality(docs.limit(0), none, F.col("host"), F.col("p")).count() == 0
    assert {r.id: r.good for r in quality.labelled(odd).collect()} == {3: 0, 9: 1}

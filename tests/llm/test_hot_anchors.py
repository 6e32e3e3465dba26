"""A passage in very many texts: joins by its anchor are split over tasks."""

import random

import pytest
from test_operators import brute_removal, table

from netquill.llm import suffix_dedup

SKEWED = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in SKEWED}
    for k, v in SKEWED.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_joins_by_a_frequent_anchor_are_split(skewed, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, longer = word(300), word(500)
    texts = [word(500) + (longer if i % 10 == 0 else common) + word(500) for i in range(400)]
    plans, write, cut = {}, suffix_dedup.staged, suffix_dedup.cut_examples

    def seen(df, name):
        df.collect()
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return df

    monkeypatch.setattr(suffix_dedup, "staged", lambda df, name: write(seen(df, name) if name == "shared_segments" else df, name))
    monkeypatch.setattr(suffix_dedup, "cut_examples", lambda wanted, width: cut(seen(wanted, "examples"), width))
    rows = suffix_dedup.remove_repeats(table(skewed, texts).repartition(8), ["doc_id"]).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept_bytes)) for r in rows} == dict(enumerate(brute_removal([t.encode() for t in texts])))
    assert sum(r.n_removed > 0 for r in rows) == 40
    assert all("skew=true" in plans[name] for name in ("shared_segments", "examples")), plans

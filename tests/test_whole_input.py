"""Queries return the whole job on input that the given tables do not have."""

import hashlib
import ipaddress
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from netquill.operators import alerts
from netquill.plans import catalog

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(spark, folder, ids):
    rows = [(i, datetime(2024, 1, 1), 1, "click", 1.0, '{"k": 1}') for i in ids]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_ip6_text_of_any_id(spark, tmp_path):
    ids = [0, 8, 59_999, 60_000, 65_534, 65_535, 65_536, 1_000_000, (1 << 32) - 2, (1 << 32) - 1, 1 << 40, (1 << 48) + 5]
    got = {r.pkt_id: r.ip for r in catalog.QUERIES["ip6_text"](spark, events(spark, tmp_path, ids)).collect()}
    assert got == {i: str(ipaddress.IPv6Address((0x20010DB8 << 96) + i + 1)) for i in ids}


def test_reassemble_long_document(spark, tmp_path):
    texts = ["short", "0123456789" * 150_000, "x" * (1 << 20)]  # one over a stream's default cap, one as long as it
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.md5) for r in catalog.QUERIES["reassemble"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(t), hashlib.md5(t.encode()).hexdigest()) for i, t in enumerate(texts)}


@pytest.fixture
def many_tasks(spark):
    """Small partitions are not put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_alerts_are_numbered_in_many_tasks(spark, many_tasks):
    keys = [(i * 7919 % 500 // 100, i, rule) for i in range(1000) for rule in (3, 7)]  # many at the same time
    got = alerts.numbered(spark.createDataFrame(keys, "ts_us bigint, pkt_id bigint, rule_ord int").repartition(3)).withColumn("task", F.spark_partition_id()).collect()
    assert [(r.ts_us, r.pkt_id, r.rule_ord) for r in sorted(got, key=lambda r: r.id)] == sorted(keys)
    assert sorted(r.id for r in got) == list(range(1, 2001))
    assert len({r.task for r in got}) > 1

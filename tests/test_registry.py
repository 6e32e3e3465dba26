"""Own filters, rules and detectors."""

from pyspark.sql import functions as F

from netquill.functions import registry
from netquill.operators import alerts, payloads


def test_registry(spark):
    registry.register_filter("big", lambda: F.col("len") > 1000)
    registry.register_rule("own", lambda: F.when(F.col("len") > 1400, alerts.alert(99, "Own", "Low", "Own", F.lit("own"))))
    registry.register_detector("bits", lambda: F.when(payloads.starts(F.col("payload"), b"\x13Bit"), F.struct(F.lit("BitTorrent").alias("protocol"), F.lit("High").alias("confidence"))))
    p = spark.createDataFrame([(1, 1, 1500, "a", "b", 1, 2, bytearray(b"\x13BitTorrent")), (2, 2, 10, "a", "b", 1, 2, bytearray(b"SSH-2"))], "pkt_id bigint, ts_us bigint, len int, src_ip string, dst_ip string, src_port int, dst_port int, payload binary")
    assert [r.pkt_id for r in p.where(registry.filter_named("big")).collect()] == [1]
    assert [(r.pkt_id, r.message) for r in alerts.stateless(p, registry.rules()).collect()] == [(1, "own")]
    assert [r.p for r in p.orderBy("pkt_id").select(registry.detect(payloads.classify(F.col("payload")))["protocol"].alias("p")).collect()] == ["BitTorrent", "SSH"]
    registry.register_functions(spark)
    assert spark.sql("SELECT dns_query_name(NULL) AS n").first().n is None

"""Flows: packets by canonical 5-tuple, split where the key was idle for too long.

How long depends on the state after the packet before: TCP 60 s when new, 300 s established,
15 s closing; UDP 30 s, ICMP 10 s, others 120 s. A new flow starts in state New, whatever state
the key's earlier flow was in. The windows below are exactly equal to a fold over the packets
of a key in order of arrival: between two packets that set a state, the first break resets it.

All windows of a key share one shuffle; aggregation follows on the same partitioning.

A key with over MOST_ROWS packets is cut into stretches of time, dealt by ranges of the order, so
its packets are spread over tasks. What a stretch does to the state is a function of the state it
is entered with: if a packet in it sets a state, the state it leaves is known without that;
if none does, it leaves New if a gap is too long for the state it is entered with, and else that
state. So stretches are summed up on their own, the functions of a key's few stretches are
composed in order, and then each stretch is walked with the state and time it is entered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.protocols import OTHER_TIMEOUT, TCP_TIMEOUT, TIMEOUT, choose
from ..functions.staging import staged
from ..sources.packet_view import with_keys

KEY = ["key_a", "port_a", "key_b", "port_b", "proto"]
ORDER = ["ts_us", "pkt_id"]
#: Columns of packets that flows are made of.
NEEDED = [*ORDER, "l4", "app", "src_ip", "dst_ip", "src_port", "dst_port", "len", "syn", "ack", "fin", "rst"]
SECOND = 1_000_000
#: Packets of one key that a task takes in order; a key with more is cut into stretches.
MOST_ROWS = 1 << 22
STATES = ["New", "Established", "Closing"]


def canonical(packets: DataFrame) -> DataFrame:
    """packets with the key's columns; the smaller (address, port) is side a. Packets without addresses are left out."""
    p = with_keys(packets.where("src_ip is not null and dst_ip is not null"))
    p = p.withColumns({"sp": F.coalesce("src_port", F.lit(0)), "dp": F.coalesce("dst_port", F.lit(0)), "proto": F.coalesce("l4", F.lit("Other(0)"))})
    forward = F.struct("src_key", "sp") <= F.struct("dst_key", "dp")
    pick = lambda x, y: F.when(forward, F.col(x)).otherwise(F.col(y))
    columns = {"key_a": pick("src_key", "dst_key"), "port_a": pick("sp", "dp"), "key_b": pick("dst_key", "src_key"), "port_b": pick("dp", "sp"), "ip_a": pick("src_ip", "dst_ip"), "ip_b": pick("dst_ip", "src_ip")}
    p = p.withColumns(columns)
    return p.withColumn("fwd", F.col("src_key") == F.col("key_a")).drop("sp", "dp", "src_key", "dst_key")


def stated() -> Column:
    """The state that a TCP packet sets, null if it sets none."""
    ended = F.col("fin") | F.col("rst")
    return F.when(F.col("proto") == "Tcp", F.when(F.col("syn") & ~F.col("ack"), "New").when(F.col("ack") & ~ended, "Established").when(ended, "Closing"))


def timeout_us(state: Column) -> Column:
    tcp = choose(state, TCP_TIMEOUT, TCP_TIMEOUT["New"])
    return F.when(F.col("proto") == "Tcp", tcp).otherwise(choose(F.col("proto"), TIMEOUT, OTHER_TIMEOUT)).cast("bigint") * SECOND


def in_flows(packets: DataFrame, tick_s: int = 0, most_rows: int = MOST_ROWS) -> DataFrame:
    """packets with the key's columns, flow_no (from 1 within a key) and state (after the packet).

    With tick_s, idle flows end only at ticks of so many seconds, so a packet that comes
    before the tick revives its flow.
    """
    p = canonical(packets).withColumn("sets", stated())
    hot = staged(hot_keys(packets, most_rows), "hot_keys")
    if hot.isEmpty():
        return walked(p, KEY, tick_s).drop("sets")
    cold = walked(p.join(hot, KEY, "left_anti"), KEY, tick_s)
    return cold.unionByName(in_stretches(p.join(hot, KEY, "left_semi"), tick_s)).drop("sets")


def hot_keys(packets: DataFrame, most_rows: int) -> DataFrame:
    """Keys with over most_rows packets, counted by the text of addresses, which is cheaper than by key; only the few that are found are put in key form."""
    end = lambda side: F.struct(F.col(f"{side}_ip").alias("ip"), F.col(f"{side}_port").alias("port"))
    ends = packets.where("src_ip is not null and dst_ip is not null").select("l4", F.least(end("src"), end("dst")).alias("a"), F.greatest(end("src"), end("dst")).alias("b"))
    found = ends.groupBy("l4", "a", "b").count().where(F.col("count") > most_rows)
    return canonical(found.select("l4", F.col("a.ip").alias("src_ip"), F.col("a.port").alias("src_port"), F.col("b.ip").alias("dst_ip"), F.col("b.port").alias("dst_port"))).select(*KEY).distinct()


def walked(p: DataFrame, by: list[str], tick_s: int, in_us: Column | None = None, in_state: Column | None = None) -> DataFrame:
    """p (see canonical, with sets) with state, and flow_no counted within `by`, a key or a stretch of it that is entered with a time and a state."""
    before, entered = in_us if in_us is not None else F.lit(None).cast("bigint"), in_state if in_state is not None else F.lit("New")
    by_key = Window.partitionBy(*by).orderBy(*ORDER)
    so_far = by_key.rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({"before_us": F.coalesce(F.lag("ts_us").over(by_key), before), "run_end": F.count("sets").over(so_far)})
    # A row belongs to the run of the packet before it: that one's state decides on a break.
    p = p.withColumn("run", F.col("run_end") - F.col("sets").isNotNull().cast("int"))
    by_run = Window.partitionBy(*by, "run").orderBy(*ORDER)
    p = p.withColumn("last_set", F.coalesce(F.last("sets", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, -1)), entered, F.lit("New")))
    p = p.withColumn("late_for_run", over(timeout_us(F.col("last_set")), tick_s))
    p = p.withColumn("reset_before", F.coalesce(F.max("late_for_run").over(by_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    p = p.withColumn("breaks", F.when(F.col("reset_before"), over(timeout_us(F.lit("New")), tick_s)).otherwise(F.col("late_for_run")))
    p = p.withColumn("flow_no", F.sum(F.col("breaks").cast("bigint")).over(so_far) + 1)
    kept = F.when(F.col("reset_before") | F.col("breaks"), F.lit("New")).otherwise(F.col("last_set"))
    p = p.withColumn("state", F.coalesce("sets", kept))
    return p.drop("before_us", "run_end", "run", "last_set", "late_for_run", "reset_before", "breaks")


def in_stretches(p: DataFrame, tick_s: int) -> DataFrame:
    """What walked gives for whole keys, with the packets of a key in many tasks."""
    dealt = stretched(p)
    part = [*KEY, "stretch"]
    mine = walked(dealt.join(entered_with(dealt, tick_s), part, "left"), part, tick_s, F.col("in_us"), F.col("in_state")).drop("in_us", "in_state")
    mine = staged(mine, "walked")
    in_order = Window.partitionBy(*KEY).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    broken = mine.groupBy(*part).agg((F.max("flow_no") - 1).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0))).drop("n")
    return mine.join(broken, part).withColumn("flow_no", F.col("flow_no") + F.col("before")).drop("before", "stretch")


def stretched(p: DataFrame) -> DataFrame:
    """p with stretch, a number for each range of key and order. Ranges come from a sample, so rows are written with theirs once."""
    return staged(p.repartitionByRange(*KEY, *ORDER).withColumn("stretch", F.spark_partition_id()), "stretches")


def entered_with(dealt: DataFrame, tick_s: int) -> DataFrame:
    """(KEY, stretch, in_us, in_state): the time of the packet before each stretch, and the state after it."""
    part = [*KEY, "stretch"]
    alone = walked(dealt, part, tick_s)
    lag = F.lag("ts_us").over(Window.partitionBy(*part).orderBy(*ORDER))
    alone = alone.withColumn("before_us", lag).withColumns({f"late_{s}": over(timeout_us(F.lit(s)), tick_s) for s in STATES})
    summed = alone.groupBy(*part).agg(
        (F.count("sets") > 0).alias("known"), F.max_by("state", F.struct(*ORDER)).alias("after"), F.min("ts_us").alias("ts_us"), F.max("ts_us").alias("last_us"), *[F.max(f"late_{s}").alias(f"late_{s}") for s in STATES]
    )
    summed = summed.withColumn("before_us", F.lag("last_us").over(Window.partitionBy(*KEY).orderBy("stretch")))
    summed = summed.withColumns({f"late_{s}": F.col(f"late_{s}") | over(timeout_us(F.lit(s)), tick_s) for s in STATES})
    rows = F.array_sort(F.collect_list(F.struct("stretch", "before_us", "known", "after", *[f"late_{s}" for s in STATES])))  # as many as there are ranges
    start = F.struct(F.lit("New").alias("s"), F.array().cast("array<struct<stretch:int,in_us:bigint,in_state:string>>").alias("entered"))

    def step(acc: Column, x: Column) -> Column:
        late = F.coalesce(*[F.when(acc["s"] == s, x[f"late_{s}"]) for s in STATES])
        leaves = F.when(x["known"], x["after"]).when(late, F.lit("New")).otherwise(acc["s"])
        here = F.struct(x["stretch"].alias("stretch"), x["before_us"].alias("in_us"), acc["s"].alias("in_state"))
        return F.struct(leaves.alias("s"), F.concat(acc["entered"], F.array(here)).alias("entered"))

    return summed.groupBy(*KEY).agg(F.explode(F.aggregate(rows, start, step)["entered"]).alias("e")).select(*KEY, "e.*")


def over(timeout: Column, tick_s: int) -> Column:
    """True if the packet came too late after the one before."""
    idle = F.col("ts_us") - F.col("before_us")
    late = idle >= timeout
    if tick_s:
        width = tick_s * SECOND
        first_tick = F.ceil((F.col("before_us") + timeout) / width) * width
        late = first_tick < F.col("ts_us")
    return F.coalesce(late, F.lit(False))


def flow_table(packets: DataFrame, tick_s: int = 0, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row for each flow, with packets and bytes by direction (forward: from side a)."""
    p = in_flows(packets.select(*NEEDED), tick_s, most_rows)
    size, first, last = F.col("len").cast("bigint"), F.struct("ts_us", "pkt_id"), F.struct("ts_us", "pkt_id")
    total = lambda cond, what, name: F.sum(F.when(cond, what).otherwise(F.lit(0).cast("bigint"))).alias(name)
    one, fwd = F.lit(1).cast("bigint"), F.col("fwd")
    return p.groupBy(*KEY, "flow_no").agg(
        F.min_by("ip_a", first).alias("ip_a"), F.min_by("ip_b", first).alias("ip_b"), F.min_by("app", first).alias("app"), F.max_by("state", last).alias("state"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        total(fwd, one, "packets_fwd"), total(~fwd, one, "packets_rev"), total(fwd, size, "bytes_fwd"), total(~fwd, size, "bytes_rev"),
    )


def with_measures(flows: DataFrame) -> DataFrame:
    return flows.withColumns({
        "total_packets": F.col("packets_fwd") + F.col("packets_rev"), "total_bytes": F.col("bytes_fwd") + F.col("bytes_rev"),
        "duration_ms": F.expr("(last_us - first_us) div 1000"),
    })


def top_flows(flows: DataFrame, by: str = "total_bytes", n: int = 30) -> DataFrame:
    """By total_bytes, total_packets or duration_ms; ties by key."""
    return with_measures(flows).orderBy(F.desc(by), *KEY, "flow_no").limit(n)


def end_us() -> Column:
    """When an idle flow ends."""
    return F.col("last_us") + timeout_us(F.col("state"))


def evicted(flows: DataFrame, now_us: Column | int) -> DataFrame:
    """Flows that had ended by then; a key's later flow ends the ones before."""
    newest = F.max("flow_no").over(Window.partitionBy(*KEY))
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    return flows.withColumn("newest", newest).where((F.col("flow_no") < F.col("newest")) | (end_us() <= now)).drop("newest")


def active(packets: DataFrame, now_us: int) -> DataFrame:
    """Flows that are live at a time, from the packets up to it."""
    flows = flow_table(packets.where(F.col("ts_us") <= now_us))
    newest = F.max("flow_no").over(Window.partitionBy(*KEY))
    return flows.withColumn("newest", newest).where((F.col("flow_no") == F.col("newest")) & (end_us() > now_us)).drop("newest")

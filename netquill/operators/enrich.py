"""Blocklists, signature rules and address ranges joined to packets.

Lists of addresses and networks are keyed so that lookups are equality joins: an address as
its key, a network as its prefix. A lookup of addresses in networks explodes each address once
for every prefix length that the list has (at most a few dozen), never for every network.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ip import ip_key, key_prefix
from ..functions.staging import staged
from .alerts import joined

#: Cuts of a range lookup; more make smaller parts and a larger expression.
CUTS = 255


def net_prefixes(nets: DataFrame) -> DataFrame:
    """Of nets (lo, bits): (prefix, bits), each once; lo is the key of the network address."""
    return nets.select(key_prefix(F.col("lo"), F.col("bits")).alias("prefix"), F.substring("lo", 1, 1).alias("family"), "bits").distinct()


def listed_addresses(addresses: DataFrame, ips: DataFrame, nets: DataFrame) -> DataFrame:
    """Of addresses (ip, key), each once: those on the list, by address or network.

    ips has key; nets has lo (key) and bits. The prefix lengths in use are gathered in one row.
    """
    by_ip = addresses.join(ips.select("key").distinct(), "key", "left_semi")
    prefixes = net_prefixes(nets)
    lengths = prefixes.select("family", "bits").distinct().agg(F.collect_list(F.struct("family", "bits")).alias("lengths"))  # at most 33 + 129
    tried = addresses.join(F.broadcast(lengths)).withColumn("length", F.explode("lengths")).where(F.col("length.family") == F.substring("key", 1, 1))
    tried = tried.select("ip", "key", key_prefix(F.col("key"), F.col("length.bits")).alias("prefix"))
    by_net = tried.join(prefixes.select("prefix"), "prefix", "left_semi").select("ip", "key")
    return by_ip.select("ip", "key").union(by_net).distinct()


def distinct_addresses(packets: DataFrame) -> DataFrame:
    ends = packets.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).where("ip is not null").distinct()
    return ends.withColumn("key", ip_key(F.col("ip"))).where("key is not null")


def blocklist_hits(packets: DataFrame, ips: DataFrame, nets: DataFrame) -> DataFrame:
    """packets that touch a listed address, with hit (the source is tested first).

    The list is applied to the distinct addresses; packets then join those that are listed.
    """
    listed = listed_addresses(distinct_addresses(packets), ips, nets).select("ip")
    src, dst = listed.select(F.col("ip").alias("src_ip"), F.col("ip").alias("src_hit")), listed.select(F.col("ip").alias("dst_ip"), F.col("ip").alias("dst_hit"))
    out = packets.join(src, "src_ip", "left").join(dst, "dst_ip", "left")
    return out.withColumn("hit", F.coalesce("src_hit", "dst_hit")).where("hit is not null").drop("src_hit", "dst_hit")


def blocklist_misses(packets: DataFrame, ips: DataFrame, nets: DataFrame) -> DataFrame:
    """packets neither of whose addresses is listed."""
    listed = listed_addresses(distinct_addresses(packets), ips, nets).select("ip")
    return packets.join(listed.withColumnRenamed("ip", "src_ip"), "src_ip", "left_anti").join(listed.withColumnRenamed("ip", "dst_ip"), "dst_ip", "left_anti")


def blocklist_alerts(packets: DataFrame, ips: DataFrame, nets: DataFrame) -> DataFrame:
    hits = blocklist_hits(packets, ips, nets)
    return hits.select("pkt_id", "ts_us", F.lit("Critical").alias("severity"), F.lit("SuspiciousPort").alias("category"), joined("Blacklisted IP: ", F.col("hit")).alias("message"), "src_ip", "dst_ip", "src_port", "dst_port")


def listed_domains(names: DataFrame, domains: DataFrame, column: str = "domain") -> DataFrame:
    """Rows whose name is on the list; letters' case does not count, subdomains do not match."""
    return names.join(domains.select(F.lower("domain").alias("listed")).distinct(), F.lower(F.col(column)) == F.col("listed"), "left_semi")


# A few rules become one expression, without a join; any number of them a table of keys.


def rule_matches(rule: dict) -> Column:
    """rule: proto, src, src_lo, src_hi, dst, dst_lo, dst_hi, content; null means any."""
    out = F.lit(True)
    if rule.get("proto"):
        out = out & F.col("l4").eqNullSafe(rule["proto"])
    for side in ("src", "dst"):
        if rule.get(side):
            out = out & F.col(f"{side}_ip").eqNullSafe(rule[side])
        low, high = rule.get(f"{side}_lo"), rule.get(f"{side}_hi")
        if low is not None:
            out = out & F.coalesce(F.col(f"{side}_port").between(low, high), F.lit(False))
    return out


def first_rule(rules: list[dict]) -> Column:
    """A struct (sid, msg) of the first rule that matches, in file order, or null."""
    out = [F.when(rule_matches(r), F.struct(F.lit(int(r["sid"])).cast("bigint").alias("sid"), F.lit(r["msg"]).alias("msg"))) for r in rules]
    return F.coalesce(*out) if out else F.lit(None).cast("struct<sid:bigint,msg:string>")


def rule_alerts(packets: DataFrame, rules: list[dict]) -> DataFrame:
    return as_rule_alerts(packets.withColumn("rule", first_rule(rules)).where("rule is not null"))


def as_rule_alerts(hits: DataFrame) -> DataFrame:
    text = joined("[sid:", F.col("rule.sid"), "] ", F.col("rule.msg"))
    return hits.select("pkt_id", "ts_us", F.lit("Medium").alias("severity"), F.lit("SuspiciousPort").alias("category"), text.alias("message"), F.col("rule.sid").alias("sid"), "src_ip", "dst_ip", "src_port", "dst_port")


#: Columns of packets that rules look at.
HEADER = ["l4", "src_ip", "src_port", "dst_ip", "dst_port"]
#: The level of a port that does not matter; 0 to 16 are levels of a binary tree over ports.
ANY = 17


def port_nodes(low: int | None, high: int | None) -> list[tuple[int, int]]:
    """The fewest nodes (level, number) of the binary tree over ports that make up an interval; 2**level ports each."""
    if low is None or high is None:
        return [(ANY, 0)]
    out, level = [], 0
    while low <= high:
        if low & 1:
            out.append((level, low))
            low += 1
        if not high & 1 and low <= high:
            out.append((level, high))
            high -= 1
        low, high, level = low >> 1, high >> 1, level + 1
    return out


def rule_keys(rules: DataFrame) -> DataFrame:
    """Of a table of rules: (shape, key, no, sid, msg), for each shape and key the first rule in order.

    A rule's shape says which header fields it looks at and at which levels of the port tree;
    its keys are what those fields then are, one for each pair of nodes of its two intervals.
    """

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                bounds = [None if pd.isna(x) else int(x) for x in (r.src_lo, r.src_hi, r.dst_lo, r.dst_hi)]
                for a, i in port_nodes(*bounds[:2]):
                    for b, j in port_nodes(*bounds[2:]):
                        shape = (bool(r.proto), bool(r.src), bool(r.dst), a, b)
                        out.append((*shape, "|".join(map(str, (r.proto or "", r.src or "", r.dst or "", i, j))), r.no, r.sid, r.msg))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in KEYS.split(", ")])

    keys = rules.select("no", "proto", "src", "src_lo", "src_hi", "dst", "dst_lo", "dst_hi", "sid", "msg").mapInPandas(expand, KEYS)
    first = keys.groupBy(*SHAPE, "key").agg(F.min(F.struct("no", "sid", "msg")).alias("rule"))
    return first.select(*SHAPE, "key", "rule")


SHAPE = ["by_proto", "by_src", "by_dst", "src_level", "dst_level"]
KEYS = "by_proto boolean, by_src boolean, by_dst boolean, src_level int, dst_level int, key string, no bigint, sid bigint, msg string"


def first_rules(headers: DataFrame, rules: DataFrame) -> DataFrame:
    """Of headers (HEADER), each once: those that a rule matches, with rule (no, sid, msg), the first that does.

    Each header is tried once for every shape that the rules have, never for every rule.
    """
    keys = staged(rule_keys(rules), "rule_keys")
    shapes = keys.select(*SHAPE).distinct().collect()  # at most 2 * 2 * 2 * 18 * 18, and few in practice
    if not shapes:
        return headers.withColumn("rule", F.lit(None).cast(keys.schema["rule"].dataType)).where("false")
    listed = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in SHAPE]) for r in shapes])
    tried = headers.withColumn("shape", F.explode(listed)).select(*HEADER, "shape.*")

    def node(side: str) -> Column:
        level = F.col(f"{side}_level")
        return F.when(level == ANY, F.lit(0)).otherwise(F.expr(f"shiftright({side}_port, {side}_level)")).cast("string")

    parts = [F.when(F.col(f"by_{c}"), F.col(x)).otherwise(F.lit("")) for c, x in (("proto", "l4"), ("src", "src_ip"), ("dst", "dst_ip"))]
    tried = tried.withColumn("key", F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2], F.lit("|"), node("src"), F.lit("|"), node("dst")))
    hits = tried.where("key is not null").join(keys, [*SHAPE, "key"])
    return hits.groupBy(*HEADER).agg(F.min("rule").alias("rule"))


def rule_table_alerts(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """The same rows as rule_alerts, for a table of any number of rules (see sources.lists.rule_table)."""
    matched = staged(first_rules(packets.select(*HEADER).distinct(), rules), "rule_hits")
    same = [packets[c].eqNullSafe(matched[c]) for c in HEADER]
    hits = packets.join(matched, same).select(packets["*"], "rule")
    return as_rule_alerts(hits)


def cut_points(addresses: DataFrame, ranges: DataFrame, most: int) -> list[str]:
    """At most `most` keys, in order, that cut both tables into parts of about the same size; from samples by hash, half of each table."""

    def sample(keys: DataFrame) -> list[str]:
        return [r.key for r in keys.where("key is not null").orderBy(F.xxhash64("key"), "key").limit(most - most // 2).collect()]

    found = sorted({*sample(addresses.select("key")), *sample(ranges.select(F.col("lo").alias("key")))})
    step = -(-len(found) // most) if found else 1
    return found[::step]


def stretch_of(key: Column, cuts: list[str]) -> Column:
    """How many cuts are at or below a key, by a search in halves."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < cuts[middle], search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(cuts))


def range_lookup(addresses: DataFrame, ranges: DataFrame, values: list[str], most_cuts: int = CUTS) -> DataFrame:
    """addresses (ip, key) with the values of the range [lo, hi] that holds the key, or nulls.

    Ranges do not overlap. Both tables are cut at the same keys, which come from both, so parts
    are even however the addresses of a family lie. A range is listed in each part it touches, at most
    once more for each cut, and addresses and ranges of a part are merged in the order of keys.
    """
    cuts = cut_points(addresses, ranges, most_cuts)
    points = addresses.select("ip", "key", stretch_of(F.col("key"), cuts).alias("stretch"), F.lit(1).alias("kind"), *[F.lit(None).cast(ranges.schema[v].dataType).alias(v) for v in values], F.lit(None).cast("string").alias("hi"))
    touched = F.sequence(stretch_of(F.col("lo"), cuts), stretch_of(F.col("hi"), cuts))
    listed = ranges.where("substring(lo, 1, 1) = substring(hi, 1, 1) and lo <= hi").select(F.lit(None).cast("string").alias("ip"), F.col("lo").alias("key"), F.explode(touched).alias("stretch"), F.lit(0).alias("kind"), *values, "hi")
    order = Window.partitionBy("stretch").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("kind") == 0, F.struct("hi", *values)), ignorenulls=True).over(order)
    found = points.unionByName(listed).withColumn("at", at).where("kind = 1")
    return found.select("ip", "key", *[F.when(F.col("key") <= F.col("at.hi"), F.col(f"at.{v}")).alias(v) for v in values])


def located(packets: DataFrame, ranges: DataFrame, values: list[str]) -> DataFrame:
    """packets with src_<value> and dst_<value> for each value; addresses are looked up once each."""
    known = range_lookup(staged(distinct_addresses(packets), "addresses"), ranges, values)
    out = packets
    for side in ("src", "dst"):
        out = out.join(known.select(F.col("ip").alias(f"{side}_ip"), *[F.col(v).alias(f"{side}_{v}") for v in values]), f"{side}_ip", "left")
    return out

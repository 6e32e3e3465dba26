"""Blocklists, rule files and geo tables as DataFrames or driver lists."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ip import ip_key, key_of, key_range

#: A cap on the rules that become one expression; more would make plans that are slow to compile, and are a table (rule_table).
MOST_RULES = 2000
RULE = "no bigint, proto string, src string, src_lo int, src_hi int, dst string, dst_lo int, dst_hi int, sid bigint, msg string, content string"


def classified(lines: DataFrame) -> DataFrame:
    """Of lines (value): entry, kind (ip, net or domain), lo and hi (keys) and bits.

    Lines are trimmed; empty ones and those that start with # are left out. What is neither an
    address nor a network is a domain, in lower case; comments after an entry are part of it.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for line in frame["value"]:
                entry = (line or "").strip()
                if entry and not entry.startswith("#"):
                    rows.append(entry_of(entry))
            yield pd.DataFrame(rows, columns=["entry", "kind", "lo", "hi", "bits"]).astype({"bits": "Int32"})

    return lines.select("value").mapInPandas(parse, "entry string, kind string, lo string, hi string, bits int")


def entry_of(entry: str) -> tuple:
    """(entry, kind, lo, hi, bits)."""
    try:
        key = key_of(entry)
        return entry, "ip", key, key, None
    except ValueError:
        pass
    try:
        if "/" in entry and entry.rpartition("/")[2].isdigit():
            return (entry, "net", *key_range(entry))
    except ValueError:
        pass
    return entry.lower(), "domain", None, None, None


def read_blocklist(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """ips (key), nets (lo, hi, bits) and domains (domain)."""
    return blocklist(spark.read.text(path))


def blocklist(lines: DataFrame) -> dict[str, DataFrame]:
    rows = classified(lines)
    return {
        "ips": rows.where("kind = 'ip'").select(F.col("lo").alias("key")).distinct(),
        "nets": rows.where("kind = 'net'").select("lo", "hi", "bits").distinct(),
        "domains": rows.where("kind = 'domain'").select(F.col("entry").alias("domain")).distinct(),
    }


def parse_rule(line: str) -> dict | None:
    """One signature rule, or null if its header is too short.

    Only any, single addresses, ports and port ranges narrow a match; variables, networks,
    lists and negations match all. An option's value runs from the first `key:` to the next
    semicolon.
    """
    head, opened, options = line.strip().partition("(")
    words = head.split()
    if not opened or len(words) < 7:
        return None
    options = options.rstrip(")").strip()
    rule: dict = {"proto": {"tcp": "Tcp", "udp": "Udp", "icmp": "Icmp"}.get(words[1].lower())}
    for side, address, port in (("src", words[2], words[3]), ("dst", words[5], words[6])):
        try:
            rule[side] = str(ipaddress.ip_address(address))
        except ValueError:
            rule[side] = None
        low, colon, high = port.partition(":")
        bounds = [low, high if colon else low]
        good = all(re.fullmatch(r"\+?[0-9]+", b) and int(b) < 65536 for b in bounds)
        rule[f"{side}_lo"], rule[f"{side}_hi"] = (int(bounds[0]), int(bounds[1])) if good else (None, None)
    sid = option(options, "sid") or ""
    rule["sid"] = int(sid) if re.fullmatch(r"\+?[0-9]+", sid) else 0
    rule["msg"] = (option(options, "msg") or "").strip('"')
    content = option(options, "content")
    rule["content"] = None if content is None else content.strip('"')
    return rule


def option(options: str, key: str) -> str | None:
    _, found, rest = options.partition(f"{key}:")
    return rest.partition(";")[0].strip() if found else None


def parse_rules(lines: list[str]) -> list[dict]:
    """Rules in file order; lines that are empty, comments or no rules are left out."""
    lines = [x.strip() for x in lines]
    return [r for x in lines if x and not x.startswith("#") and (r := parse_rule(x))]


def read_rules(spark: SparkSession, path: str) -> list[dict]:
    """The rules of a file, on the driver: a file of over MOST_RULES lines is an error; read_rule_table takes any."""
    lines = [r.value for r in spark.read.text(path, wholetext=False).limit(MOST_RULES + 1).collect()]
    if len(lines) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} lines of rules")
    return parse_rules(lines)


def rule_table(files: DataFrame) -> DataFrame:
    """Of whole rule files (value): their rules, RULE rows, numbered in file order. A file is parsed in one task, several in the order of their names (path)."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RULE.split(", ")]
        for frame in frames:
            for number, text in zip(frame["file_no"], frame["value"], strict=True):
                lines, rows = (text or "").splitlines(), []
                for i, line in enumerate(lines):
                    if line.strip() and not line.strip().startswith("#") and (rule := parse_rule(line)):
                        rows.append([(int(number) << 32) + i, *(rule[c] for c in names[1:])])
                frame_of = pd.DataFrame(rows, columns=names)
                yield frame_of.astype({c: "Int64" for c in ("src_lo", "src_hi", "dst_lo", "dst_hi")})

    return files.select("file_no", "value").mapInPandas(parse, RULE)


def read_rule_table(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a file or folder as a table, however many they are."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return rule_table(files.withColumn("file_no", F.row_number().over(Window.orderBy("path"))))


def read_geo(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A CSV or Parquet table of (first, last, value) address ranges as (lo, hi, value)."""
    if path.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(path)
    else:
        rows = spark.read.schema(f"first string, last string, `{value}` string").csv(path, header=True)
    return rows.select(ip_key(F.col("first")).alias("lo"), ip_key(F.col("last")).alias("hi"), value).where("lo is not null and hi is not null")

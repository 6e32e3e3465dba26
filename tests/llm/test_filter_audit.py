"""The audit of filters against filters applied one after another, and against its SQL."""

import random
import re
from itertools import permutations

import duckdb
import pytest

from netquill.llm import filter_audit, queries

DOCS = "doc_id bigint, text string, source string, mask int, n int, good string, part string"
LABELS = "doc_id bigint, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(rows):
    """For each row the letters of the filters it fails."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(set(text) & set("#$%&*|")),
            "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows),
        }
        out.append({x for x, failed in tests.items() if failed})
    return out


def brute(rows, labels):
    fails, out = failures(rows), []
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    for part in {s or "" for *_, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails, strict=True) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, x in enumerate(order, 1):
                lost = [r for r in left if x in r[1]]
                redundant = sum(x in f for _, f in gone)
                left = [r for r in left if x not in r[1]]
                gone = gone + lost
                shapley[x] += len(lost)
                steps.append((part, "".join(order), step, len(left), len(lost), redundant, sum(f == {x} for _, f in own), sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], DOCS).repartition(3)
    return docs, spark.createDataFrame(labels, LABELS)


def audited(spark, rows, labels):
    df = filter_audit.audit_filters(*frames(spark, rows, labels))
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["lorem", "Ipsum", "DOLOR", "sit", "$5", "a|b", "ünï", "X"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 49, 50, 51, 80]))) for _ in range(n // 2)]
    texts += [None, "", "  ", "\n\x0b", " ".join(f"w{i}" for i in range(60)), "Aa " * 50, "x" * 19 + "X", "x" * 20 + "X"]
    rows = [(rng.choice([i, i, i, i - 1, None]), rng.choice(texts), rng.choice(["a", "b", "b", None, ""])) for i in range(n)]
    labels = [(rng.randrange(n), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)] + [(None, 1, 1), (10**6, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows, labels = made(seed)
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_edges_of_the_filters(spark):
    """Texts at the borders of A to C."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words[:49]), " ".join(words[:50]), " ".join(words[:65] + ["w0"] * 35), " ".join(words[:64] + ["w0"] * 36), "AAAAA" + "x" * 95, "AAAAAA" + "x" * 94]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    assert [sorted(f) for f in failures(rows)] == [["A"], [], [], ["B"], ["A"], ["A", "C"]]
    assert audited(spark, rows, []) == brute(rows, [])


def test_copies_and_empty_table(spark):
    rows = [(i, "same" if i % 3 else None, "s") for i in range(40)] + [(None, "same", "s"), (0, None, "t"), (0, None, "t")]
    assert audited(spark, rows, [(3, 1, 0), (3, 0, 1)]) == brute(rows, [(3, 1, 0), (3, 0, 1)])
    assert audited(spark, [], []) == []


def test_other_numbers_of_filters(spark):
    counts = spark.createDataFrame([("p", m, 1 << m, m % 2, 0) for m in range(4)], "part string, mask int, n bigint, good bigint, toxic bigint")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in filter_audit.order_report(counts, "XY").collect()}
    # Masks: 0 passes (1), X alone (2), Y alone (4), both (8).
    assert got == {("XY", 1): (5, 10, 0, 2, 2, 12), ("XY", 2): (1, 4, 8, 4, 0, 16), ("YX", 1): (3, 12, 0, 4, 1, 16), ("YX", 2): (1, 2, 8, 2, 1, 12)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    got = sorted(tuple(r) for r in queries.op13_filter_audit(spark, path).collect())
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    found = con.sql(queries.SQL["op13_filter_audit"])
    at = [found.columns.index(c) for c in COLUMNS]
    assert got and got == sorted(tuple(r[i] for i in at) for r in found.fetchall())


def test_sql_on_odd_rows(spark):
    rows, labels = made(3, 60)
    con = duckdb.connect()
    docs, marks = (f.toPandas() for f in frames(spark, rows, labels))
    docs["doc_id"] = docs["doc_id"].astype("Int64")
    con.register("documents", docs)
    con.register("labels", marks.astype("Int64"))
    found = con.sql(queries.SQL["op13_filter_audit"])
    at = [found.columns.index(c) for c in COLUMNS]
    assert sorted(tuple(r[i] for i in at) for r in found.fetchall()) == brute(rows, labels)

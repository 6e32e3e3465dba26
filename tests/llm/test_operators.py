"""Each operator against brute force, a library or held-out labels, and on odd input."""

import hashlib
import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netquill.llm import bpe, exact_dedup, language_id, mil_quality, packing, quality_rules, sharding, simhash, suffix_dedup, toxicity, training
from netquill.llm.components import connected_components
from netquill.llm.suffix_array import common_prefixes, suffix_array

SMALL = Path("/root/testdata/sf0.01")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string"
LONG = "lorem ipsum dolor sit amet " * 800


def table(spark, texts, sources=None, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None if n % 5 == 0 else "en", (sources or ["a"] * len(texts))[n], None, "x", "y") for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD = [None, "", " \t\n", "x", "x", LONG, LONG, LONG + "!", "ünï cödé", "a" * 3000, "same text here", "same  text here"]


@pytest.fixture
def odd(spark):
    return table(spark, ODD, ids=[None, 1, 2, 3, 3, 5, 6, 7, 8, None, 10, 11])


@pytest.fixture
def empty(spark):
    return table(spark, [])


# 1: suffix arrays


def test_suffix_array():
    rng = np.random.default_rng(1)
    for t in range(300):
        s = rng.integers(1, rng.integers(2, 6), int(rng.integers(0, 150)))
        s = np.tile(s[: max(1, len(s) // 5)], 6) if t % 3 == 0 else np.repeat(s, rng.integers(1, 9)) if t % 3 == 1 else s
        s = np.append(s, 0).astype(np.uint16)
        listed = s.tolist()
        sa = suffix_array(s, 8)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i, listed=listed: listed[i:])
        for r, n in enumerate(common_prefixes(s, sa).tolist()):
            if r:
                a, b = listed[sa[r - 1] :], listed[sa[r] :]
                assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1]


def brute_removal(texts, width=400, least_words=0):
    seen = {}
    for t in texts:
        for a in range(len(t) - width + 1):
            seen[t[a : a + width]] = seen.get(t[a : a + width], 0) + 1
    out = []
    for t in texts:
        cut = bytearray(len(t))
        for a in range(len(t) - width + 1):
            if seen[t[a : a + width]] > 1:
                cut[a : a + width] = b"\1" * width
        for a in range(len(t)):
            if cut[a] and not (a and cut[a - 1]):
                b = (cut + b"\0").index(0, a)
                if len(t[a:b].split()) < least_words:
                    cut[a:b] = bytes(b - a)
        kept = bytes(c for c, x in zip(t, cut, strict=True) if not x)
        out.append((len(t), sum(cut), sum(x and not (i and cut[i - 1]) for i, x in enumerate(cut)), kept))
    return out


@pytest.mark.parametrize("crowd", [3, 8192])
def test_suffix_dedup(spark, crowd):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [word(n) for n in (399, 400, 450, 900, 2500)]
    texts = [word(rng.randint(0, 700)) + rng.choice(passages) + word(rng.randint(0, 300)) for _ in range(40)]
    texts += [None, "", "a" * 399, "a" * 400, "b" * 401, "xyz" * 700, passages[3], passages[3], word(600)]
    docs = table(spark, texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept_bytes)) for r in suffix_dedup.remove_repeats(docs, ["doc_id"], crowd=crowd).collect()}
    want = dict(enumerate(brute_removal([(t or "").encode() for t in texts])))
    assert got == want


@pytest.mark.parametrize(("width", "least_words"), [(200, 51), (200, 0), (16, 0)])
def test_suffix_dedup_of_passages(spark, width, least_words):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (40, 49, 51, 55, 70, 120)] + ["z" * 300]
    texts = [" ".join([prose(rng.randint(0, 60)), passages[i % len(passages)], prose(rng.randint(0, 60))]) for i in range(30)]
    texts += [None, "", "x " * 40, "x " * 90, "x " * 200, passages[3]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept_bytes)) for r in suffix_dedup.remove_repeats(table(spark, texts), ["doc_id"], width=width, least_words=least_words).collect()}
    want = dict(enumerate(brute_removal([(t or "").encode() for t in texts], width, least_words)))
    assert got == want
    if least_words:
        assert {i % len(passages) for i in range(30) if want[i][1]} == {2, 3, 4, 5}


def test_suffix_dedup_across_parts(spark):
    rng = random.Random(15)
    part = suffix_dedup.size_of(400).part
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = word(900)
    texts = [word(part - 450) + shared + word(part) + shared[100:] + word(50), word(80) + shared + word(30), word(part + 399)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept_bytes)) for r in suffix_dedup.remove_repeats(table(spark, texts), ["doc_id"]).collect()}
    assert got == dict(enumerate(brute_removal([t.encode() for t in texts])))


def test_suffix_dedup_odd(odd, empty):
    rows = suffix_dedup.remove_repeats(odd, odd.columns).collect()
    assert len(rows) == len(ODD) and all(r.score == "x" for r in rows)
    assert sum(r.n_removed == r.n_bytes > 0 for r in rows) == 3
    assert suffix_dedup.remove_repeats(empty, ["doc_id"]).count() == 0


def test_suffix_dedup_of_repeated_rows(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = word(700)
    copied, unnamed = word(900) + shared + word(900), word(500) + shared[:600] + word(800)
    cut, joined = suffix_dedup.cut_examples, []
    monkeypatch.setattr(suffix_dedup, "cut_examples", lambda wanted, width: joined.append(wanted) or cut(wanted, width))

    def spans(n):
        texts = [copied] * n + [unnamed] * n + [word(300) + shared[50:] + word(20)]
        docs = table(spark, texts, ids=[7] * n + [None] * n + [8])
        got = sorted((r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept_bytes)) for r in suffix_dedup.remove_repeats(docs, ["doc_id"]).collect())
        assert got == sorted(brute_removal([t.encode() for t in texts]))
        return sorted(len(r.spans) for r in suffix_dedup.repeated_spans(docs).collect())

    few, many = spans(2), spans(40)
    assert len(few) == len(many) == 3 and max(many) <= max(few)  # a key's list is bounded by its own text
    assert all(j.count() == j.select("id0", "id1").distinct().count() for j in joined) and joined[-1].count() > 1


# Columns of any name


CLASHING = ["nq_spans", "nq_group", "nq_best", "nq_index_sha", "keep_row", "nq_c0", "id0", "fp", "row", "sha", "packed", "spans", "Kept_Text", "a.b", "a b`c"]


@pytest.mark.parametrize("rows", [0, 6])
@pytest.mark.parametrize("name", ["suffix", "sharding", "rules", "quality", "language", "exact", "exact_dedup", "toxicity", "bpe", "packing", "near", "near_dedup"])
def test_columns_of_any_name(spark, name, rows):
    texts = ["one two three four", "one  two three four", "", None, "x" * 900, "x" * 900][:rows]
    docs = table(spark, texts).select("doc_id", "text", "lang", "source", *[F.lit(f"own {i}").alias(c) for i, c in enumerate(CLASHING)])
    labels = spark.createDataFrame([(0, 1), (4, 0)], "doc_id bigint, label int")
    passed = True
    if name == "suffix":
        got, lost = suffix_dedup.remove_repeats(docs, docs.columns), {"spans", "Kept_Text"}
    elif name == "quality":
        got, lost = mil_quality.score_quality(docs, mil_quality.fit_quality(docs, labels), docs.columns), set()
    elif name == "language":
        got, lost = language_id.identify(docs, language_id.fit_languages(docs, docs), docs.columns), set()
    elif name == "toxicity":
        got, lost = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels), docs.columns), set()
    elif name in ("exact", "near"):
        got, lost = (exact_dedup.exact_groups if name == "exact" else simhash.near_groups)(docs), set()
    elif name in ("exact_dedup", "near_dedup"):
        got, lost = (exact_dedup.exact_dedup if name == "exact_dedup" else simhash.near_dedup)(docs), set()
        assert got.columns == docs.columns
    elif name == "bpe":
        public = pytest.importorskip("public_tokenizers")
        got, lost = bpe.encode_decode(docs, public.path("word_bpe_49k.json"), keep=docs.columns), set()
    else:
        work = {"sharding": lambda: sharding.assign_shards(docs, 3), "rules": lambda: quality_rules.apply_rules(docs, labels.withColumnRenamed("label", "quality")), "packing": lambda: packing.pack(docs)}
        got, lost, passed = work[name](), set(), False
    found = got.collect()
    assert len(found) == {"exact_dedup": rows // 2, "near_dedup": rows and 3}.get(name, rows)
    if passed:
        own = {c: f"own {i}" for i, c in enumerate(CLASHING) if c not in lost}
        assert all(r[c] == value for r in found for c, value in own.items())


# 2: sharding


def test_sharding(spark):
    docs = table(spark, [f"text {i % 50}" for i in range(997)], ["hot"] * 600 + [None] * 7 + [f"s{i % 9}" for i in range(390)])
    rows = sharding.assign_shards(docs, 40).collect()
    shards = [[r for r in rows if r.shard == s] for s in range(40)]
    assert {len(s) for s in shards} == {24, 25}
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards)
    assert all(14 <= sum(r.source == "hot" for r in s) <= 16 for s in shards)
    assert all(r.text_crc32 == zlib.crc32(f"text {r.doc_id % 50}".encode()) for r in rows)
    again = sharding.assign_shards(docs.repartition(7), 40).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_sharding_of_small_sources(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_BUCKET", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.createDataFrame([(f"+s{i:04}", i * 7919 % 1000) for i in range(1000)], "stratum string, shuffle_key bigint").repartition(3)
        got = sharding.interleaved(rows, "stratum", ["shuffle_key"], 1000).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.stratum for r in sorted(got, key=lambda r: r.position)] == [f"+s{i:04}" for i in range(1000)]
    assert sorted(r.position for r in got) == list(range(1000))
    assert len({r.task for r in got}) > 1  # all have the same fractional rank


def test_sharding_odd(odd, empty):
    rows = sharding.assign_shards(odd, 5).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(5) for i in range(3 if s < 2 else 2)]
    assert min(r.size for r in rows) == 16
    assert sharding.assign_shards(empty).count() == 0


# 3: quality rules


def test_measures_and_tail(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a b c dd #x |".split()) for _ in range(rng.randint(0, 40))) + rng.choice(["", "\nl\nl\n \nl"]) for _ in range(150)] + [None, ""]
    for r in quality_rules.measured(table(spark, texts)).collect():
        text = texts[r.doc_id] or ""
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        keys = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {j for i, k in enumerate(keys) if keys.count(k) > 1 for j in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)))
    from math import comb

    cases = [(k, n, p) for n in (1, 20, 300) for k in (0, 1, 3) for p in (0.01, 0.2) if k <= n]
    for k, n, p in cases:
        exact = 1.0 if k > n * p else sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        assert got == pytest.approx(exact, rel=1e-9)


def labelled_texts(spark, folder, sizes):
    """Every fourth text is bad and has symbols; labels for two of three texts."""
    rng, rows = random.Random(3), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    for lang, n in sizes.items():
        rows += [(len(rows) + i, " ".join(word() + ("###" if i % 4 == 0 or rng.random() < 0.002 else "") for _ in range(30)), lang) for i in range(n)]
    labels = [(i, int(text.count("#") < 30)) for i, text, _ in rows if i % 3]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    return {i: (text, lang) for i, text, lang in rows}


def test_rules_keep_risk(spark, tmp_path):
    texts = labelled_texts(spark, tmp_path, {"en": 2400, "de": 300, "fr": 120, "xx": 12})
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.apply_rules(docs, labels).collect()
    for lang in ("en", "de", "fr"):
        fresh = [r for r in rows if r.doc_id % 3 == 0 and texts[r.doc_id][1] == lang]
        good, bad = ([r for r in fresh if (texts[r.doc_id][0].count("#") < 30) == g] for g in (True, False))
        assert sum(not r.kept for r in good) <= quality_rules.RISK * len(good) and bad and not any(r.kept for r in bad)
    assert all(r.kept for r in rows if texts[r.doc_id][1] == "xx")  # too few labels
    assert all(r.kept for r in quality_rules.apply_rules(docs, labels.limit(0)).collect())
    same_as_sql(rows, str(tmp_path))


def same_as_sql(rows, folder):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        at = Path(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/*.parquet'" if at.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{at}'")
    found = con.sql(quality_rules.rules_sql())
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r[c] for c in found.columns)) for r in rows)


@pytest.mark.skipif(not SMALL.exists(), reason="needs the driver's tables")
def test_rules_reject_in_several_languages(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.apply_rules(docs, labels).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len({lang[r.doc_id] for r in rows if not r.kept and not r.base_failed}) >= 2
    same_as_sql(rows, str(SMALL))


def test_holm_levels(spark):
    """Cut steps against Holm's procedure written out."""
    from math import comb

    rng = random.Random(16)
    tail = lambda k, n: sum(comb(n, i) * 0.1**i * 0.9 ** (n - i) for i in range(k + 1))
    for _ in range(4):
        rows, firsts = [], {}
        for stratum in range(5):
            for _ in range(rng.choice([10, 25, 40, 60, 200])):
                label, first = int(rng.random() < 0.7), rng.choice([None] * 12 + list(quality_rules.STEPS)) if rng.random() < 0.5 else None
                first = first if label else rng.choice(quality_rules.STEPS)
                rows.append((len(rows), str(stratum), label, 0 if first is None else int(1000 * quality_rules.RULES["symbols"][1][first]) + 1))
                firsts.setdefault(str(stratum), []).append((label, first))
        table = spark.createDataFrame([(i, s, 1000, n, 0, 0, 0, 1, 0, False) for i, s, _, n in rows], "doc_id bigint, stratum string, n_words bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, word_chars bigint, n_lines bigint, n_capitals bigint, base_failed boolean")
        labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows], "doc_id bigint, quality int")
        got = {r.stratum: r.cut_step for r in quality_rules.cutoffs(table, labels).collect()}
        p = {}
        for s, texts in firsts.items():
            n = sum(y for y, _ in texts)
            p[s] = [tail(k, n) if (k := sum(y and f is not None and f <= i for y, f in texts)) <= n * 0.1 else 1 for i in quality_rules.STEPS]
        waiting = sorted(p, key=lambda s: (p[s][-1], s))
        while waiting and p[waiting[0]][-1] <= 0.05 / len(waiting):
            waiting.pop(0)
        want = {}
        for s, texts in firsts.items():
            share = lambda v, i, texts=texts: sum(y == v and f is not None and f <= i for y, f in texts) / max(1, sum(y == v for y, _ in texts))
            able = [i for i in quality_rules.STEPS if (s not in waiting or p[s][i] <= 0.05 / len(waiting)) and share(0, i) > share(1, i)]
            if able:
                want[s] = max(able, key=lambda i: (round(share(0, i) - share(1, i), 12), -i))
        assert got == want


def test_rules_odd(spark, odd, empty):
    labels = spark.createDataFrame([(None, 1), (1, None), (3, 1), (3, 0)], "doc_id bigint, quality int")
    rows = quality_rules.apply_rules(odd, labels).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows if r.n_words < 10)
    assert quality_rules.apply_rules(empty, labels).count() == 0


# 4, 5, 7: learned models


def test_quality_classifier(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "sea", "stone", "walks", "over", "green"]) + rng.choice(["", ",", "."]) for _ in range(rng.randint(20, 200)))
    texts = [good() if i % 3 else good()[:100] + " BUY!! $$$ ### " * 30 + good() for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id bigint, label int")
    docs = table(spark, texts)
    rows = mil_quality.score_quality(docs, mil_quality.fit_quality(docs.select("doc_id", "text"), labels), ["doc_id"]).collect()
    held = [r for r in rows if r.doc_id >= 300]
    assert sum((r.score >= 0.3) == (r.doc_id % 3 > 0) for r in held) >= 97


def test_attention_gradients():
    rng = np.random.default_rng(0)
    p, x = mil_quality.start(rng), rng.normal(size=(9, mil_quality.MEASURES))
    bag, y = np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1, 0, 1, 0.0])
    loss = lambda p: -np.mean(np.log(np.where(y == 1, s := mil_quality.forward(p, x, bag, 4)[0], 1 - s)))
    for k, g in mil_quality.gradients(p, x, bag, y).items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert g[i] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-8)


def test_languages():
    rng = random.Random(6)
    sounds = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ver", "ß"], "cc": ["ción", "ñe", "oso", "ll"]}
    make = lambda y: " ".join("".join(rng.choice(sounds[y]) for _ in range(3)) for _ in range(rng.randint(3, 60))).encode()
    sample = [(make(y), y) for y in list(sounds) * 60]
    model = language_id.train(sample, 60)
    names, scores = language_id.predict([make(y) for y in list(sounds) * 30] + [b"", b"123 !!", b"\n"], *model)
    assert sum(a == b for a, b in zip(names, list(sounds) * 30, strict=False)) >= 88
    assert names[-3:] == ["und"] * 3 and all(0 <= s <= 1 for s in scores)
    assert language_id.predict([b"text"], *language_id.train([]))[0] == ["und"]


def test_toxicity():
    rng = random.Random(7)
    make = lambda bad: " ".join(["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)] + ["grumplefoot"] * bad).encode()
    model = toxicity.train([(make(i % 4 == 0), int(i % 4 == 0)) for i in range(300)])
    got = toxicity.scores([make(i % 2) for i in range(60)] + [b"", b" "], *model)
    assert all((s >= 0.3) == (i % 2 == 1) for i, s in enumerate(got[:60])) and got[60] < 0.3
    assert toxicity.scores([b"x"], *toxicity.train([]))[0] == 0.5


def test_sample_of_any_length(spark):
    texts = [f"text {i} " * (20_000 if i % 10 == 0 else 3) for i in range(60)] + [None, "w" * 900_000, "twice", "twice, longer"]
    docs = table(spark, texts, ids=[*range(62), 70, 70]).select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(62), 70, 99]], "doc_id bigint, label int")
    every = training.sample_texts(docs, labels)
    assert sorted(every) == sorted([((t or "").encode(), i % 2) for i, t in enumerate(texts[:62])] + [(b"twice, longer", 0)])
    some = training.sample_texts(docs, labels, most_bytes=800_000)
    assert 0 < len(some) < 63 and sum(len(t) for t, _ in some) <= 800_000 and set(some) < set(every) and any(len(t) > 100_000 for t, _ in some)
    assert len(training.sample_texts(docs, labels, rows=5)) <= 5
    assert training.sample_texts(docs.limit(0), labels) == training.sample_texts(docs, labels.limit(0)) == []


@pytest.mark.parametrize("kind", ["quality", "language", "toxic"])
def test_models_odd(spark, odd, empty, kind):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1)], "doc_id bigint, label int")
    for docs in (odd, empty):
        if kind == "quality":
            got = mil_quality.score_quality(docs, mil_quality.fit_quality(docs, labels), docs.columns, name="q").select(F.col("q").alias("s"))
        elif kind == "toxic":
            got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels), ["doc_id"]).select(F.col("score").alias("s"))
        else:
            got = language_id.identify(docs, language_id.fit_languages(docs, docs.select("doc_id", "lang")), ["doc_id"]).select(F.col("score").alias("s"))
        rows = got.collect()
        assert len(rows) == docs.count() and all(0 <= r.s <= 1 for r in rows)


# 6: exact duplicates


@pytest.mark.parametrize(("bits", "most_bytes"), [(3, 64 << 20), (64, 64 << 20), (64, 100), (3, 100)])
def test_exact_dedup(spark, bits, most_bytes):
    rng = random.Random(8)
    texts = ["hot   text" if rng.random() < 0.4 else rng.choice(["a b", "ab", " ab ", "c", "", "d\n"]) + str(rng.randint(0, 99)) * rng.randint(0, 2) for _ in range(700)]
    texts = [t if i % 9 else None for i, t in enumerate(texts)]
    rows = exact_dedup.exact_groups(table(spark, texts), digest_bits=bits, most_bytes=most_bytes).collect()
    groups = {}
    for i, t in enumerate(texts):
        plain = (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
        groups.setdefault(plain, []).append((-len(t or ""), i))
    for plain, members in groups.items():
        for _, i in members:
            r = next(r for r in rows if r.doc_id == i)
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(members)[1], len(members), i == min(members)[1], hashlib.sha256(plain.encode()).hexdigest())


def test_exact_dedup_odd(odd, empty):
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns and sorted("".join((r.text or "").split())[:9] for r in kept.collect()) == sorted(["", "x", "loremipsu", "loremipsu", "ünïcödé", "a" * 9, "sametexth"])
    assert all(r.kept == "y" for r in kept.collect())
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_index_runs():
    index = exact_dedup.DigestIndex()
    for i in range(30_000):
        index.add(i % 9000 - 4500, b"t%d" % (i % 18_000), (-1, False, -i, 0), 1, i)
    stored = sum(len(r.entries) for r in index.runs) + index.held
    assert stored > 18_000 and index.bytes == sum(len(b"t%d" % i) for i in range(18_000))  # runs hold texts again, which share their bytes
    entries = list(index.entries())
    assert len(entries) == 18_000 and sum(e[3] for e in entries) == 30_000 and len(index.runs) <= exact_dedup.MOST_RUNS + 1
    assert all(e[2] == (-1, False, -e[4], 0) for e in entries)


def test_same_bytes_packed_differently():
    import zstandard

    text = b"the same text " * 50
    a, b = (zstandard.ZstdCompressor(level=n, write_content_size=True).compress(text) for n in (1, 19))
    b = b if a != b else zstandard.ZstdCompressor(level=1, write_checksum=True).compress(text)
    rows = [[5, a, (-1, False, 7, 0), 2, None], [5, b, (-1, False, 3, 0), 1, None], [5, zstandard.compress(b"other"), (-1, False, 1, 0), 1, None]]
    found = list(exact_dedup.compacted(rows, exact_dedup.same_text()))
    assert a != b and [(e[2][2], e[3]) for e in found] == [(3, 3), (1, 1)]


# 8: tokens


def test_bpe(spark, odd):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rng = random.Random(9)
    pool = [*"abcXYZ  \t\n\r\x85\xa0　'stredvmll0123²ΣςİßéÅ가漢😀👍🏽́‍_-!?.", "<|endoftext|>", "don't", "<|"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(600)] + ODD
    ids = [None] * len(texts)
    got = bpe.encode_decode(table(spark, texts, ids=range(len(texts))), path, keep=["doc_id"]).collect()
    assert ids is not None and len(got) == len(texts)
    for r in got:
        want = own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == want
        assert r.decoded == own.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(odd, path).count() == len(ODD)


# 9: packing


def brute_fit(pieces, capacity, most):
    bins, out = [], []
    for units, source, cluster in pieces:
        fits = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins) if sum(x[1] == source for x in b) < most and (cluster is None or all(x[2] != cluster for x in b))]
        room, i = min((f for f in fits if f[0] >= units), default=(0, len(bins)))
        if i == len(bins):
            bins.append([])
        bins[i].append((units, source, cluster))
        out.append(i)
    return out


def test_best_fit():
    rng = random.Random(10)
    for _ in range(200):
        capacity, most = rng.choice([7, 16, 31, 100]), rng.choice([1, 2, 3])
        pieces = [(rng.randint(1, capacity), rng.choice("aaaabc"), rng.choice([None, 1, 1, 1, 2, 3])) for _ in range(rng.randint(0, 90))]
        assert packing.best_fit(pieces, capacity, most) == brute_fit(pieces, capacity, most)


def test_packing(spark, odd, empty):
    rows = packing.pack(odd, capacity=1000, pieces_a_group=8).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.bin_start)
        assert sum(r.units for r in b) == b[0].bin_units <= 1000
        assert [r.bin_start for r in b] == [sum(x.units for x in b[:i]) for i in range(len(b))]
    sizes = sorted(len((t or "").encode()) + 1 for t in ODD)
    assert sum(r.units for r in rows) == sum(sizes) and sum(r.piece == 0 for r in rows) == len(ODD)
    assert packing.pack(empty).count() == 0


# 10: near-duplicates


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split() if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_near_groups(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(12)]
    texts = []
    for _ in range(150):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(200)] = "NEW"
        texts.append(" ".join(own))
    texts += [None, "", " ", "one", "One", "a b", LONG]
    rows = {r.doc_id: r for r in simhash.near_groups(table(spark, texts), keep=["doc_id"]).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(parent, i), root(parent, j)))
                parent[b] = a
    assert [(rows[i].fingerprint, rows[i].component_id) for i in range(len(texts))] == [(f"{prints[i]:016x}", root(parent, i)) for i in range(len(texts))]
    assert sum(r.stays for r in rows.values()) == len({root(parent, i) for i in range(len(texts))})


def root(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i


def test_crowds_link_alike(spark, monkeypatch):
    rng = np.random.default_rng(3)
    prints = {0x123456789ABCDEF0 ^ int(sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 5), replace=False))) for _ in range(500)}
    arr = np.array(sorted(prints), np.uint64)
    masks = np.concatenate([simhash.flips(j) for j in range(4)])
    keys = ((arr[:, None] & np.repeat(~simhash.BLOCKS, 49)) ^ masks) | np.repeat(simhash.TAGS, 49)
    order = np.argsort(keys.ravel(), kind="stable")
    keys, fps = keys.ravel()[order], np.repeat(arr, len(masks))[order]
    all_pairs = simhash.few_links(keys, fps)
    cuts = [0, *(np.flatnonzero(np.diff(keys.view(np.int64))) + 1).tolist(), len(keys)]
    crowd = [x for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 12 for x in simhash.crowd_links(int(keys[a]), fps[a:b])]
    pairs = {frozenset(p) for a, b in all_pairs for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert pairs == {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    for a, b in crowd:
        assert (np.bitwise_count(a ^ b) <= 3).all()


def test_components(spark):
    rng = random.Random(12)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)] + [(200, i) for i in range(201, 260)] + [(7, 7), (1, 0)]
    parent = {x: x for e in links for x in e}
    for a, b in links:
        ra, rb = sorted((dict_root(parent, a), dict_root(parent, b)))
        parent[rb] = ra
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: dict_root(parent, x) for x in touched}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def dict_root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_near_odd(odd, empty):
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    clash = simhash.near_dedup(odd.withColumnRenamed("score", "stays")).collect()
    assert len(clash) == 6 and all(r.stays == "x" for r in clash)
    assert simhash.near_dedup(empty).count() == 0

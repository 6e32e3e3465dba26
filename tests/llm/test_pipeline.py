"""The pipeline's stages on planted cases, each held against brute force on its own input."""

import random

from test_operators import plain_fingerprint, root
from test_passages import without_passages

import corpus_pipeline
from netquill.llm._common import staged

WORDS = "the sea stone walks over green hill and then it rains for days while boats wait near old walls".split()


def corpus(rng):
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) + rng.choice(["", "", ",", "."]) for _ in range(n))
    shared = prose(120)
    texts = [prose(rng.randint(40, 150)) for _ in range(40)]
    texts += [prose(60) + " " + shared + " " + prose(60) for _ in range(6)]
    texts += [texts[0], texts[0] + "  ", texts[1].replace(" ", "\n"), texts[2].upper(), None, ""]
    texts += ["BUY!! $$$ ### | | | " * rng.randint(20, 60) for _ in range(25)]
    return texts


def test_stages(spark, tmp_path):
    texts = corpus(random.Random(13))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(not (t or "").startswith("BUY"))) for i, t in enumerate(texts) if t]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, steps = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = staged(stage(spark, docs, str(tmp_path)), name)
        steps[name] = (before, docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    _, kept = steps["quality_classifier"]
    assert {r.doc_id for r in kept} >= {i for i, t in enumerate(texts) if t and not t.startswith("BUY")} and not any((r.text or "").startswith("BUY") for r in kept)

    before, kept = steps["exact_dedup"]
    groups = {}
    for r in before.values():
        groups.setdefault("".join((r.text or "").split()), []).append((-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in kept} == {min(g)[1] for g in groups.values()}

    before, kept = steps["simhash"]
    ids = sorted(before)
    prints, parent = [plain_fingerprint(before[i].text) for i in ids], list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(parent, i), root(parent, j)))
                parent[b] = a
    assert {r.doc_id for r in kept} == {ids[root(parent, i)] for i in range(len(ids))} and len(kept) < len(ids)

    before, kept = steps["suffix_dedup"]
    ids = sorted(before)
    want = dict(zip(ids, without_passages([before[i].text or "" for i in ids], corpus_pipeline.LEAST_WORDS), strict=True))
    assert {r.doc_id: r.text for r in kept} == want and any(want[i] != (before[i].text or "") for i in ids)
    assert all(r.n_chars == len(r.text) for r in kept)

    before, pieces = steps["packing"]
    assert sum(r.units for r in pieces) == sum(len((r.text or "").encode()) + 1 for r in before.values())


def test_run_has_all_rows(spark, tmp_path):
    texts = corpus(random.Random(14))
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()  # without labels nothing is rejected
    assert sum(r.piece == 0 for r in rows) >= 40

"""The pipeline's stages on the smallest tables, each on what the one before it kept."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
entry_point = pytest.importorskip("__spark_entry__")

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages(spark, tmp_path):
    docs = source = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packed":
            assert docs.columns == source.columns
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in kept.items()}
    total = source.count()
    assert len(ids["language"]) >= 0.97 * total
    texts = {r.doc_id: r.text for r in kept["language"].collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    linked = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    stay = sorted(ids["near_duplicates"])
    assert not any(linked(a, b) for k, a in enumerate(stay) for b in stay[:k])
    assert all(any(linked(a, b) for b in texts if b != a) for a in set(texts) - set(stay))
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in texts[i] for i in ids["decontamination"] for b in bench)
    assert ids["decontamination"] == ids["personal_data"] == ids["packed"]
    redacted = {r.doc_id: r.text for r in kept["personal_data"].collect()}
    assert not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", t) for t in redacted.values())
    assert any("[EMAIL]" in t or "[IP]" in t or "[CARD]" in t or "[PHONE]" in t for t in redacted.values())


def test_registered():
    names = entry_point.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names

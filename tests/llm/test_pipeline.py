"""Each stage on the small table, against what its operator says of the stage's own input."""

import re

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as C
from flowloom.llm import decontaminate, secrets, simhash, similar
from flowloom.llm.common import written


def test_stages(spark, sf_dir, documents, pairs):
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    kept = [documents]
    for name, stage in C.STAGES:
        kept.append(written(stage(spark, kept[-1], sf_dir), name))
    raw, good, distinct, clean, safe, packed = kept
    for df in (good, distinct, clean, safe):
        assert df.columns == documents.columns
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    right = labels.filter("quality = 1 AND toxic = 0").join(good, "doc_id", "left_semi").count()
    assert right > 0.9 * labels.filter("quality = 1 AND toxic = 0").count()
    texts = {d: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for d, t in pairs(good, "doc_id", "text")}
    grams = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in texts.items()}
    alike = lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    pairs_ = [(a, b) for a in grams for b in grams if a < b and alike(a, b)]
    gone = ids(good) - ids(distinct)
    # Whatever goes has a near duplicate of a smaller id, and of each pair one goes.
    assert gone <= {b for _, b in pairs_}
    assert not any(a not in gone and b not in gone for a, b in pairs_)
    items = pairs(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    assert ids(clean) == {r[0] for r in decontaminate.by_brute_force(pairs(distinct, "doc_id", "text"), items) if not r[5]}
    assert ids(safe) == ids(clean)
    live = {v for r in secrets.scan(clean).collect() for v in r.live}
    assert not any(v in r.text for r in safe.collect() for v in live)
    assert ids(packed) == ids(safe) and packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_stages_of_nothing(spark, sf_dir, nothing):
    docs = nothing
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_near_duplicates_meet_by_fingerprints(spark, monkeypatch):
    """Without any prefix: near copies go by their fingerprints, unlike documents of one fingerprint stay."""
    line = " ".join(f"b{i}" for i in range(11)) + " "
    page = lambda i: line * 200 + " ".join(f"d{i}w{j}" for j in range(100))
    long = " ".join(f"c{j}" for j in range(4000))
    rows = [(0, page(0)), (1, page(1)), (2, page(2)), (3, long), (4, long + " end"), (5, " ".join(f"e{j}" for j in range(300))), (6, None)]
    fps = [simhash.fingerprint((t or "").encode(), 5) for _, t in rows]
    assert fps[0] == fps[1] == fps[2] and fps[3] != fps[4] and (fps[3] ^ fps[4]).bit_count() <= 2
    prefixes = similar.prefixes
    monkeypatch.setattr(similar, "prefixes", lambda *args: prefixes(*args).filter("false"))
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in C.distinct(spark, df, "").collect()) == [0, 1, 2, 3, 5, 6]

"""The pipeline's stages, one after the other, each judged on its own input."""

import corpus_pipeline
from tarnlight.llm import decontaminate, mixing, secrets, simhash
from tarnlight.scratch import materialize

SF = "/root/testdata/sf0.01"


def test_stages_take_effect_and_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "simhash_near_dedup", "decontamination", "secret_scan", "source_mixture"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        kept[name] = (before, docs)
        if name != "source_mixture":
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = kept["toxicity"]
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    gone = ids(before) - ids(after)
    assert len(gone & clean) <= 0.1 * len(clean)
    assert len(gone & toxic) >= 0.5 * len(toxic)
    before, after = kept["simhash_near_dedup"]
    assert ids(after) == {r.component_id for r in simhash.near_duplicates(before).collect()}
    assert after.count() == len(ids(after))
    before, after = kept["decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = ids(decontaminate.contamination(before, bench).where("match.n_hit > 0"))
    assert ids(after) == ids(before) - hit
    before, after = kept["secret_scan"]
    assert ids(after) == ids(before)
    found = after.select(secrets.base_spans(after.text).alias("s"))
    assert found.where("size(s) > 0").count() == 0
    before, after = kept["source_mixture"]
    assert ids(after) <= ids(before)
    assert after.agg({"epoch": "max"}).first()[0] < mixing.PRODUCTION.max_epochs


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "empty")
    assert docs.count() == 0


def test_nulls_repeats_and_very_long_texts(spark):
    """All stages on odd rows: each ends, equal texts fare alike, and what is neither toxic nor repeated stays until the mixture."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0"), "doc_id").where("n_chars > 500").orderBy("doc_id").first()
    long = " ".join(f"w{k}" for k in range(200_000))
    odd = [(-1, None, "en", "src1", None), (-2, "", None, None, 0), (-3, " \n\t ", "en", "src1", 3), (-4, long, "de", "src2", len(long)), (None, clean.text, "fr", "odd", 23), (-5, "key token = abcdef123456", "en", "src3", 24)]
    # one text with and without a doc_id: whatever the network says of it, both rows fare alike
    odd += [(None, "a text without a number", "fr", "nowhere", 23), (-6, "a text without a number", "fr", "nowhere", 23)]
    more = spark.createDataFrame(odd + odd[3:], docs.schema)
    table = docs.unionByName(more)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        table = materialize(stage(spark, table, SF), name)
        kept[name] = table.where("doc_id < 0 or doc_id is null").collect()
    count = lambda name, i: sum(r.doc_id == i for r in kept[name])
    assert [count("toxicity", i) for i in (-1, -2, -3, -4, -5)] == [1, 1, 1, 2, 2]
    assert count("toxicity", None) - count("toxicity", -6) == 2  # the clean text's two rows
    assert count("simhash_near_dedup", -4) >= 1 and count("decontamination", -4) == count("simhash_near_dedup", -4) == count("secret_scan", -4)
    assert next(r.text for r in kept["secret_scan"] if r.doc_id == -4) == long
    masked = [r for r in kept["secret_scan"] if r.doc_id == -5]
    assert masked and all("abcdef123456" not in r.text and r.n_chars == len(r.text) for r in masked)

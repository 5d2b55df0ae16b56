"""The pipeline's stages, one by one and as a whole."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from chronolane.llm import common, packing

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, DATA, "documents")
    label = {r["doc_id"]: r["quality"] for r in common.table(spark, DATA, "labels").collect()}
    columns, kept = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        out = {r["doc_id"]: r for r in docs.collect()}
        assert set(out) <= set(kept)
        if name == "quality_classifier":
            gone = set(kept) - set(out)
            assert sum(label.get(i) == 0 for i in gone) > 0 and not any(label.get(i) == 1 for i in gone)
        if name == "simhash_near_dedup":
            texts = [r["text"] for r in out.values()]
            assert len(texts) == len(set(texts))
        kept = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in pieces} == set(kept)
    whole = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces)


def test_ids_need_no_memory():
    """An encoder that forgets almost at once gives the same ids, and holds no more than two generations."""
    path = packing.default_vocabulary()
    texts = [" ".join(f"w{k * k % 997}x{k}, Word{k % 7}" for k in range(n, n + 300)) for n in range(0, 3000, 150)]
    small, large = packing.Encoder(path, 50), packing.Encoder(path)
    assert [small.encode(t) for t in texts] == [large.encode(t) for t in texts]
    assert len(small) <= 50 and len(small.older) <= 50 < len(large)
    assert corpus_pipeline.MEMORY < packing.MEMORY


def test_batches_are_small(spark):
    """Every stage with Python workers hands them a few MB at once, however long the texts; batches of narrow rows stay as long as before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    docs = common.table(spark, DATA, "documents")
    long = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("word "), 2000).alias("text"))
    try:
        for stage in (s for n, s in corpus_pipeline.STAGES if n != "contextual_pii"):
            spark.conf.set(name, before)
            stage(spark, docs, DATA)
            got = long.mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(r["rows"] for r in got) == 3000
            assert max(r["bytes"] for r in got) < 1.1 * corpus_pipeline.BATCH
            assert max(r["rows"] for r in long.select("id").mapInArrow(sizes, "rows long, bytes long").collect()) == 3000
    finally:
        spark.conf.set(name, before)

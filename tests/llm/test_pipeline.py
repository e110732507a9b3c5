"""The pipeline against its stages' meaning on a small planted corpus, and on hostile rows."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The small documents with planted rows: exact and near copies, a benchmark passage, null, empty and very long texts."""
    folder = tmp_path_factory.mktemp("corpus")
    docs, item = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()
    words = [f"plain{i}" for i in range(60)]
    near = [*words]
    near[30] = "changed"
    planted = [(900_001, " ".join(words)), (900_002, " ".join(words)), (900_003, " ".join(near)), (900_004, f"{' '.join(words[:9])} {item.text} end"), (900_005, None), (900_006, ""), (900_007, " ".join(f"w{i}" for i in range(40_000)))]
    more = spark.createDataFrame([(i, t, "en", "planted", 0) for i, t in planted], "doc_id long, text string, lang string, source string, n_chars long")
    more = more.select(*(more[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
    docs.unionByName(more).write.parquet(f"{folder}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return f"file://{folder}"


def test_run_is_its_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    before, kept = {r.doc_id for r in docs.collect()}, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, corpus)
        assert after.columns == docs.columns
        rows = [r.doc_id for r in after.collect()]
        kept.append(set(rows))
        docs = spark.createDataFrame(after.collect(), docs.schema)
    toxic, single, clean, mixed = kept
    assert toxic <= before and single <= toxic and clean <= single and mixed == clean
    assert {900_001, 900_005, 900_006, 900_007} <= mixed and not {900_002, 900_003} & single
    assert 900_004 in single and 900_004 not in clean
    out = corpus_pipeline.run(spark, corpus).orderBy("start").collect()
    assert {r.doc_id for r in out} == mixed
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:i]) for i in range(len(out))]
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in out)

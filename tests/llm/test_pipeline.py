import corpus_pipeline as C

from .test_neardup import brute


def test_stages_on_their_own_input(spark, sf, tmp_path):
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf)
        if i < len(C.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(docs.count())
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            stays = {d for d, _, _, own in brute(rows, 5) if own}
            assert {r.doc_id for r in docs.collect()} == stays
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    tox = spark.read.parquet(f"{tmp_path}/0")
    assert tox.join(labels.where("toxic = 0"), "doc_id").count() >= 0.95 * spark.read.parquet(f"{sf}/documents.parquet").join(labels.where("toxic = 0"), "doc_id").count()
    assert docs.agg({"length": "sum"}).first()[0] == docs.dropDuplicates(["sequence_id", "offset"]).agg({"length": "sum"}).first()[0]
    assert kept[0] > kept[1] > kept[2] > 0


def test_stages_on_nulls_repeats_clashes_and_nothing(spark, sf):
    """No stage fails; columns stay; a null or empty text is dropped by quality, equal rows end as one."""
    text = " ".join(f"plain{i} word" for i in range(60))
    rows = [(1, text, "en", "web", 1, "x"), (1, text, "en", "web", 1, "x"), (2, text + " more", None, None, None, None), (3, None, "en", "web", 0, None), (None, "", None, None, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, copies string")
    for table in (docs, docs.limit(0)):
        out = table
        for name, stage in C.STAGES:
            before, out = out, stage(spark, out, sf)
            if name != "packing":
                assert out.dtypes == docs.dtypes
            out = spark.createDataFrame(out.collect(), out.schema)
            if name == "near_duplicates":
                assert {r.doc_id for r in out.collect()} <= {1, 2, None} and out.where("doc_id = 1").count() <= 1
            assert before.count() or not out.count()

"""The document frequency covers the corpus, not the benchmark."""

from worksight import catalog


def test_frequency_counts_documents(spark, tmp_path):
    rows = [(1, "Road road drain"), (2, "drain of 123456"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.token: r.df for r in catalog.QUERIES["corpus_document_frequency"](spark, str(tmp_path)).collect()}
    assert got == {"road": 1, "drain": 2}

"""The classifier drops nearly all documents that are labelled poor."""

from pairmill.llm import quality

SF = "/root/testdata/sf0.1"


def test_poor_documents_go(spark):
    rows = quality.op2_quality(spark, SF).where("perplexity is not null")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    kept = rows.join(labels, "doc_id").toPandas().groupby("quality").kept.mean()
    assert kept[1] >= 0.98 and kept[0] <= 0.1

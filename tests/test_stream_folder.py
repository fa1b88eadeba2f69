"""The stream of documents, stored as a file and as a folder of part files."""

from tonelake.suite.queries import document_stream

SF = "/root/testdata/sf0.001"


def streamed(spark, sf, out):
    run = document_stream(spark, sf).writeStream.format("parquet").trigger(availableNow=True)
    run.option("checkpointLocation", f"{out}/checkpoint").start(f"{out}/rows").awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{out}/rows").collect()))


def test_stream_reads_a_file_and_a_folder(spark, folder):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    documents.repartition(3).write.parquet(f"{folder}/in/documents.parquet")
    want = sorted(map(tuple, documents.select("doc_id", "text").collect()))
    assert streamed(spark, SF, f"{folder}/file") == want
    assert streamed(spark, f"{folder}/in", f"{folder}/parts") == want

from pyspark.sql import functions as F

from lexmill.operators import cleaning as C, linear as M
from lexmill.streaming import scoring as Z


def documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("quality", "label")
    return docs, docs.join(marks, "doc_id").select("doc_id", "text", "label")


def test_cleaning_a_stream_equals_the_batch(spark, sf_dir, folder):
    docs, _ = documents(spark, sf_dir)
    docs.repartition(4).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    labelled = C.standardize_labels(Z.cleaned_stream(stream).withColumn("label", (F.col("doc_id") % 4).cast("int")))
    query = labelled.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").select("doc_id", "text", "label").collect()))
    batch = C.standardize_labels(C.clean_rows(docs).withColumn("label", (F.col("doc_id") % 4).cast("int")))
    assert got == sorted(map(tuple, batch.select("doc_id", "text", "label").collect()))


def test_scoring_a_stream_equals_the_batch(spark, sf_dir, folder):
    docs, train = documents(spark, sf_dir)
    model = M.fit(train, M.TfidfModel(max_features=200, max_iter=50))
    docs.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    Z.score_stream(stream, model, f"{folder}/out", f"{folder}/cp", ("lang",)).awaitTermination(300)
    got = spark.read.parquet(f"{folder}/out")
    assert got.select("batch").distinct().count() == 3
    expected = {r["doc_id"]: (r["lang"], round(r["z"], 9), r["pred"]) for r in M.score(C.clean_rows(docs), model, ["lang"], clean=False).collect()}
    assert {r["doc_id"]: (r["lang"], round(r["z"], 9), r["pred"]) for r in got.collect()} == expected

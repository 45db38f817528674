from pyspark.sql import functions as F

from retort.chem import fingerprints
from retort.functions import similarity
from retort.streaming.stateless import filter_stream, score_stream


def test_rules_on_a_stream(spark, tmp_path):
    schema = "id long, mol_weight double, logp double"
    spark.createDataFrame([(1, 300.0, 2.0), (2, 500.0, 2.0)], schema).write.parquet(str(tmp_path / "in"))
    stream = filter_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "gsk")
    query = stream.writeStream.format("memory").queryName("passed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(60)
    assert [r["id"] for r in spark.table("passed").collect()] == [1]


def _drained(stream, name, folder):
    query = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(folder)).start()
    query.awaitTermination(60)


def test_molecules_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "CCO"), (2, "C" * 60 + "O"), (3, "none")], "id long, s string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, s string").parquet(str(tmp_path / "in"))
    _drained(fingerprints.filter_molecules(stream, "id", "s", "lipinski", allow_one_violation=False), "druglike", tmp_path / "c")
    assert [r["id"] for r in spark.table("druglike").collect()] == [1]


def test_similarity_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, [True, False, True]), (2, [False, True, False])], "id long, on array<boolean>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, on array<boolean>").parquet(str(tmp_path / "in")).withColumn("bits", similarity.pack_bits(F.col("on"), 3))
    _drained(score_stream(stream, "bits", F.array(F.lit(5).cast("bigint")), 3).select("id", "similarity"), "scored", tmp_path / "c")
    assert {r["id"]: r["similarity"] for r in spark.table("scored").collect()} == {1: 1.0, 2: 0.0}

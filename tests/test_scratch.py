"""Tables that are kept belong to the files as they were."""

from lodestone.sources import scratch
from pyspark.sql import functions as F


def test_kept_follows_its_files(spark, tmp_path):
    path, built = f"{tmp_path}/t.parquet", []

    def total():
        files = spark.read.parquet(path)
        return scratch.kept(files, "sum", lambda: built.append(1) or files.agg(F.sum("id").alias("n"))).first()["n"]

    spark.range(5).write.parquet(path)
    assert (total(), total(), len(built)) == (10, 10, 1)
    spark.range(3).write.mode("append").parquet(path)
    assert (total(), total(), len(built)) == (13, 13, 2)
    spark.range(7).write.mode("overwrite").parquet(path)
    assert (total(), len(built)) == (21, 3)
    files = spark.read.parquet(path)
    assert scratch.kept(files, "max", lambda: files.agg(F.max("id").alias("n"))).first()["n"] == 6 and total() == 21

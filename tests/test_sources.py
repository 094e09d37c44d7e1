from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparkloom.sources import files


def test_contract_csv_keeps_rejected_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Id,Name\n1,a\nbad,b\n3,\n")
    contract = StructType([StructField("id", LongType()), StructField("name", StringType())])
    good, bad = files.read_contract_csv(spark, str(tmp_path / "x.csv"), contract, {"id": "Id", "name": "Name"})
    assert {r.id for r in good.collect()} == {1, 3} and [r.line for r in bad.collect()] == ["bad,b"]
    assert [r.more for r in files.read_text_csv(spark, str(tmp_path / "x.csv"), ["Id", "more"]).collect()] == [None] * 3


def test_only_new_files_and_only_given_partitions(spark, tmp_path):
    spark.range(4).selectExpr("id", "id % 2 as k").write.partitionBy("k").parquet(str(tmp_path / "t"))
    files.replace_partition(spark.createDataFrame([(9, 1)], "id long, k long"), str(tmp_path / "t"), "k")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [0, 2, 9]
    listed = files.new_files_only(spark, str(tmp_path / "t"), spark.createDataFrame([], "path string, length long"))
    assert listed.count() > 0 and files.new_files_only(spark, str(tmp_path / "t"), listed).count() == 0

from pyspark.sql import functions as F

from factloom.operators import sketches as SK


def test_merged_days_are_near_the_exact_counts(spark, tmp_path):
    rows = spark.range(400_000).select(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 60 as int))").alias("ts"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("kind"), (F.xxhash64("id") % 50_000).alias("user"))
    path = str(tmp_path / "days")
    for part in (F.col("ts") < "2024-01-20", F.col("ts") >= "2024-01-20"):
        SK.daily(rows.where(part), ["kind"], F.col("user")).write.mode("append").parquet(path)
    days = spark.read.parquet(path)
    for unit in ("week", "month"):
        exact = {(r.b, r.kind): (r.n, r.d) for r in rows.groupBy(F.trunc(F.to_date("ts"), unit).alias("b"), "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user").alias("d")).collect()}
        got = {(r.begin, r.kind): (r.n, r["distinct"]) for r in SK.merged(days, ["kind"], unit).collect()}
        assert got.keys() == exact.keys() and all(got[k][0] == exact[k][0] for k in exact)
        assert all(abs(got[k][1] - exact[k][1]) <= 4 * SK.standard_error() * exact[k][1] for k in exact)


def test_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([("2024-01-01", None), ("2024-01-01", None), ("2024-01-02", "x"), (None, "y")], "ts string, user string").withColumn("ts", F.to_timestamp("ts"))
    got = {str(r.begin): (r.n, r["distinct"]) for r in SK.merged(SK.daily(rows, [], F.col("user")), [], "month").collect()}
    assert got == {"2024-01-01": (3, 1), "None": (1, 1)}
    assert SK.merged(SK.daily(rows.limit(0), [], F.col("user")), [], "month").count() == 0

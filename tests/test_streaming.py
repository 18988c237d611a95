"""Streaming forms against their batch results."""

from veldt.streaming.incremental import cold_days, first_of_each


def test_stream_equals_batch(spark, tmp_path):
    days = spark.sql("SELECT c AS cell_id, CAST(d AS TIMESTAMP) AS time, IF(c = 2, NULL, CAST(dayofmonth(d) % 5 AS DOUBLE)) AS min_temp FROM (SELECT explode(array(1, 2)) AS c), (SELECT explode(sequence(DATE'2020-01-01', DATE'2020-03-30')) AS d)")
    days.write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema(days.schema).parquet(str(tmp_path / "in/*"))
    run = cold_days(stream, "time", "min_temp").writeStream.format("memory").queryName("cold").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination()
    want = {(r["cell_id"], r["start"]): r["cold_days"] for r in cold_days(days, "time", "min_temp").collect()}
    assert {(r["cell_id"], r["start"]): r["cold_days"] for r in spark.table("cold").collect()} == want and None in want.values()
    twice = spark.readStream.schema(days.schema).parquet(str(tmp_path / "in/*")).union(spark.readStream.schema(days.schema).parquet(str(tmp_path / "in/*")))
    run = first_of_each(twice, "time", ["cell_id", "time"]).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("once").count() == days.count()

from cartograph.streaming import churn


def test_commits_are_counted_once(spark, tmp_path):
    df = spark.sql("select * from values (1L, timestamp_ntz'2024-01-01 00:00:00', 5L), (1L, timestamp_ntz'2024-01-01 00:10:00', 5L), (2L, timestamp_ntz'2024-01-02 00:00:00', 69L) t(event_id, ts, user_id)")
    df = df.selectExpr("*", "'x' as event_type", "0D as value", "'{}' as props")
    assert df.schema.simpleString().startswith("struct<event_id:bigint")
    df.write.parquet(str(tmp_path / "in"))
    out = churn.distinct_commits(churn.event_churn(churn.read_events(spark, str(tmp_path / "in"))))
    q = out.writeStream.format("memory").queryName("commits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("commits").count() == 2
    batch = churn.churn_windows(churn.event_churn(df), "7 days").collect()
    assert sorted((r["path"], r["commits"]) for r in batch) == [("src/bucket_05.rs", 3)]

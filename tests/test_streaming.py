import datetime

from plumeline.streaming import forward


def test_stream_equals_batch(spark, tmp_path):
    day = datetime.datetime(2020, 1, 1)
    obs = spark.createDataFrame([(i, day + datetime.timedelta(hours=i), "co2") for i in range(6)], "obsid long, time timestamp, tracer string")
    obs.write.parquet(str(tmp_path / "in"))
    fp = spark.createDataFrame([(i, 0, 0, i % 2, 1.0 + i) for i in range(6)], "obsid long, itim int, ilat int, ilon int, sensi double")
    flux = spark.createDataFrame([("co2", "a", 0, 0, k, 3.0) for k in range(2)], "tracer string, category string, itim int, ilat int, ilon int, flux double")
    stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in"))
    q = forward.modelled(stream, fp, flux).writeStream.format("memory").queryName("modelled").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["obsid"], r["mix"]) for r in spark.table("modelled").collect()) == [(i, 3.0 * (1 + i)) for i in range(6)]

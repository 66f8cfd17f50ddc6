from lakestone.schemas import READINGS_RAW
from lakestone.session import local_path
from lakestone.streaming import ingest_files


def test_incremental_bronze_appends_new_files_once(spark, scratch):
    src, target, ckpt = scratch("raw_stream"), scratch("bronze_stream"), scratch("ckpt_stream")
    header = ("sensor_id,timestamp,ubicacion,temperatura_c,humedad_pct,velocidad_viento_ms,"
              "presion_hpa,seeing_arcsec,transparencia\n")
    import os
    os.makedirs(local_path(src), exist_ok=True)
    with open(local_path(src) + "/a.csv", "w") as f:
        f.write(header + "SENS-001,2024-03-01T00:00:00,Norte,16.5,NA,5.1,745.2,0.61,0.9\n")
    q = ingest_files(spark, src, "csv", READINGS_RAW, target, ckpt)
    q.awaitTermination()
    assert spark.read.parquet(target).count() == 1
    with open(local_path(src) + "/b.csv", "w") as f:
        f.write(header + "NULL,2024-03-01T00:05:00,Sur,,10.0,5.2,745.3,0.62,0.8\n"
                         "SENS-002,2024-03-01T00:10:00,Sur,15.0,9.0,5.0,745.0,0.6,0.7\n")
    q = ingest_files(spark, src, "csv", READINGS_RAW, target, ckpt)
    q.awaitTermination()
    rows = spark.read.parquet(target)
    assert rows.count() == 3
    assert rows.filter("sensor_id IS NULL").count() == 1
    assert rows.filter("humedad_pct IS NULL").count() == 1


def test_incremental_parquet_source(spark, scratch):
    from lakestone.sources.sinks import write_parquet
    from lakestone.schemas import EVENTS_RAW
    src, target, ckpt = scratch("pq_stream_src"), scratch("pq_stream_dst"), scratch("pq_stream_ckpt")
    rows = [("OBS-2024-0001", "SENS-001", "2024-03-01T20:00:00", "M42", 1.0, 2.0, -3.0, 30, "CCD", "completada")]
    write_parquet(spark.createDataFrame(rows, EVENTS_RAW), src, mode="append")
    ingest_files(spark, src, "parquet", EVENTS_RAW, target, ckpt).awaitTermination()
    assert spark.read.parquet(target).count() == 1

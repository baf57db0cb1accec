"""Readers on small files and streams against their batch results."""

import json

from pyspark.sql import functions as F

from meridian.sources import readers
from meridian.streaming import jobs


def test_seismic_feed(spark, tmp_path):
    f = {"id": "q1", "properties": {"mag": 5.1, "place": "x", "time": 1700000000000, "tsunami": 1}, "geometry": {"coordinates": [10.0, 20.0, 5.0]}}
    bad = {"properties": {"mag": 1}}
    (tmp_path / "f.json").write_text(json.dumps({"features": [f, bad]}))
    r = readers.seismic_feed(spark, str(tmp_path / "f.json")).collect()
    assert [(x.usgs_id, x.lon, x.depth_km, x.tsunami) for x in r] == [("q1", 10.0, 5.0, True)]


def test_rss_and_html(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>A</title><link>u</link></item><item><title>B</title></item></channel></rss>")
    assert [tuple(x) for x in readers.rss_feed(spark, str(tmp_path / "r.xml")).collect()] == [("u", "A", None)]
    pages = spark.createDataFrame([(1, "u", "<html><title> T </title><p>x <b>y</b></p>"), (2, "v", None), (3, None, "<title>Z</title>")], "page_id int, url string, html string")
    assert [(x.page_id, x.title) for x in readers.html_items(pages).collect()] == [(1, "T")]


def test_bulk_files(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("Q1\tAlpha\tfirst\nQ2\nQ3\t \nQ4\tBeta\n")
    (tmp_path / "t.tsv").write_text("Q1\tP17\tQ4\nQ1\tP9999\tQ4\nQ1\tP17\n")
    assert [(x.qid, x.name, x.description) for x in readers.kb_entities(spark, str(tmp_path / "e.tsv")).collect()] == [("Q1", "Alpha", "first"), ("Q4", "Beta", None)]
    assert [tuple(x) for x in readers.kb_triples(spark, str(tmp_path / "t.tsv")).collect()] == [("Q1", "LOCATED_IN", "Q4")]
    (tmp_path / "g.tsv").write_text("\t".join(["1", "Ulm", "Ulm", "a,b", "48.4", "9.99", "P", "PPL", "DE", "", "", "", "", "", "120000", "", "", "Europe/Berlin", "2020-01-01"]) + "\n")
    g = readers.geonames(spark, str(tmp_path / "g.tsv")).first()
    assert (g.entity_id, g.aliases, g.description) == ("geo:1", ["a", "b"], "City in DE. Population: 120000")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.txt").write_text("l1\nl2")
    assert readers.text_documents(spark, str(tmp_path / "docs")).first().text == "l1\nl2"
    assert readers.simulated_flights(spark).count() == readers.simulated_vessels(spark).count() == 3


def _tracks(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 10:05:00' + make_interval(0,0,0,0,0, id * 17) AS time, cast(id % 3 AS string) AS icao24, id / 40.0D AS anomaly_score FROM range(40)")
    df.write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_stream_rollup_equals_batch(spark, tmp_path):
    batch, stream = _tracks(spark, tmp_path)
    q = jobs.hourly_rollup(stream).writeStream.format("memory").queryName("rollup_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = batch.groupBy(F.date_trunc("hour", "time").alias("bucket")).agg(F.count_if(F.col("anomaly_score") > 0.7).alias("n"))
    assert sorted(map(tuple, spark.table("rollup_out").select("bucket", "anomaly_count").collect())) == sorted(map(tuple, want.collect()))


def test_stream_hourly_first(spark, tmp_path):
    batch, stream = _tracks(spark, tmp_path)
    q = jobs.hourly_first(stream, "icao24").writeStream.format("memory").queryName("first_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first_out").count() == batch.select("icao24", F.date_trunc("hour", "time")).distinct().count()


def test_fusion_stream_is_exactly_once(spark, tmp_path):
    r = spark.sql("SELECT id AS uid, 'OSINT' AS source_type, if(id % 2 = 0, 'HIGH', NULL) AS priority, NULL AS domain, 'h' AS content_headline, if(id = 0, NULL, 1.5D) AS lon, 2.5D AS lat, 'g' AS client_id FROM range(10)").withColumn("domain", F.col("domain").cast("string"))
    r.repartition(3).write.parquet(str(tmp_path / "rec"))
    for _ in range(2):  # a restart from the same checkpoint adds nothing
        s = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rec"))
        jobs.start_fusion(s, lambda df: df.select("uid"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    q = spark.read.parquet(str(tmp_path / "out/queue"))
    assert q.count() == q.select("queue_id").distinct().count() == 10
    assert {x.priority for x in q.collect()} == {"HIGH", "NORMAL"}
    n = {x.uid: json.loads(x.payload) for x in spark.read.parquet(str(tmp_path / "out/notifications")).collect()}
    assert n[0]["geo"] is None and n[1]["geo"] == {"lat": 2.5, "lon": 1.5} and n[1]["domain"] is None

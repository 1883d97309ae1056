from datetime import datetime, timedelta

from lectern.sources import collections
from lectern.streaming import ingest

SCHEMA = "page_id long, text string, page_number int, source_file string, source_path string, source_type string, author string, chapter int, language string, has_latex boolean"


def test_pages_are_taken_once(spark, tmp_path):
    path = str(tmp_path / "c")
    collections.open_collection(spark, path, create=True)
    page = lambda i: spark.createDataFrame([(i, f"Text of page {i}.", i, "a.pdf", "/a.pdf", "book", "X", None, "en", False)], SCHEMA)
    for i in (1, 2):
        page(i).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest_pages(spark, str(tmp_path / "in"), path, str(tmp_path / "cp"), SCHEMA).awaitTermination()
        assert collections.open_collection(spark, path).where("not is_parent").count() == i
        assert collections.sparse_index(spark, path)[1].count() == collections.open_collection(spark, path).count()


def test_live_quota(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    for k, times in enumerate(([0, 1, 2, 3], [4, 5, 902])):
        spark.createDataFrame([(1, 10 * k + j, t0 + timedelta(seconds=t)) for j, t in enumerate(times)], "user_id long, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(str(tmp_path / "in"))
        q = ingest.live_quota(events).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [r.allowed for r in spark.read.parquet(str(tmp_path / "out")).orderBy("event_id").collect()]
    assert got == [True] * 5 + [False, True]

from __future__ import annotations

from heliograph.sources.tables import event_bars, table
from heliograph.streaming.bars import crossings_from, stream_bars

FOLDER = "/root/testdata/sf0.001"


def test_a_replayed_stream_gives_the_batch_bars(spark, tmp_path):
    events = table(spark, FOLDER, "events")
    ordered = events.orderBy("ts").collect()
    for k in range(4):
        part = ordered[k * len(ordered) // 4 : (k + 1) * len(ordered) // 4]
        spark.createDataFrame(part + part[:5], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    bars = stream_bars(stream, 60, "30 days", symbol="event_type", price="value", key="event_id")
    out = bars.writeStream.outputMode("complete").format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    got, want = ({tuple(r) for r in df.select("symbol", "ts", "open", "high", "low", "close", "volume").collect()} for df in (spark.table("bars"), event_bars(spark, FOLDER)))
    assert got == want
    assert {tuple(r) for r in stream_bars(events, 60, symbol="event_type", price="value", key="event_id").collect()} == want
    assert crossings_from(spark.table("bars"), 10.0).where("open > 10 or close <= 10").count() == 0

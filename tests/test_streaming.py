from pyspark.sql import functions as F

from quillbook.operators import decide, diff, fold
from quillbook.sources.fixture import Fixture, stream
from quillbook.streaming import book_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = stream(spark, Fixture("realistic", 2, 1200, 4)).cache()
    half = rows.count() // 2
    source = str(tmp_path / "in")
    rows.where(F.col("idx") < half).coalesce(1).write.parquet(source + "/a")
    rows.where(F.col("idx") >= half).coalesce(1).write.parquet(source + "/b")
    strategy = decide.Strategy(cooldown=20)
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source + "/*")
    out = book_stream.book_stream(live, strategy)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out"))
    folded = fold.replay(rows)
    assert got.count() == folded.count()
    assert diff.top_mismatches(folded, got).count() == 0
    want = decide.orders(decide.signals(folded, strategy), strategy).orderBy("idx").select("idx", "action", "price").collect()
    assert [tuple(r) for r in got.where("action IS NOT NULL").orderBy("idx").select("idx", "action", "order_price").collect()] == [tuple(r) for r in want]


def test_rates(spark, tmp_path):
    rows = stream(spark, Fixture("realistic", 2, 3000, 4))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    counted = book_stream.rate_stream(live, "1 millisecond")
    counted.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("rates").agg(F.sum("n")).first()[0] == rows.count()

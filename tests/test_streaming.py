from pyspark.sql import functions as F

from tidemark.functions.redaction import GENERIC, mask
from tidemark.streaming import redacted_stream

SECRET = "q7" + "Zt" * 6


def test_stream_and_table_agree(spark, tmp_path):
    rows = [("a.txt", f"token={SECRET}\r\nx".encode()), ("b.txt", b"plain"), ("c.bin", b"\xff")]
    source = str(tmp_path / "drop")
    spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary").write.parquet(source)
    stream = redacted_stream(spark.readStream.schema("path string, content binary").parquet(source))
    query = stream.writeStream.format("memory").queryName("redacted").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.path: (r.text, r.redactions) for r in spark.table("redacted").collect()}
    assert got == {"a.txt": (f"token={mask(GENERIC)}\nx", {GENERIC: 1}), "b.txt": ("plain", {}), "c.bin": (None, {})}
    table = redacted_stream(spark.read.parquet(source)).select("path", F.col("text"))
    assert {r.path: r.text for r in table.collect()} == {p: t for p, (t, _) in got.items()}

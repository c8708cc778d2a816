from tidewater.functions.ids import message_id, span_id, trace_id
from pyspark.sql import functions as F


def test_identifiers(spark):
    t = "1c22f9c72e9ee53d4ffa62bfb8c9d7ae"
    same = [t, t.upper(), f"0x{t}", f" {t} ", "1c22f9c7-2e9e-e53d-4ffa-62bfb8c9d7ae", f"00{t}"]
    none = [None, "", "  ", "0" * 32, "0", "0x0", "xyz", t + "1", "0x"]
    df = spark.createDataFrame([(x,) for x in same + none], "x string").select(trace_id(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == [t] * len(same) + [None] * len(none)
    df = spark.createDataFrame([("1F",), ("0X1f",)], "x string").select(span_id(F.col("x")).alias("y"))
    assert {r.y for r in df.collect()} == {"000000000000001f"}


def test_message_ids(spark):
    u = "12430b64-2fed-4a89-87eb-51f10788342a"
    same = [u, f"{{{u}}}", f"urn:uuid:{u}", u.replace("-", ""), u.upper(), f"{u} ", f"URN:UUID:{u}"]
    df = spark.createDataFrame([(x,) for x in [*same, "Odd id", " ", None]], "x string").select(message_id(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == [u] * len(same) + ["odd id", None, None]

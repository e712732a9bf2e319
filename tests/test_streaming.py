from corpusloom.operators import extract
from corpusloom.streaming import incremental


def test_counts_follow_the_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ts").write_text("x='#fff' y='#000'")
    found = incremental.literal_counts(incremental.watch(spark, str(tmp_path / "in")), extract.HEX, 0)
    q = found.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        (tmp_path / "in" / "b.ts").write_text("z='#fff'")
        q.processAllAvailable()
        assert sorted((r.value, r.n) for r in spark.table("counts").collect()) == [("#000", 1), ("#fff", 2)]
    finally:
        q.stop()


def test_latest_rows_beat_late_ones(spark, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "a.json").write_text('{"k": "x", "t": 2, "v": "two"}\n{"k": "y", "t": 1, "v": "one"}')
    stream = spark.readStream.schema("k string, t int, v string").json(str(at))
    q = incremental.latest(stream, "k", "t").writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        (at / "b.json").write_text('{"k": "x", "t": 1, "v": "late"}\n{"k": "y", "t": 3, "v": "three"}')
        q.processAllAvailable()
        assert sorted((r.k, r.v) for r in spark.table("latest").collect()) == [("x", "two"), ("y", "three")]
    finally:
        q.stop()

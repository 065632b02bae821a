import io
import zipfile

from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.operators import books as B
from leafmill.operators import matching as M
from leafmill.sources import sinks
from leafmill.streaming import merge


def test_epub_reads_back(spark):
    rows = [("d", "T", 1, 1, "heading", 1, "One"), ("d", "T", 1, 2, "text", None, "a < b"), ("d", "T", 2, 1, "heading", 1, "Two"), ("d", "T", 2, 2, "code", None, "x")]
    books = sinks.epubs(spark.createDataFrame(rows, "path string, title string, page int, block int, role string, level int, text string"))
    data = bytes(books.first().epub)
    assert data == bytes(books.first().epub)
    assert zipfile.ZipFile(io.BytesIO(data)).namelist()[0] == "mimetype"
    r = B.epub_inspect(books.withColumnRenamed("epub", "content")).first()
    assert (r.status, r.title, r.spine_items) == ("ok", "T", 2)
    text = B.archive_texts(books.withColumnRenamed("epub", "content")).where("name like '%c0000%'").select(B.plain_text("text").alias("t")).first().t
    assert text == "One\na < b"


def test_cbz_in_reading_order(spark):
    pages = spark.createDataFrame([("c", f"p{n}.jpg", bytes([n])) for n in (10, 9, 1)] + [("c", "notes.txt", b"x")], "path string, name string, content binary")
    z = zipfile.ZipFile(io.BytesIO(bytes(sinks.comics(pages).first().cbz)))
    assert [z.read(n) for n in z.namelist()] == [b"\x01", b"\x09", b"\x0a"]


def test_palmdoc(spark):
    body = b"ab" + bytes([0x80 | (2 << 3) >> 8, (2 << 3 | 1) & 0xFF]) + bytes([0xC0 | 1])
    starts = [78 + 16 + 2, 78 + 16 + 2 + 16]
    head = b"Name".ljust(32, b"\0") + b"\0" * 28 + b"TEXtREAd" + b"\0" * 8 + (2).to_bytes(2, "big") + b"".join(s.to_bytes(4, "big") + b"\0" * 4 for s in starts) + b"\0\0"
    info = (2).to_bytes(2, "big") + b"\0" * 6 + (1).to_bytes(2, "big") + b"\0" * 6
    r = sinks.palmdoc(spark.createDataFrame([("a", head + info + body), ("b", b"zz"), ("c", None)], "path string, content binary")).collect()
    got = {x.path: (x.status, x.name, x.text) for x in r}
    assert got["a"] == ("ok", "Name", "ababab A") and got["b"][0] != "ok" and got["c"][0] != "ok"


def test_report(spark):
    assert sinks.report(spark.createDataFrame([("a|b", 0.12345, None)], "k string, v double, n int")) == "| k | v | n |\n| --- | --- | --- |\n| a\\|b | 0.123 |  |"


def test_tables_and_regions(spark):
    cells = lambda t, *texts: [(1, t, k, 0, 1, 1, x) for k, x in enumerate(texts)]
    schema = "page int, table int, row int, col int, rowspan int, colspan int, text string"
    p, r = spark.createDataFrame(cells(1, "a", "b") + cells(2, "a", "c"), schema), spark.createDataFrame(cells(7, "a", "b") + cells(8, "a", "x"), schema)
    m = M.match_tables(p, r, ["page"])
    assert {(x.p_table, x.r_table, round(x.f1, 3)) for x in m.collect()} == {(1, 7, 1.0), (2, 8, 0.5)}
    assert round(M.micro_scores(p, r, m, ["page"]).first().f1, 3) == 0.75
    box = lambda df: df.withColumn("box", G.rect(*[F.col("v")[i] for i in range(4)])).drop("v")
    regions = box(spark.createDataFrame([(1, 5, [0.0, 0.0, 2.0, 2.0])], "page int, region int, v array<double>"))
    blocks = box(spark.createDataFrame([(1, 1, [1.0, 1.0, 3.0, 3.0]), (1, 2, [0.0, 0.0, 1.5, 1.5]), (2, 3, [0.0, 0.0, 2.0, 2.0])], "page int, block int, v array<double>"))
    x = M.largest_overlap(regions, blocks, ["page"]).first()
    assert (x.block, x.area) == (2, 2.25)


def test_stream_is_the_batch_merge_in_any_order(spark, tmp_path):
    rows = [("a", 5, "c1", 1.0), ("a", 5, "c2", 2.0), ("a", 4, "c9", 9.0), ("b", 1, "c1", 3.0)]
    schema = "k string, updated_us long, change_id string, v double"
    results = []
    for name, order in (("x", rows), ("y", rows[::-1])):
        source, root = str(tmp_path / f"in-{name}"), str(tmp_path / f"out-{name}")
        for r in order:
            spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            merge.start_last_write(stream, root, ["k"], ["v"]).awaitTermination()
        results.append(sorted((r.k, r.change_id, r.v) for r in merge.latest(spark, root).collect()))
    assert results[0] == results[1] == [("a", "c2", 2.0), ("b", "c1", 3.0)]


def test_windows_over_a_stream(spark, tmp_path):
    source = str(tmp_path / "events")
    df = spark.createDataFrame([(1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:50"), (1, "2024-01-01 00:01:10"), (2, "2024-01-01 00:30:00")], "user long, t string").select("user", F.col("t").cast("timestamp").alias("ts"))
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("user long, ts timestamp").parquet(source)
    for name, frame, want in (("w", merge.windowed_counts(stream, "ts", "1 hour", "1 minute", None, "user"), [1, 1, 2]), ("s", merge.session_counts(stream, "ts", "1 hour", "5 minutes", "user"), [1, 3])):
        frame.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.n for r in spark.table(name).collect()) == want

"""Streams of files by batches: late rows, windows that close, repeated keys, batches run again."""

from datetime import datetime, timedelta

from millrace.streaming import ingest

START = datetime(2024, 1, 1)


def stream(spark, path, batches):
    """One file for each batch of (key, minute, n), read one at a time in order."""
    schema = "ts timestamp, k string, n long"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(START + timedelta(minutes=m), k, n) for k, m, n in rows], schema)
        df.coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def finish(df, tmp_path):
    q = ingest.ingest(df, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    q.awaitTermination()
    return df.sparkSession.read.parquet(f"{tmp_path}/out")


def test_rows_behind_the_watermark_are_dropped_and_closed_windows_come_out_once(spark, tmp_path):
    batches = [[("a", 1, 0), ("a", 2, 0), ("b", 3, 0)], [("a", 60, 0)], [("a", 61, 0)], [("a", 4, 0), ("a", 55, 0)], [("a", 300, 0)], [("a", 301, 0)]]
    src = stream(spark, f"{tmp_path}/in", batches)
    got = finish(ingest.windowed_counts(src, "ts", "k", "30 minutes"), tmp_path)
    minutes = sorted((int((r.start - START).total_seconds() // 60), r.k, r.n) for r in got.collect())
    # late rows are dropped by the watermark that the batch before had: the row of minute 4 comes when the watermark stands at 50, that of minute 55 doesn't; windows from 300 on are still open
    assert minutes == [(0, "a", 2), (0, "b", 1), (30, "a", 1), (60, "a", 2)]


def test_sliding_windows_count_a_row_in_each(spark, tmp_path):
    src = stream(spark, f"{tmp_path}/in", [[("a", 25, 0)], [("a", 500, 0)], [("a", 501, 0)]])
    got = finish(ingest.windowed_counts(src, "ts", "k", "30 minutes", "10 minutes"), tmp_path)
    assert sorted(int((r.start - START).total_seconds() // 60) for r in got.collect()) == [0, 10, 20]


def test_repeats_go_across_batches(spark, tmp_path):
    src = stream(spark, f"{tmp_path}/in", [[("a", 1, 1), ("a", 1, 2)], [("a", 2, 3), ("b", 2, 4)], [("b", 3, 5), ("c", 3, 6)]])
    got = finish(ingest.dedup_stream(src, ["k"], "ts"), tmp_path)
    assert sorted(r.k for r in got.collect()) == ["a", "b", "c"]


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    src = stream(spark, f"{tmp_path}/in", [[("a", 1, 1)], [("b", 2, 2)]])
    first = finish(src, tmp_path).count()
    import shutil

    shutil.rmtree(f"{tmp_path}/checkpoint")  # as if the batches' commits had been lost
    assert finish(src, tmp_path).count() == first == 2

"""Streams over several batches: state that carries on and ends, tables that a replayed batch leaves alone."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import cases, ingest
from tessera.streaming import jobs, stateful, tables
from tessera.streaming.folders import in_batches

DAY = dt.datetime(2024, 1, 1)


def over(rows, folder, job, count=2):
    out = []
    with stateful.rocksdb(rows.sparkSession):
        in_batches(rows, "b", count, str(folder), lambda s: out.append(jobs.landed(job(s), f"{folder}/out")))
    return out[-1].collect()


def test_feed_cursors_and_failure_runs(spark, tmp_path):
    rows = [(0, "a", "g1", 1), (0, "a", "g2", 5), (0, "b", "g1", 9), (0, None, "g", 1), (1, "a", "g0", 4), (1, "a", "g3", 5), (1, "a", "g2", 8), (1, "a", "g4", 7), (1, "a", "g4", 9), (1, "c", "g1", 1)]
    entries = spark.createDataFrame(rows, "b int, source string, guid string, published long")
    got = sorted((r.source, r.guid, r.published) for r in over(entries, tmp_path / "feed", stateful.feed_cursors))
    # g0 is older than the cursor, g2 was given out before, g3 ties with the cursor and comes after it
    assert got == [("a", "g1", 1), ("a", "g2", 5), ("a", "g3", 5), ("a", "g4", 7), ("b", "g1", 9), ("c", "g1", 1)]
    events = [(0, "k", 1, 1, False), (0, "k", 2, 2, False), (1, "k", 4, 4, False), (1, "k", 3, 3, None), (1, "m", 1, 5, True), (1, "m", 2, 6, False)]
    runs = over(spark.createDataFrame(events, "b int, key string, at long, seq long, ok boolean"), tmp_path / "runs", lambda s: stateful.failure_runs(s, 3))
    assert [(r.key, r.seq) for r in runs] == [("k", 3)]


def test_state_of_idle_keys_goes(spark, tmp_path):
    entries = spark.createDataFrame([(0, "a", "g1", 5), (1, "a", "g0", 3)], "b int, source string, guid string, published long")
    assert len(over(entries, tmp_path / "kept", stateful.feed_cursors)) == 1
    # with a state of one millisecond the second batch knows no cursor
    assert len(over(entries, tmp_path / "gone", lambda s: stateful.feed_cursors(s, 1))) == 2


def test_searches_have_the_horizon_of_their_adapter(spark, tmp_path):
    at = lambda h: DAY + dt.timedelta(hours=h)
    rows = [(0, "p", "k", 1, at(0)), (0, "p", "k", 2, at(5)), (0, "q", "k", 3, at(0)), (0, "z", "k", 4, at(0)), (0, "z", "k", 5, at(0)), (1, "p", "k", 6, at(7)), (1, "q", "k", 7, at(7)), (1, "p", "k", 8, at(13)), (2, "q", "k", 9, at(60)), (2, "p", "l", 10, at(61))]
    searches = spark.createDataFrame(rows, "b int, adapter string, key string, seq long, ts timestamp")
    adapters = spark.createDataFrame([("p", 6), ("q", 48), ("z", 0)], "adapter string, repeat_after_hours int")
    got = sorted(r.seq for r in over(searches, tmp_path / "s", lambda s: stateful.fresh_searches(s, adapters), 3))
    assert got == [1, 3, 4, 5, 6, 9, 10]
    # the batch form suppresses the same ones, given those that were given out
    names = searches.select("adapter", F.col("key").alias("query"), "seq", F.col("ts").alias("at"))
    history = names.filter(F.col("seq").isin(got)).select("adapter", "query", F.col("at").alias("executed_at"))
    rest = ingest.suppress_recent(names.filter(~F.col("seq").isin(got)), history, adapters)
    assert rest.count() == 0


def test_upsert_equals_the_fold_and_a_replay_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 1, "x"), (0, 1, 2, "y"), (0, 2, 1, "z"), (1, 1, 1, "old"), (1, 2, 3, "w"), (1, 3, 1, "n")], "b int, key long, at long, value string")
    kept, folder = "key long, at long, value string", tmp_path / "u"
    write = tables.upsert_writer(str(folder), kept, ["key"], ["at"], buckets=4)
    for n in (0, 1, 1):
        write(rows.filter(F.col("b") == n).drop("b"), n)
    got = sorted(map(tuple, tables.upserted(spark, str(folder), kept).collect()))
    last = cases.latest(rows.drop("b"), ["key"], ["at"], ["at", "value"])
    assert got == sorted(map(tuple, last.collect())) == [(1, 2, "y"), (2, 3, "w"), (3, 1, "n")]
    write(rows.limit(0).drop("b"), 2)
    assert sorted(map(tuple, tables.upserted(spark, str(folder), kept).collect())) == got


def test_a_file_that_lands_again_much_later_gives_no_chunk(spark, tmp_path):
    text = "some words of a file\n\nand more of them"
    rows = spark.createDataFrame([(0, "b", "h1", text), (0, "a", "h1", text), (0, "c", "h2", "other"), (1, "d", "h1", text), (1, "e", "h3", "new")], "b int, path string, sha256 string, text string")
    folder = tmp_path / "store"
    in_batches(rows, "b", 2, str(folder), lambda s: tables.run(s, f"{folder}/out", tables.inbox_writer(f"{folder}/out")))
    assert {r.path for r in tables.stored_chunks(spark, f"{folder}/out").collect()} == {"a", "c", "e"}
    tables.inbox_writer(f"{folder}/out")(rows.filter("b = 1").drop("b"), 1)
    assert {r.path for r in tables.stored_chunks(spark, f"{folder}/out").collect()} == {"a", "c", "e"}


def test_a_ledger_and_its_corrections_equal_the_batch(spark, tmp_path):
    at = lambda d, h=0: DAY + dt.timedelta(days=d, hours=h)
    rows = spark.createDataFrame([(0, at(0), 1.5), (0, at(0, 5), 2.0), (0, at(3), 4.0), (0, None, 9.0), (1, at(0, 9), 8.0), (1, at(2, 1), 16.0), (1, at(4), None)], "b int, ts timestamp, value double")
    folder = f"{tmp_path}/l"
    write = tables.ledger_writer(f"{folder}/out", "ts", "value", "1 day", "1 day", "1 DAY")
    in_batches(rows, "b", 2, folder, lambda s: tables.run(s, f"{folder}/out", write))
    got = {(r.start - DAY).days: (r.n, float(r.total), r.late_n, float(r.late_total)) for r in tables.ledger(spark, f"{folder}/out").collect()}
    # the second batch began at the third day less one: the first day had ended, the third had not
    assert got == {0: (2, 3.5, 1, 8.0), 2: (1, 16.0, 0, 0.0), 3: (1, 4.0, 0, 0.0), 4: (1, 0.0, 0, 0.0)}
    write(rows.filter("b = 1").drop("b"), 1)
    assert len({(r.start - DAY).days for r in tables.ledger(spark, f"{folder}/out").collect()}) == 4

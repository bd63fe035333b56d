from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from cuelattice.operators.state import Table
from cuelattice.streaming import live


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_daily_rates_of_closed_days_equal_the_batch(spark, sf_dir):
    got = {r.day: r.total for r in drained(live.rates(live.events(spark, f"{sf_dir}/events.parquet*"), "0 seconds"), "rates").collect()}
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d")).count().collect()
    whole = {r.d: r["count"] for r in batch}
    assert got and all(whole[d] == n for d, n in got.items())


def test_bursts_and_windows_run(spark, sf_dir):
    source = live.events(spark, f"{sf_dir}/events.parquet*")
    assert drained(live.bursts(source), "bursts").count() > 0
    assert drained(live.sliding(source), "windows").count() > 0


def test_loops_keep_state(spark, sf_dir):
    out = drained(live.loops(live.events(spark, f"{sf_dir}/events.parquet*"), 3), "loops")
    assert out.count() > 0


def test_wanted_diff_takes_the_first_batch_as_baseline(spark, tmp_path):
    kind = "id long, lang string"
    snapshot = Table(spark, f"file://{tmp_path}/s", kind)
    resolved = Table(spark, f"file://{tmp_path}/r", "id long, lang string, batch long")
    sink = live.WantedDiff(snapshot, resolved)
    sink(spark.createDataFrame([(1, "en"), (2, "en")], kind), 0)
    assert resolved.read().count() == 0
    sink(spark.createDataFrame([(2, "en")], kind), 1)
    assert [tuple(r) for r in resolved.read().collect()] == [(1, "en", 1)]


LISTING = "video_path string, ts timestamp, mtime long, size long"


def listed(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        told = spark.createDataFrame([(v, t, m, n) for v, t, m, n in rows], "video_path string, t long, mtime long, size long")
        told.select("video_path", F.timestamp_millis("t").alias("ts"), "mtime", "size").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k:03d}")
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")


def plain_relisting(batches, limit):
    state, out, mark = {}, [], None
    for rows in batches:
        rows = [r for r in rows if mark is None or r[1] > mark]
        for v in sorted({r[0] for r in rows}):
            for _, t, m, n in sorted(r for r in rows if r[0] == v):
                if v in state and state[v][:2] == (m, n) and t - state[v][2] < limit:
                    out.append((v, t, "reused"))
                else:
                    state[v] = (m, n, t)
                    out.append((v, t, "looked"))
        mark = max([mark or 0, *(r[1] for r in rows)])
        for v in [v for v, s in state.items() if s[2] + limit <= mark]:
            out.append((v, state.pop(v)[2] + limit, "dropped"))
    return sorted(out)


def test_state_of_old_listings_is_dropped(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        hour, t0 = 3_600_000, 1_700_000_000_000
        batches = [[("a", 0, 1, 1), ("b", 0, 1, 1), ("c", 0, 1, 1)], [("a", hour, 1, 1), ("b", hour, 2, 1)], [("a", 3 * hour, 1, 1), ("b", 3 * hour, 2, 1)], [("a", 9 * hour, 1, 1)], [("a", 10 * hour, 1, 1)]]
        batches = [[(v, t0 + t, m, n) for v, t, m, n in rows] for rows in batches]
        out = drained(live.relisted(listed(spark, tmp_path, batches), 4 * hour), "relisted").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.video_path, r.at, r.what) for r in out)
    want = plain_relisting(batches, 4 * hour)
    assert [g for g in got if g[2] != "dropped"] == [w for w in want if w[2] != "dropped"]
    assert {g for g in got if g[2] == "dropped"} >= {("b", t0 + 5 * hour, "dropped"), ("c", t0 + 4 * hour, "dropped")} and set(got) >= set(want)


def test_metrics_come_with_the_rows(spark, tmp_path):
    clips = spark.createDataFrame([("a", "fresh", 0, 10_000), ("a", "cached", 0, 5_000), ("b", "silent", None, None), ("b", "fresh", 0, 2_500)], "file_id string, origin string, at long, until long")
    rows, seen = live.counted(clips, "cost", **live.cost_metrics())
    assert rows.where("origin = 'fresh'").count() == 2
    assert seen.get == {"fresh_s": 12.5, "cached_s": 5.0, "clips": 4, "silent": 1} == clips.agg(*[c.alias(k) for k, c in live.cost_metrics().items()]).first().asDict()
    empty, none = live.counted(clips.limit(0), "no cost", **live.cost_metrics())
    assert empty.count() == 0 and none.get["clips"] == 0


def test_metrics_of_a_stream_add_up_to_the_batch(spark, sf_dir):
    found = []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            if "seen" in event.progress.observedMetrics:
                found.append(event.progress.observedMetrics["seen"].n)

        def onQueryTerminated(self, event):
            pass

    listener = Listener()
    spark.streams.addListener(listener)
    try:
        stream = live.events(spark, f"{sf_dir}/events.parquet*").observe("seen", F.count("*").alias("n"))
        drained(stream, "observed")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert sum(found) == spark.read.parquet(f"{sf_dir}/events.parquet").count()

"""The partitioned versioned table: what a merge leaves alone, repeats, restarts, failures, time travel."""
import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import versioned as V
from tidemark.operators.partitioned import ROWS, PartitionedVersions
from tidemark.streaming import feeds

T0 = datetime(2026, 1, 1)
SCHEMA = "series_id string, obs_start date, value double, seen timestamp"


def rows(spark, *what):
    """(series, month, value, hour it was seen)"""
    return spark.createDataFrame([(s, date(2026, m, 3), v, T0 + timedelta(hours=h)) for s, m, v, h in what], SCHEMA)


def files(root):
    return {p: os.stat(p).st_mtime_ns for d, _, names in os.walk(root + "/data") for p in (os.path.join(d, n) for n in names) if p.endswith(".parquet")}


def shown(df):
    return sorted((r.series_id, str(r.obs_start), r.revision_no, r.value, r.is_current) for r in df.collect())


def live(store):
    return {(r.bucket, r.month): r.written for r in store.partitions(store.commits()[-1]).collect()}


def test_a_batch_rewrites_only_its_partitions(spark, tmp_path):
    store = PartitionedVersions(spark, str(tmp_path / "t"), 4)
    assert store.read().collect() == [] and store.commits() == []
    first = store.absorb(0, rows(spark, *[(f"s{i}", m, float(i), 0) for i in range(12) for m in (1, 2, 3)]), "seen")
    assert (first.added, first.repeated) == (36, False) and first.touched == first.rewritten == len(live(store))
    before, places = files(store.root), live(store)
    second = store.absorb(1, rows(spark, ("s5", 2, 99.0, 1)), "seen")
    assert (second.touched, second.rewritten, second.added) == (1, 1, 1)
    after = files(store.root)
    assert {p: t for p, t in after.items() if p in before} == before        # every old file is as it was
    moved = {k for k, v in live(store).items() if v != places[k]}
    assert len(moved) == 1 and next(iter(moved))[1] == 202602
    s5 = store.read(series=["s5"])
    assert [x for x in shown(s5) if x[1] == "2026-02-03"] == [("s5", "2026-02-03", 1, 5.0, False), ("s5", "2026-02-03", 2, 99.0, True)]
    assert shown(store.read(0)) == sorted((f"s{i}", f"2026-0{m}-03", 1, float(i), True) for i in range(12) for m in (1, 2, 3))
    assert store.absorb(1, rows(spark, ("s5", 2, 7.0, 2)), "seen").repeated and files(store.root) == after
    again = PartitionedVersions(spark, store.root, 4)                        # a restart
    assert again.absorb(2, rows(spark, ("s5", 2, 99.0, 3)), "seen").added == 0 and live(again) == live(store)
    assert shown(again.read()) == shown(store.read(1))
    with pytest.raises(ValueError, match="buckets"):
        PartitionedVersions(spark, store.root, 8).absorb(3, rows(spark, ("s5", 2, 1.0, 4)), "seen")
    with pytest.raises(ValueError, match="no commit"):
        store.read(77)


def test_equals_the_table_rewritten_whole(spark, tmp_path):
    import random
    r = random.Random(5)
    store, whole = PartitionedVersions(spark, str(tmp_path / "t"), 3), spark.createDataFrame([], ROWS)
    for n in range(4):
        new = rows(spark, *[(f"s{r.randrange(4)}", r.randint(1, 3), r.choice([None, 1.0, 2.0]), r.randint(0, 40)) for _ in range(25)])
        new = new.dropDuplicates(["series_id", "obs_start", "seen"]).cache()
        whole = spark.createDataFrame(V.absorb_batches(whole, new, "seen").collect(), ROWS)
        store.absorb(n, new, "seen")
        assert sorted(map(str, store.read().collect())) == sorted(map(str, whole.collect()))


def test_load_writes_once(spark, tmp_path):
    other = PartitionedVersions(spark, str(tmp_path / "o"), 2)
    other.absorb(0, rows(spark, ("a", 1, 1.0, 0), ("b", 2, 2.0, 0)), "seen")
    store = PartitionedVersions(spark, str(tmp_path / "t"), 2)
    assert store.load(other.read()).added == 2 and shown(store.read()) == shown(other.read())
    assert store.merge_batch(1, rows(spark, ("a", 1, 3.0, 0)), F.lit(T0 + timedelta(1))).rewritten == 1
    with pytest.raises(ValueError):
        store.load(other.read())


def test_merge_batch_and_null_period(spark, tmp_path):
    store = PartitionedVersions(spark, str(tmp_path / "t"), 2)
    store.merge_batch(0, rows(spark, ("a", 1, 1.0, 0), ("b", 2, 2.0, 0)), F.lit(T0))
    done = store.merge_batch(1, rows(spark, ("a", 1, 1.5, 0), ("b", 2, 2.0, 0)), F.lit(T0 + timedelta(1)))
    assert done.added == 1 and done.rewritten == 1 and done.touched == 2
    assert shown(store.read()) == [("a", "2026-01-03", 1, 1.0, False), ("a", "2026-01-03", 2, 1.5, True), ("b", "2026-02-03", 1, 2.0, True)]
    odd = spark.createDataFrame([("c", None, 4.0)], "series_id string, obs_start date, value double")
    assert store.merge_batch(2, odd, F.lit(T0)).added == 1 and live(store)[next(k for k in live(store) if k[1] == 0)] == 2
    assert store.merge_batch(3, odd.where("false"), F.lit(T0)).touched == 0 and store.read().count() == 4


def test_a_run_that_failed_before_its_log_is_not_seen(spark, tmp_path):
    store = PartitionedVersions(spark, str(tmp_path / "t"), 2)
    store.absorb(0, rows(spark, ("a", 1, 1.0, 0)), "seen")

    def broken(stored, new):
        return V.absorb_batches(stored, new, "seen").withColumn("status", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.merge(1, rows(spark, ("a", 1, 2.0, 1)), broken)
    assert store.commits() == [0] and shown(store.read()) == [("a", "2026-01-03", 1, 1.0, True)]
    assert store.absorb(1, rows(spark, ("a", 1, 2.0, 1)), "seen").added == 1


def test_stream_leaves_other_partitions_alone_after_a_restart(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "root")

    def land(df):
        df.coalesce(1).write.mode("append").parquet(src)

    def run():
        return feeds.merge_stream(feeds.landing(spark, src, df.schema, files_per_batch=1), "seen", root, buckets=4)
    df = rows(spark, *[(f"s{i}", m, 1.0, 0) for i in range(8) for m in (1, 2)])
    land(df)
    assert run().count() == 16
    before = files(root + "/table")
    land(rows(spark, ("s3", 1, 5.0, 1)))
    assert run().count() == 17                                              # the query starts anew from its checkpoint
    after = files(root + "/table")
    assert {p: after[p] for p in before} == before and len({os.path.dirname(p) for p in after} - {os.path.dirname(p) for p in before}) == 1
    assert run().count() == 17 and files(root + "/table") == after          # nothing new arrived

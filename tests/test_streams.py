"""Streams whose rows come late, out of order or twice."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from proplake.session import shared_folder
from proplake.streaming import streams as S

START = datetime(2025, 1, 1)
SCHEMA = "uid string, event_id long, ts timestamp, price long"


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def arriving(spark, folder, batches):
    """A stream of the given micro-batches: rows (uid, event_id, hours, price)."""
    for rows in batches:
        spark.createDataFrame([(u, i, START + timedelta(hours=h), p) for u, i, h, p in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(spark, df, folder):
    return sorted(map(tuple, S.run_available(spark, df, folder).filter("uid IS NOT NULL").collect()))


END = [(None, 0, 100_000, None)]


def test_a_quiet_listing_goes_and_a_late_sighting_keeps_one(spark, folder):
    batches = [[("quiet", 1, 0, 1), ("late", 2, 0, 1), ("back", 3, 0, 1)], [("other", 4, 60, 1)], [("late", 5, 40, 1)], [("other", 6, 100, 1), ("back", 7, 100, 1)]]
    found = run(spark, S.stream_deactivate(arriving(spark, folder, batches), 2, "24 hours"), folder)
    at = lambda h: START + timedelta(hours=h)
    assert found == [("back", at(0), at(48)), ("quiet", at(0), at(48))]  # "late" was seen at 40 while its time could still come


def test_rows_out_of_order_over_batches_are_folded_in_order(spark, folder):
    batches = [[("a", 3, 30, 5), ("a", 1, 0, 1)], [("a", 2, 20, 3), ("b", 9, 31, 7)], [("b", 8, 29, 6), ("a", 4, 50, 5), ("a", 5, 51, None)], [("a", 6, 52, 9)], END]
    stream = arriving(spark, folder, batches)
    assert run(spark, S.stream_price_change(stream, "price", "12 hours"), folder) == [("a", 2, 3, 2), ("a", 3, 5, 2), ("b", 9, 7, 1)]


def test_fixed_clock_out_of_order(spark, folder):
    batches = [[("a", 2, 24, 1), ("a", 1, 0, 1)], [("a", 3, 20, 1)], [("a", 4, 50, 1)], END]
    found = run(spark, S.stream_freshness_fixed(arriving(spark, folder, batches), 23, "12 hours"), folder)
    assert [(u, i) for u, i, _ in found] == [("a", 1), ("a", 2), ("a", 4)]


def test_lifecycle_keeps_unknown_requests(spark, folder):
    batches = [[("a", 2, 2, None), ("a", 1, 1, None)], [("a", 3, 3, None)], END]
    to = F.element_at(F.create_map(F.lit(1), F.lit("contacted"), F.lit(2), F.lit("archived"), F.lit(3), F.lit("shortlisted")), F.col("event_id").cast("int"))
    requests = arriving(spark, folder, batches).select("uid", F.col("event_id").alias("id"), "ts", to.alias("to_status"))
    found = run(spark, S.stream_lifecycle(requests), folder)
    assert [(i, f, t) for _, i, f, t, _ in found] == [(1, "new", "contacted"), (2, "contacted", "archived"), (3, "contacted", "shortlisted")]
    assert [legal for *_, legal in found] == [True, False, True]


def test_upsert_rewrites_touched_buckets_and_replays_alike(spark, folder):
    columns = "uid string, last_scraped timestamp, scrape_count int, price_numeric long, first_seen timestamp, is_active boolean, status string"
    start = spark.createDataFrame([(f"u{i}", START, 1, 10, START, True, "active") for i in range(300)], columns)
    S.write_buckets(start, folder, "start")
    write = S.upsert_batches(folder, "2025-02-01 00:00:00", ["ts", "event_id"], start.schema)
    batches = [spark.createDataFrame([(f"u{i}", k * 10 + i, START, 100 * k + i) for i in ids], "uid string, event_id long, ts timestamp, price_numeric long") for k, ids in ((1, [1, 2, 3]), (2, [3, 400]))]

    def held(version):
        rows = S.read_buckets(spark, folder, S.manifest(spark, folder, version), start.schema).select("uid", "price_numeric", "scrape_count")
        return {r[0]: tuple(r[1:]) for r in rows.collect()}

    write(batches[0], 0)
    write(batches[1], 1)
    done = held("1")
    assert len(done) == 301 and done["u1"] == (101, 2) and done["u3"] == (203, 3) and done["u400"] == (600, 1) and done["u9"] == (10, 1)
    write(batches[0], 0)
    write(batches[1], 1)
    assert held("1") == done
    rewritten = [b for b, v in S.manifest(spark, folder, "1").items() if v == "1"]
    assert 1 <= len(rewritten) <= 2 < S.BUCKETS


def test_keys_that_share_a_group_are_folded_apart(spark, folder):
    """Many keys in few groups: rows wait, come out of order and are forgotten for each key alone."""
    batches = [[(f"u{k}", 10 * n + k, 24 * n - (k + n) % 3, k % 4 + n // 2) for k in range(25)] for n in range(8)]
    batches[5] = batches[5][::2]
    rows = arriving(spark, folder, [*batches, END]).select("uid", F.col("event_id").alias("id"), "ts", F.col("price").alias("value"))

    def step(uid, held, ts, number, value):
        return int(value), (uid, number, held, int(value))

    out = S._keyed(rows, step, "uid string, id long, held long, value long", "4 hours", 30 * 3_600 * 1_000_000, groups=3)
    found = {(u, i): (h, v) for u, i, h, v in run(spark, out, folder)}
    wanted = {}
    for k in range(25):
        before = None
        for uid, number, hours, price in sorted((r for b in batches for r in b if r[0] == f"u{k}"), key=lambda r: r[2]):
            if before and hours - before[0] > 40:  # forgotten: quiet for 30 hours, and the watermark has passed that
                before = None
            wanted[uid, number] = (before and before[1], price)
            before = hours, price
    assert {k: v[1] for k, v in found.items()} == {k: v[1] for k, v in wanted.items()}
    kept = {k: v for k, v in wanted.items() if v[0] is not None}
    assert {k: found[k] for k in kept} == kept

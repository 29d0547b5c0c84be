import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, values
from sediment.operators import compliance, layout, reports, retention
from sediment.sources.day_table import Conflict, DayTable

SCHEMA = "event_id BIGINT, user_id BIGINT, event_date DATE, eviction_date DATE, payload STRING"


def rows(spark, *items):
    """(event_id, user_id, day, eviction, payload, seq)"""
    frame = spark.createDataFrame(list(items), "event_id long, user_id long, d string, e string, payload string, seq long")
    return frame.select("event_id", "user_id", F.to_date("d").alias("event_date"), F.to_date("e").alias("eviction_date"), "payload", "seq")


def table(spark, folder, mode="write"):
    return DayTable(spark, folder, SCHEMA, ["event_id"], sort=["user_id"], mode=mode)


FIRST = [
    (31, 8, "2024-06-03", "2024-09-30", "kettle on", 1),
    (32, 15, "2024-06-03", "2024-09-30", "door open", 2),
    (33, 8, "2024-06-03", "2024-09-30", "kettle off", 3),
    (34, 23, "2024-06-03", "2024-09-30", "door shut", 4),
]


@pytest.mark.parametrize("mode", ["write", "read"])
def test_replay_replaces_and_delete_removes(spark, folder, mode):
    """Four rows, a second delivery of one id replaces it, then one of the users goes."""
    t = table(spark, folder, mode)
    t.upsert(rows(spark, *FIRST), ["seq"])
    t.upsert(rows(spark, (31, 8, "2024-06-03", "2024-09-30", "kettle moved", 5)), ["seq"])
    assert t.read().count() == 4
    assert t.read().where("event_id = 31").first()["payload"] == "kettle moved"
    compliance.delete_users(t, spark.createDataFrame([(8,)], "user_id long"))
    assert values(t.read().select("event_id"), "event_id") == [(32,), (34,)]


@pytest.mark.parametrize("mode", ["write", "read"])
def test_key_that_moves_to_another_day(spark, folder, mode):
    t = table(spark, folder, mode)
    t.upsert(rows(spark, (1, 1, "2024-06-03", "2024-09-30", "old", 1)), ["seq"])
    t.upsert(rows(spark, (1, 1, "2024-06-04", "2024-09-30", "new", 2)), ["seq"])
    assert values(t.read().select("event_date", "payload")) == [(dt.date(2024, 6, 4), "new")]
    assert t.read(["2024-06-03"]).count() == 0
    t.fold()
    assert t.days() == ["2024-06-04"]


def test_batch_with_several_versions_of_a_key(spark, folder):
    t = table(spark, folder)
    t.upsert(rows(spark, (1, 1, "2024-06-03", "2024-09-30", "a", 2), (1, 1, "2024-06-03", "2024-09-30", "b", 1)), ["seq"])
    assert values(t.read().select("payload")) == [("a",)]


def test_same_batch_twice_is_taken_once(spark, folder):
    t = DayTable(spark, folder, SCHEMA)
    assert t.append(rows(spark, *FIRST), ("job", 7))
    assert not t.append(rows(spark, *FIRST), ("job", 7))
    assert not t.append(rows(spark, *FIRST), ("job", 6))
    assert t.append(rows(spark, *FIRST), ("other", 1))
    assert t.read().count() == 8


def test_crash_between_write_and_publish_leaves_the_old_state(spark, folder, monkeypatch):
    t = table(spark, folder)
    t.upsert(rows(spark, *FIRST), ["seq"])

    def dies(*args, **kwargs):
        raise RuntimeError("lost the driver")

    with monkeypatch.context() as patch:
        patch.setattr(DayTable, "_publish", dies)
        with pytest.raises(RuntimeError):
            t.upsert(rows(spark, (31, 8, "2024-06-03", "2024-09-30", "half", 9)), ["seq"], ("job", 1))
    assert t.read().where("payload = 'half'").count() == 0
    assert t.read().count() == 4
    assert len(t.vacuum(grace_seconds=0)) == 1
    assert t.upsert(rows(spark, (31, 8, "2024-06-03", "2024-09-30", "half", 9)), ["seq"], ("job", 1))
    assert t.read().count() == 4


def test_second_writer_fails(spark, folder):
    t = table(spark, folder)
    stale = t.state()
    t.upsert(rows(spark, *FIRST), ["seq"])
    with pytest.raises(Conflict):
        t._publish(stale)
    assert t.read().count() == 4


def test_day_that_becomes_empty_disappears(spark, folder):
    t = table(spark, folder)
    t.upsert(rows(spark, *FIRST, (9, 500, "2024-06-04", "2024-10-01", "only row", 5)), ["seq"])
    compliance.delete_users(t, spark.createDataFrame([(500,)], "user_id long"))
    assert t.days() == ["2024-06-03"]
    assert t.read(["2024-06-04"]).count() == 0


def test_row_without_a_day_is_refused(spark, folder):
    t = DayTable(spark, folder, SCHEMA)
    with pytest.raises(ValueError):
        t.append(rows(spark, (1, 1, None, "2024-09-30", "x", 1)))
    assert t.read().count() == 0


def test_deleted_rows_leave_the_files_after_vacuum(spark, folder):
    t = table(spark, folder)
    t.upsert(rows(spark, *FIRST), ["seq"])
    ids = spark.createDataFrame([(8,)], "user_id long")
    compliance.delete_users(t, ids)
    assert compliance.stored_rows_of(t, ids).count() == 2
    t.vacuum()
    assert compliance.stored_rows_of(t, ids).count() == 0
    assert t.read().count() == 2


def test_vacuum_keeps_what_an_older_reader_may_use(spark, folder):
    t = table(spark, folder)
    t.upsert(rows(spark, *FIRST), ["seq"])
    before = t.read()
    compliance.delete_users(t, spark.createDataFrame([(8,)], "user_id long"))
    t.vacuum(keep=2)
    assert before.count() == 4
    assert t.read().count() == 2


def test_half_expired_day_stays_and_boundary_is_a_choice(spark, folder):
    t = table(spark, folder)
    t.upsert(
        rows(
            spark,
            (1, 1, "2025-01-01", "2025-01-10", "expired", 1),
            (2, 1, "2025-01-01", "2025-02-10", "not yet", 2),
            (3, 1, "2025-01-02", "2025-01-20", "boundary", 3),
            (4, 1, "2025-01-03", None, "never", 4),
        ),
        ["seq"],
    )
    assert retention.expire_by_eviction_date(t, "2025-01-20", inclusive=False) == []
    assert retention.expire_by_eviction_date(t, "2025-01-20") == ["2025-01-02"]
    assert t.days() == ["2025-01-01", "2025-01-03"]


def test_drop_by_age_ignores_eviction(spark, folder):
    t = table(spark, folder)
    t.upsert(rows(spark, (1, 1, "2025-01-01", "2030-01-01", "x", 1), (2, 1, "2025-01-31", "2025-01-31", "y", 2)), ["seq"])
    assert retention.drop_old_days(t, "2025-02-01", keep_days=30) == ["2025-01-01"]
    assert retention.drop_old_days(t, "2025-03-02", keep_days=30) == []
    assert retention.drop_old_days(t, "2025-03-03", keep_days=30) == ["2025-01-31"]


def test_compaction_keeps_rows_and_reduces_files(spark, folder):
    t = DayTable(spark, folder, SCHEMA, sort=["user_id"])
    for item in FIRST:
        t.append(rows(spark, item))
    before = values(t.read(), "event_id")
    assert t.sizes()[0][2] == 4
    assert layout.compact(t, small_bytes=10) == []
    assert layout.compact(t, small_bytes=1 << 20) == ["2024-06-03"]
    assert t.sizes()[0][2] == 1
    assert values(t.read(), "event_id") == before
    assert layout.compact(t, days=["2024-06-03"]) == ["2024-06-03"]
    large = t.segments()[0]
    for item in FIRST[:2]:
        t.append(rows(spark, (item[0] + 100, 5, *item[2:])))
    assert layout.compact(t, small_bytes=large[2]) == ["2024-06-03"]
    assert len(t.segments()) == 2 and large in t.segments()
    assert t.read().count() == 6


def test_report_of_stored_days(spark, folder):
    t = DayTable(spark, folder, SCHEMA)
    t.append(rows(spark, *FIRST))
    t.append(rows(spark, (9, 1, "2024-06-04", "2024-09-30", "x", 1), (8, 1, "2024-06-03", "2024-09-30", "x", 1)))
    got = reports.day_table_report(t, slow=2, stop=3)
    assert values(got.select("partition_name", "row_count", "files", "level")) == [
        ("p20240603", 5, 2, "slow"),
        ("p20240604", 1, 1, "ok"),
    ]


def test_equal_arrivals_give_the_same_row_every_time(spark, folder):
    items = [(1, 1, "2024-06-03", "2024-09-30", p, 1) for p in "abcdef"]
    found = set()
    for order in (items, items[::-1]):
        t = table(spark, f"{folder}{len(found)}{order[0][4]}")
        t.upsert(rows(spark, *order), ["seq"])
        found.add(t.read().first()["payload"])
    assert len(found) == 1


def test_update_where_and_from_staging(spark, folder):
    t = table(spark, folder)
    t.upsert(rows(spark, *FIRST), ["seq"])
    t.rewrite(
        lambda r: compliance.update_where(r, F.col("user_id") == 15, {"payload": F.lit("updated value")}),
        ["2024-06-03"],
    )
    assert t.read().where("user_id = 15").first()["payload"] == "updated value"
    staging = spark.createDataFrame(
        [("2025-02-01", "UPDATE", 8, "2025-05-01"), ("2025-02-01", "UPDATE", 8, "2025-06-01"), ("2025-02-01", "UPDATE", 23, None), ("2025-02-02", "UPDATE", 15, "2025-07-01")],
        "b string, operation string, user_id long, n string",
    ).select(F.to_date("b").alias("batch_date"), "operation", "user_id", F.to_date("n").alias("new_eviction_date"))
    updates = compliance.staged_updates(staging, "2025-02-01")
    assert values(compliance.conflicting_updates(updates).select("user_id", "requests")) == [(8, 2)]
    compliance.update_users(t, updates)
    got = dict(values(t.read().select("event_id", F.col("eviction_date").cast("string"))))
    assert got == {31: "2025-06-01", 32: "2024-09-30", 33: "2025-06-01", 34: "2024-09-30"}


def test_rows_without_a_user_survive_and_stay_nullable(spark, folder):
    t = table(spark, folder)
    t.upsert(rows(spark, *FIRST), ["seq"])
    t.rewrite(lambda r: compliance.pseudonymize(r, F.col("user_id") == 8), ["2024-06-03"])
    assert t.read().where("user_id IS NULL").count() == 2
    compliance.delete_users(t, spark.createDataFrame([(15,)], "user_id long"))
    assert t.read().count() == 3


def test_delta_without_a_day_is_refused(spark, folder):
    t = table(spark, folder, "read")
    with pytest.raises(Exception, match="rows without event_date"):
        t.upsert(rows(spark, (1, 1, None, "2024-09-30", "x", 1)), ["seq"])
    assert t.read().count() == 0


def test_vacuum_keeps_unmerged_deltas(spark, folder):
    t = table(spark, folder, "read")
    t.upsert(rows(spark, *FIRST), ["seq"])
    t.upsert(rows(spark, (31, 8, "2024-06-04", "2024-09-30", "moved", 5)), ["seq"])
    assert t.vacuum() == []
    assert t.read().count() == 4
    t.fold()
    assert len(t.vacuum()) == 2
    assert values(t.read().select("event_id"), "event_id") == [(31,), (32,), (33,), (34,)]


def test_files_are_sorted_and_ids_and_days_reach_the_scan(spark, folder):
    t = table(spark, folder)
    items = [(i, (i * 37) % 101, f"2024-06-0{3 + i % 2}", "2024-09-30", "x", i) for i in range(200)]
    t.upsert(rows(spark, *items), ["seq"])
    for day in t.days():
        users = [r["user_id"] for r in t.read([day]).coalesce(1).select("user_id").collect()]
        assert users == sorted(users)
    found = t.read().where(F.col("user_id").isin([5, 7]) & (F.col("event_date") == "2024-06-03"))
    plan = plan_of(found.select("event_id"))
    assert "In(user_id, [5,7])" in plan and "PartitionFilters: [isnotnull(event_date" in plan
    assert "payload" not in plan.split("ReadSchema")[1]
    assert t.days_with(spark.createDataFrame([(5,)], "user_id long"), ["user_id"]) == {
        f"2024-06-0{3 + i % 2}" for i in range(200) if (i * 37) % 101 == 5
    }
    assert t.days_with(spark.createDataFrame([], "user_id long"), ["user_id"]) == set()


def test_long_id_list_finds_the_same_days(spark, folder, monkeypatch):
    t = table(spark, folder)
    t.upsert(rows(spark, *FIRST, (9, 9, "2024-06-05", "2024-09-30", "x", 9)), ["seq"])
    ids = spark.createDataFrame([(9,), (77,)], "user_id long")
    assert t.days_with(ids, ["user_id"]) == {"2024-06-05"}
    monkeypatch.setattr("sediment.sources.day_table.FEW_IDS", 1)
    assert t.days_with(ids, ["user_id"]) == {"2024-06-05"}


@pytest.mark.parametrize("mode", ["write", "read"])
def test_random_changes_agree_with_a_dictionary(spark, folder, mode):
    draw = random.Random(11)
    t, model, seq = table(spark, folder, mode), {}, 0
    for step in range(6):
        batch = []
        for _ in range(12):
            seq += 1
            batch.append((draw.randint(1, 15), draw.randint(1, 4), f"2025-01-0{draw.randint(1, 4)}", "2024-09-30", f"p{seq}", seq))
        t.upsert(rows(spark, *batch), ["seq"], ("job", step))
        model.update({b[0]: (b[1], b[2], b[4]) for b in batch})
        if step == 3:
            t.fold()
        if step == 4:
            compliance.delete_users(t, spark.createDataFrame([(2,)], "user_id long"))
            model = {k: v for k, v in model.items() if v[0] != 2}
        got = t.read().select("event_id", "user_id", F.col("event_date").cast("string"), "payload")
        assert values(got, "event_id") == [(k, *model[k]) for k in sorted(model)]
    t.fold()
    t.vacuum()
    assert t.read().count() == len(model)
    assert set(t.days()) == {v[1] for v in model.values()}


def second_writer(monkeypatch, t, other, during):
    """``other`` runs once, just before ``t`` writes its rows."""
    plain, left = getattr(t, during), [other]

    def with_other(*args, **named):
        if left:
            left.pop()()
        return plain(*args, **named)

    monkeypatch.setattr(t, during, with_other)


@pytest.mark.parametrize("change", ["fold", "upsert", "rewrite", "merge", "drop"])
def test_a_change_by_a_second_writer_is_never_lost(spark, folder, monkeypatch, change):
    mode = "read" if change in ("fold", "drop") else "write"
    t, rival = table(spark, folder, mode), table(spark, folder, "read" if mode == "read" else "write")
    t.upsert(rows(spark, *FIRST), ["seq"])
    if change == "drop":
        t.fold()
    if change == "merge":
        t.append(rows(spark, (40, 1, "2024-06-03", "2024-09-30", "x", 1)))
    late = rows(spark, (90, 1, "2024-06-03", "2024-09-30", "late", 9))
    add = (lambda: rival.upsert(late, ["seq"], ("job", 1))) if mode == "read" else (lambda: rival.append(late, ("job", 1)))
    second_writer(monkeypatch, t, add, "_publish" if change == "drop" else "_write")
    ids = spark.createDataFrame([(8,)], "user_id long")
    work = {
        "fold": t.fold,
        "upsert": lambda: t.upsert(rows(spark, (31, 8, "2024-06-03", "2024-09-30", "new", 5)), ["seq"]),
        "rewrite": lambda: compliance.delete_users(t, ids),
        "merge": lambda: layout.compact(t, days=["2024-06-03"]),
        "drop": lambda: t.drop_days(["2024-06-03"]),
    }[change]
    with pytest.raises(Conflict):
        work()
    assert rival.already_done(("job", 1)) and rival.read().where("event_id = 90").count() == 1
    work()
    kept = 0 if change == "drop" else 1
    assert rival.read().where("event_id = 90").count() == kept


def test_vacuum_leaves_a_folder_that_is_being_written(spark, folder):
    t = table(spark, folder)
    t.upsert(rows(spark, *FIRST), ["seq"])
    state = t.state()
    commit, days = t._write(rows(spark, (90, 1, "2024-06-04", "2024-09-30", "slow", 9)), state["version"] + 1)
    assert t.vacuum() == []
    t._publish(state, base={**state["base"], **{d: [commit] for d in days}})
    assert t.read().count() == 5
    t._write(rows(spark, (91, 1, "2024-06-04", "2024-09-30", "never published", 9)), 99)
    assert len(t.vacuum(grace_seconds=0)) == 1 and t.read().count() == 5


def test_nightly_batch_leaves_other_dates_staged_and_proves_removal(spark, folder):
    t = table(spark, f"{folder}/t")
    t.upsert(rows(spark, *FIRST), ["seq"])
    staging = DayTable(spark, f"{folder}/s", compliance.STAGING_SCHEMA, day="batch_date")
    evidence = DayTable(spark, f"{folder}/e", compliance.EVIDENCE_SCHEMA, day="batch_date")
    staged = [("2024-07-20", "DELETE", 8, None), ("2024-07-21", "DELETE", 15, None)]
    staging.append(spark.createDataFrame(staged, "d string, operation string, user_id long, n string").select(F.to_date("d").alias("batch_date"), "operation", "user_id", F.to_date("n").alias("new_eviction_date")))
    compliance.nightly_batch(t, staging, evidence, "2024-07-20")
    assert values(t.read().select("user_id"), "user_id") == [(15,), (23,)]
    assert values(staging.read().select("user_id")) == [(15,)]
    assert compliance.stored_rows_of(t, spark.createDataFrame([(8,)], "user_id long")).count() == 0
    row = evidence.read().first()
    assert row.user_id == 8 and row.deleted_at <= row.removed_at
    compliance.nightly_batch(t, staging, evidence, "2024-07-21")
    assert values(t.read().select("user_id")) == [(23,)] and staging.read().count() == 0
    assert evidence.read().count() == 2


def test_physical_check_finds_rows_in_files_nobody_published(spark, folder):
    t = table(spark, f"{folder}/t")
    t.upsert(rows(spark, *FIRST), ["seq"])
    t._write(rows(spark, (91, 8, "2024-06-04", "2024-09-30", "stray", 9)), 99)
    staging = DayTable(spark, f"{folder}/s", compliance.STAGING_SCHEMA, day="batch_date")
    staging.append(spark.sql("SELECT DATE'2024-07-20' AS batch_date, 'DELETE' AS operation, 8L AS user_id, CAST(NULL AS DATE) AS new_eviction_date"))
    evidence = DayTable(spark, f"{folder}/e", compliance.EVIDENCE_SCHEMA, day="batch_date")
    with pytest.raises(RuntimeError, match="still in files"):
        compliance.nightly_batch(t, staging, evidence, "2024-07-20")
    assert evidence.read().count() == 0

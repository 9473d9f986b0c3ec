import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F
from rosterkit.plans import archive, delivery, reports
from rosterkit.schema import RUNS
from rosterkit.sources import sinks
from rosterkit.streaming import deliveries, leases, requests


def write(folder, name, **fields):
    (folder / name).write_text(json.dumps(fields, indent=1))


def test_request_stream_end_to_end(spark, alias, tmp_path):
    inbox, queue, store = tmp_path / "in", tmp_path / "queue", str(tmp_path / "store")
    inbox.mkdir()
    queue.mkdir()
    (inbox / "a.csv").write_text("Name,Gender,Born,Contract No\nAda Mara,F,1990-01-15,P1\nBen Okto,M,1985-02-01,P2\n")
    (inbox / "b.csv").write_text("Premium,Amount\n10,1.5\n")
    base = {"company_code": "007", "email_received_date": "2024-01-31", "user": "t", "input_folder": str(inbox)}
    write(queue, "configuration_1.json", **base, files=["a.csv"])
    os.utime(queue / "configuration_1.json", (1, 1))
    write(queue, "configuration_2.json", **base, files=["a.csv", "b.csv", "none.csv"])
    write(queue, "configuration_3.json", company_code="007", files=[])
    write(queue, "CONFIGURATION_4.json", **base, files=["a.csv"])
    write(queue, "other.json", **base, files=["a.csv"])

    def work(session, admitted):
        delivery.run_requests(session, store, admitted, alias)

    requests.start_request_stream(spark, str(queue), store, str(tmp_path / "cp"), work).awaitTermination()
    runs = lambda: sorted((r.total_files, r.status, r.files_processed, r.files_failed) for r in sinks.read_table(spark, f"{store}/runs", RUNS).collect())
    assert runs() == [(1, "completed", 1, 0)]
    (refused,) = spark.read.parquet(f"{store}/quarantine").collect()
    assert len(refused.problems) == 2
    requests.retry_deferred(spark, store, work)
    assert runs() == [(1, "completed", 1, 0), (3, "failed", 1, 2)]
    requests.retry_deferred(spark, store, work)
    assert len(runs()) == 2
    # Both runs delivered the same file, so the report still has each person once.
    assert reports.read_reports(spark, store).count() == 2
    (tracked,) = reports.tracked_parts(reports.latest_manifests(spark, store)).collect()
    assert (tracked.row_count, tracked.source_run_count) == (2, 2)
    for record in spark.read.parquet(f"{store}/run_logs").collect():
        assert spark.read.option("header", True).csv(record.output_path).count() in (1, 3)
    # Every decision is kept: the request admitted first and the one admitted later.
    assert [r.admitted for r in sinks.read_table(spark, f"{store}/queue", requests.QUEUE).collect()] == [True, True]


def test_interrupted_run_is_repeated_and_blocks_others(spark, tmp_path):
    store = str(tmp_path / "store")
    fields = ("c1", "2024-01-01 00:00:00.000", "007", "2024-01-31", '["a.csv"]', "t", "/in", None)
    queue = spark.createDataFrame([fields], "request_id string, arrival string, company_code string, "
                                  "email_received_date string, files string, user string, input_folder string, processed_at string")
    run_id = requests.with_run_id(queue).first().run_id
    running = lambda i: spark.createDataFrame([(i, "007", "2024-01-31", "", None, "running", "", "", "", 1, 0, 0)], RUNS)
    sinks.overwrite_partitions(running(run_id), f"{store}/runs", *delivery.RUN_KEYS)
    assert requests.admit_and_work(spark, store, queue, 0, lambda *_: None)[0] == 1
    sinks.overwrite_partitions(running(5), f"{store}/runs", *delivery.RUN_KEYS)
    assert requests.admit_and_work(spark, store, queue, 1, lambda *_: None)[0] == 0


def request_rows(spark, *names):
    rows = [(n, f"2024-01-01 00:00:0{i}.000", "007", "2024-01-31", '["a.csv"]', "t", "/in", None) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "request_id string, arrival string, company_code string, email_received_date string, "
                                       "files string, user string, input_folder string, processed_at string")


def run_row(i, status, company="007"):
    return (i, company, "2024-01-31", "", None, status, "", "", "", 1, 0, 0)


def test_live_lease_blocks_and_expired_one_is_taken_over(spark, tmp_path):
    store = str(tmp_path / "store")
    runs = lambda: {r.run_id: r.status for r in sinks.read_table(spark, f"{store}/runs", RUNS).collect()}
    sinks.overwrite_partitions(spark.createDataFrame([run_row(5, "running")], RUNS), f"{store}/runs", *delivery.RUN_KEYS)
    holder = spark.createDataFrame([(5, "007", "2024-01-31")], "run_id long, company_code string, email_received_date string")
    taken = leases.acquire(spark, store, holder, 1000)
    assert taken.first().fence == 1
    seen = []

    def work(session, admitted):
        seen.extend((r.fence, r.run_id) for r in admitted.collect())

    assert requests.admit_and_work(spark, store, request_rows(spark, "c1"), 0, work)[0] == 0 and seen == []
    leases.renew(spark, store, taken, -1)  # it has not been heard of since
    assert requests.admit_and_work(spark, store, request_rows(spark, "c1"), 1, work)[0] == 1
    assert [fence for fence, _ in seen] == [2] and runs() == {5: "failed"}
    latest = {r.fence: r.expires_at for r in leases.read_leases(spark, store).collect()}
    assert latest[2] == 0 and latest[1] > 0
    # The holder comes back late: its renewal blocks nobody, and its number is too low to publish.
    leases.renew(spark, store, taken, 1000)
    sinks.overwrite_partitions(spark.createDataFrame([run_row(7, "completed")], RUNS), f"{store}/runs", *delivery.RUN_KEYS)
    assert requests.admit_and_work(spark, store, request_rows(spark, "c2"), 2, work)[0] == 1 and seen[-1][0] == 3
    keys = holder.drop("run_id")
    reports.compile_reports(spark, store, keys.withColumn("fence", F.lit(3)))
    with pytest.raises(reports.StaleWriter):
        reports.compile_reports(spark, store, keys.withColumn("fence", F.lit(1)))
    assert leases.acquire(spark, store, holder, 1).first().fence == 4


def test_lease_is_renewed_while_the_work_lasts(spark, tmp_path):
    store = str(tmp_path / "store")
    admitted = spark.createDataFrame([(1, "007", "2024-01-31")], "run_id long, company_code string, email_received_date string")
    with pytest.raises(RuntimeError):
        with leases.held(spark, store, admitted, 3) as taken:
            first = taken.first().expires_at
            time.sleep(6)
            assert leases.read_leases(spark, store).first().expires_at > first
            raise RuntimeError
    assert leases.read_leases(spark, store).first().expires_at == 0


def test_watch_runs_waiting_requests_without_a_restart(spark, tmp_path):
    """Three requests of one key and one of a key that another job holds for some seconds, in one running query."""
    queue, store = tmp_path / "queue", str(tmp_path / "store")
    queue.mkdir()
    base = {"email_received_date": "2024-01-31", "files": ["a.csv"], "user": "t", "input_folder": "/in"}
    for i in range(3):
        write(queue, f"configuration_{i}.json", company_code="007", **base)
        os.utime(queue / f"configuration_{i}.json", (i + 1, i + 1))
    write(queue, "configuration_8.json", company_code="008", **base)
    write(queue, "configuration_9.json", company_code="009", files=[])
    sinks.overwrite_partitions(spark.createDataFrame([run_row(5, "running", "008")], RUNS), f"{store}/runs", *delivery.RUN_KEYS)
    leases.acquire(spark, store, spark.createDataFrame([(5, "008", "2024-01-31")], "run_id long, company_code string, email_received_date string"), 15)
    order = []

    def work(session, admitted):
        rows = admitted.collect()
        assert len({r.company_code for r in rows}) == len(rows)
        order.extend((r.company_code, r.request_id[-6:-5]) for r in rows)

    query = requests.start_request_watch(spark, str(queue), store, str(tmp_path / "cp"), work, every="1 second", retry_seconds=0.1)
    try:
        end = time.time() + 120
        while len(order) < 4 and time.time() < end and query.isActive:
            time.sleep(0.5)
    finally:
        query.stop()
    assert query.exception() is None
    assert [n for c, n in order if c == "007"] == ["0", "1", "2"] and sorted(order)[-1] == ("008", "8") and len(order) == 4
    assert len(spark.read.parquet(f"{store}/quarantine").collect()) == 1
    assert sinks.read_table(spark, f"{store}/runs", RUNS).filter("run_id = 5").first().status == "failed"


def test_only_files_without_errors_are_archived(spark, alias, tmp_path):
    inbox, store, done = tmp_path / "in box", str(tmp_path / "store"), tmp_path / "done"
    inbox.mkdir()
    (inbox / "good %41.csv").write_text("Name,Gender\nAda Mara,F\n")
    (inbox / "bad.csv").write_text("Premium,Amount\n10,1.5\n")
    with zipfile.ZipFile(inbox / "half.zip", "w") as z:
        z.writestr("x.csv", "Name,Gender\nBen Okto,M\n")
        z.writestr("y.csv", "Premium,Amount\n10,1.5\n")
    fields = "run_id bigint, company_code string, email_received_date string, files string, input_folder string, user string"
    asked = json.dumps(["good %41.csv", "bad.csv", "half.zip", "none.csv"])
    admitted = spark.createDataFrame([(5, "A1", "2024-01-31", asked, str(inbox), "t")], fields)
    delivery.run_requests(spark, store, admitted, alias, archive_folder=str(done))
    assert sorted(p.name for p in inbox.iterdir()) == ["bad.csv", "half.zip"]
    assert [p.relative_to(done).as_posix() for p in done.rglob("*.csv")] == ["5/good %41.csv"]
    (moved,) = archive.read_archived(spark, store).collect()
    assert moved.moved and moved.run_id == 5
    # The same batch again, as after a failure before its commit: the run is not repeated without its file.
    delivery.run_requests(spark, store, admitted, alias, archive_folder=str(done))
    assert reports.read_reports(spark, store).count() == 2
    assert archive.read_archived(spark, store).first().moved


def test_delivery_stream_catalogs_and_archives(spark, tmp_path):
    inbox, done = tmp_path / "in", tmp_path / "done"
    inbox.mkdir()
    for i in range(3):
        (inbox / f"f{i}.csv").write_text("a,b\n")
    (inbox / "note.json").write_text("{}")
    (inbox / "sub").mkdir()
    (inbox / "sub" / "f1.csv").write_text("a,b\n")  # the same name, to be moved in the same batch or another one
    table = str(tmp_path / "table")

    def check(session, files):
        return files.filter("file_name = 'f2.csv'").select(F.col("path").alias("file_path"), F.lit("ValueError: x").alias("error_msg"))

    def start():
        deliveries.start_delivery_catalog(spark, str(inbox), table, str(tmp_path / "cp"), str(done), check, per_batch=2).awaitTermination()

    start()
    rows = spark.read.parquet(table).collect()
    assert sorted(r.file_name for r in rows) == ["f0.csv", "f1.csv", "f1.csv", "f2.csv"]
    assert sorted(p.name for p in inbox.rglob("*.csv")) == ["f2.csv"]
    assert sorted(p.name.replace("_1", "") for p in done.rglob("*.csv")) == ["f0.csv", "f1.csv", "f1.csv"]
    # The last batch is repeated as if it had not been committed: nothing changes.
    for commit in sorted((tmp_path / "cp" / "commits").iterdir())[-1:] + sorted((tmp_path / "cp" / "commits").glob(".*.crc"))[-1:]:
        commit.unlink(missing_ok=True)
    start()
    assert spark.read.parquet(table).count() == 4 and len(list(done.rglob("*.csv"))) == 3


def test_archive_members_belong_to_their_delivered_file(spark, alias, tmp_path):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    with zipfile.ZipFile(inbox / "z.zip", "w") as z:
        z.writestr("people.csv", "Name,Gender\nAda Mara,F\n")
    admitted = spark.createDataFrame(
        [(5, "A1", "2024-01-31", '["z.zip"]', str(inbox), "t")],
        "run_id bigint, company_code string, email_received_date string, files string, input_folder string, user string",
    )
    delivery.run_requests(spark, store, admitted, alias)
    (row,) = reports.read_reports(spark, store).collect()
    assert row.COMPLETE_NAME == "ADA MARA" and row.FILE_PATH.endswith("people.csv")
    (run,) = sinks.read_table(spark, f"{store}/runs", RUNS).collect()
    assert (run.status, run.files_processed) == ("completed", 1)


def test_folder_header_report(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    (tmp_path / "a.csv").write_text("Member Name,Gender\n" + "".join(f"Ada {c},F\n" for c in "abcdef"))
    (tmp_path / "b.csv").write_text("Name,Whole Name\n" + "".join(f"Ben {c},Ben {c}\n" for c in "abcdef"))
    written, none = str(tmp_path / "out" / "report"), str(tmp_path / "out" / "none")
    report, errors = delivery.folder_header_report(spark, str(tmp_path), written)
    assert [(r.file_path[-5:], r.header) for r in report.collect()] == [("a.csv", "Member Name"), ("a.csv", "Gender"), ("b.csv", "Name"), ("b.csv", "Whole Name")]
    empty, _ = delivery.folder_header_report(spark, str(tmp_path / "empty"), none)
    assert empty.columns == report.columns and empty.count() == 0 and spark.read.parquet(none).columns == report.columns
    report = report.filter(F.col("file_path").endswith("a.csv"))
    assert [(r.header, r.category) for r in report.collect()] == [("Member Name", "Name"), ("Gender", "Sex")]
    assert errors.isEmpty()


def test_watched_table_is_empty_until_its_first_files_are_there(spark, tmp_path):
    from rosterkit.queries import streams

    assert streams._ran(spark, str(tmp_path)).count() == 0
    (tmp_path / "ran" / "_temporary").mkdir(parents=True)
    assert streams._ran(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([("007", "2024-01-31", "t", 1)], streams._RAN).write.mode("append").parquet(str(tmp_path / "ran"))
    assert [r.company_code for r in streams._ran(spark, str(tmp_path)).collect()] == ["007"]


def test_lease_is_found_while_it_is_renewed(spark, tmp_path):
    """A renewal removed the file that a reader had listed."""
    store = str(tmp_path / "store")
    holder = spark.createDataFrame([(5, "007", "2024-01-31")], "run_id long, company_code string, email_received_date string")
    taken = leases.acquire(spark, store, holder, 100)
    seen = leases.read_leases(spark, store)
    leases.renew(spark, store, taken, 5000)
    (lease,) = seen.collect()
    assert (lease.fence, lease.run_id, lease.company_code) == (1, 5, "007") and lease.expires_at > time.time() + 1000
    assert len(list((tmp_path / "store" / "leases").rglob("*.parquet"))) == 1

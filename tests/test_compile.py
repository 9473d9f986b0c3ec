import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rosterkit.operators import compile as comp
from rosterkit.operators import joins, requests as req
from rosterkit.operators.numbering import number_parts, number_within
from rosterkit.plans import delivery, reports
from rosterkit.schema import FILE_LOGS, ROSTER_COLUMNS, RUNS
from rosterkit.sources import sinks
from rosterkit.sources.storage import literal_path


def run(run_id, status="completed", company="007", day="2024-01-31"):
    return (run_id, company, day, "2024-02-01T00:00:00", None, status, "x", "y", "/out", 1, 1, 0)


def log(run_id, output, n=1):
    return (1, run_id, output, "a.csv", "csv", "", 1, None, None, False, 1, n, output, None, None, None, None, None, None, None)


def person(output, name, sheet="2601", run_id=1, company="007", day="2024-01-31"):
    return ("", "", name, "F", "", company, "00123", output, sheet, company, day, run_id)


PEOPLE = ", ".join(f"{c} string" for c in [*ROSTER_COLUMNS, *comp.REPORT_KEY]) + ", run_id long"


def deliver(spark, path, people):
    """Write roster rows and their index."""
    index = sinks.write_rosters(spark.createDataFrame(people, PEOPLE), f"{path}/rosters")
    sinks.write_output_index(index, f"{path}/output_index")
    return {(r.run_id, r.file_path): r.output_path for r in index.collect()}


def record(spark, path, runs, logs, places):
    """Write runs and their logs, with the folders of the outputs that were written."""
    sinks.overwrite_partitions(spark.createDataFrame(runs, RUNS), f"{path}/runs", *delivery.RUN_KEYS)
    logs = [(*x[:12], places.get((x[1], x[12]), x[12]), *x[13:]) for x in logs]
    sinks.overwrite_partitions(spark.createDataFrame(logs, FILE_LOGS), f"{path}/file_logs", "run_id")


@pytest.fixture
def store(spark, tmp_path):
    def build(runs, logs, people):
        path = str(tmp_path / "store")
        record(spark, path, runs, logs, deliver(spark, path, people))
        return path

    return build


def compiled(spark, path):
    return reports.read_reports(spark, path)


def keys(spark):
    return spark.createDataFrame([("007", "2024-01-31")], comp.REPORT_KEY)


def test_union_of_runs_distinct_and_text_kept(spark, store):
    path = store(
        [run(1), run(2, "failed"), run(3, "running")],
        [log(1, "o1"), log(2, "o1"), log(3, "o1")],
        [person("o1", "ADA"), person("o1", "BEN"), person("o1", "ADA", run_id=2), person("o1", "CY", run_id=2),
         person("o1", "DAN", run_id=3), person("unlogged", "EVE")],
    )
    (tracked,) = delivery.compile_reports(spark, path, keys(spark)).collect()
    assert spark.read.parquet(tracked.output_path).count() == 3
    (summary,) = reports.latest_manifests(spark, path).collect()
    assert (summary.total_rows, summary.part_count, summary.source_run_count, summary.skipped_files) == (3, 1, 2, 0)
    assert (tracked.row_count, tracked.part_number, tracked.source_run_count) == (3, 1, 2)
    rows = compiled(spark, path)
    assert sorted(r.COMPLETE_NAME for r in rows.collect()) == ["ADA", "BEN", "CY"]
    assert {(r.SHEET, r.CMPY_NO, r.POLICY_NUMBER) for r in rows.collect()} == {("2601", "007", "00123")}


def test_parts_shrink_and_no_stale_part_stays(spark, store):
    many = [person("o1", f"N{i}") for i in range(5)]
    path = store([run(1)], [log(1, "o1")], many)
    first = delivery.compile_reports(spark, path, keys(spark), rows_per_part=2).collect()
    assert sorted((r.part_number, r.row_count) for r in first) == [(1, 2), (2, 2), (3, 1)]
    again = delivery.compile_reports(spark, path, keys(spark), rows_per_part=2).collect()
    assert sorted((r.part_number, r.row_count) for r in again) == [(1, 2), (2, 2), (3, 1)]
    deliver(spark, path, many[:2])
    last = delivery.compile_reports(spark, path, keys(spark), rows_per_part=2).collect()
    assert [(r.part_number, r.row_count) for r in last] == [(1, 2)]
    assert compiled(spark, path).count() == 2
    assert len(list(Path(path, "compiled").rglob("*.parquet"))) == 1


def test_next_run_reads_its_own_rows_and_the_hashes_only(spark, store):
    path = store([run(1)], [log(1, "a")], [person("a", f"N{i}") for i in range(5)])
    delivery.compile_reports(spark, path, keys(spark), rows_per_part=2)
    (first,) = reports.latest_manifests(spark, path).collect()
    full = [p.output_path for p in first.parts[:2]]
    # The rows of the first run cannot be read any more; its outputs are still listed.
    for file in Path(path, "rosters").rglob("*.parquet"):
        file.write_bytes(b"")
    places = deliver(spark, path, [person("a", f"N{i}", run_id=2) for i in range(3, 8)] + [person("b", "N1", run_id=2)])
    record(spark, path, [run(2)], [log(2, "a"), log(2, "b")], places)
    delivery.compile_reports(spark, path, keys(spark), rows_per_part=2)
    (second,) = reports.latest_manifests(spark, path).collect()
    assert [p.output_path for p in second.parts[:2]] == full
    assert [(p.part_number, p.row_count) for p in second.parts] == [(1, 2), (2, 2), (3, 2), (4, 2), (5, 1)]
    assert (second.total_rows, second.source_run_count, second.base_versions) == (9, 2, [1, 2])
    rows = compiled(spark, path).collect()
    assert sorted((r.COMPLETE_NAME, r.FILE_PATH) for r in rows) == sorted([(f"N{i}", "a") for i in range(8)] + [("N1", "b")])
    assert len(list(Path(path, "compiled").rglob("*.parquet"))) == 5
    # Nothing new: the same parts under a new manifest.
    delivery.compile_reports(spark, path, keys(spark), rows_per_part=2)
    (third,) = reports.latest_manifests(spark, path).collect()
    assert (third.parts, third.version) == (second.parts, 3)


def test_increments_give_what_a_rebuild_gives(spark, store, tmp_path):
    def people(run_id):
        return [person(f"f{run_id % 2}", f"N{(i * run_id) % 23}", run_id=run_id, company=c) for i in range(12) for c in ("007", "x y:z")]

    both = spark.createDataFrame([(c, "2024-01-31") for c in ("007", "x y:z")], comp.REPORT_KEY)
    path = str(tmp_path / "store")
    for run_id in (1, 3, 4, 6):
        runs = [run(run_id * 10 + k, company=c) for k, c in enumerate(("007", "x y:z"))]
        rows = [(*p[:11], run_id * 10 + (p[9] != "007")) for p in people(run_id)]
        logs = [log(r[0], f"f{run_id % 2}") for r in runs]
        record(spark, path, runs, logs, deliver(spark, path, rows))
        delivery.compile_reports(spark, path, both, rows_per_part=4)
    grown = sorted(map(repr, compiled(spark, path).drop("part_number").collect()))
    sizes = sorted((m.company_code, [p.row_count for p in m.parts]) for m in reports.latest_manifests(spark, path).collect())
    delivery.compile_reports(spark, path, both, rows_per_part=5)  # other parts: all is built again
    assert sorted(map(repr, compiled(spark, path).drop("part_number").collect())) == grown
    assert all(sum(s) == len(grown) // 2 and all(n == 4 for n in s[:-1]) for _, s in sizes) and len(grown) == len(set(grown))
    assert {len(m.base_versions) for m in reports.latest_manifests(spark, path).collect()} == {1}


def test_report_without_rows_has_no_parts_and_no_files(spark, store):
    path = store([run(1), run(2, company="008")], [log(1, "a"), log(2, "a")], [person("a", "ADA"), person("a", "BEN", run_id=2, company="008")])
    both = spark.createDataFrame([("007", "2024-01-31"), ("008", "2024-01-31")], comp.REPORT_KEY)
    assert delivery.compile_reports(spark, path, both).count() == 2
    record(spark, path, [run(1)], [log(1, "a")], {})  # the log names an output that is not there
    assert [r.company_code for r in delivery.compile_reports(spark, path, both).collect()] == ["008"]
    empty = {m.company_code: m for m in reports.latest_manifests(spark, path).collect()}["007"]
    assert (empty.total_rows, empty.part_count, empty.parts, empty.skipped_files) == (0, 0, [], 1)
    assert [r.COMPLETE_NAME for r in compiled(spark, path).collect()] == ["BEN"]
    assert len(list(Path(path, "compiled").rglob("*.parquet"))) == 1


def test_older_fencing_number_is_not_published(spark, store):
    path = store([run(1)], [log(1, "a")], [person("a", "ADA")])
    delivery.compile_reports(spark, path, keys(spark).withColumn("fence", F.lit(7)))
    with pytest.raises(reports.StaleWriter):
        delivery.compile_reports(spark, path, keys(spark).withColumn("fence", F.lit(5)))
    (manifest,) = reports.latest_manifests(spark, path).collect()
    assert manifest.version == 7 and compiled(spark, path).count() == 1


def test_outputs_are_cut_into_parts_that_the_index_names(spark, tmp_path):
    path = str(tmp_path / "odd [x] {y}")
    people = [person("/in/a b%20.csv", f"N{i}", company="a:b/c") for i in range(7)] + [person("c", "C", sheet="")]
    index = sinks.write_rosters(spark.createDataFrame(people, PEOPLE), f"{path}/rosters", rows_per_file=3).collect()
    assert sorted((r.file_path, r.part_number, r.row_count) for r in index) == [("/in/a b%20.csv", 1, 3), ("/in/a b%20.csv", 2, 3), ("/in/a b%20.csv", 3, 1), ("c", 1, 1)]
    for r in index:
        assert spark.read.parquet(literal_path(r.output_path)).count() == r.row_count
        assert len(list(Path(r.output_path.replace("file:", "", 1)).glob("*.parquet"))) == 1


def test_missing_output_is_skipped_and_reported(spark):
    runs, logs = spark.createDataFrame([run(1)], RUNS), spark.createDataFrame([log(1, "o1"), log(1, "gone")], FILE_LOGS)
    eligible = comp.eligible_outputs(logs, runs)
    stored = spark.createDataFrame([("o1",)], "output_path string")
    assert [r.output_path for r in comp.skipped_outputs(eligible, stored).collect()] == ["gone"]


def test_zero_row_rebuild_makes_every_part_stale(spark):
    tracked = spark.createDataFrame([("007", "2024-01-31", 1, "p1"), ("008", "2024-01-31", 1, "p2")], "company_code string, email_received_date string, part_number bigint, output_path string")
    summary = spark.createDataFrame([], "company_code string, email_received_date string, part_number bigint")
    rebuilt = comp.rebuilt_reports(keys(spark), summary)
    assert [r.output_path for r in comp.stale_parts(tracked, rebuilt).collect()] == ["p1"]


def test_numbering_matches_a_window_on_a_hot_key(spark):
    """Two thirds of the rows share one key, some keys are null."""
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 5 == 0, F.lit(None)).otherwise((F.col("id") % 7).cast("string")).alias("k"),
        F.xxhash64("id").alias("v"),
    )
    from pyspark.sql import Window

    want = {(r.k, r.v): r.n for r in df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v"))).collect()}
    assert {(r.k, r.v): r.n for r in number_within(df, ["k"], ["v"], "n").collect()} == want
    sizes = number_parts(df, ["k"], ["v"], 100).groupBy("k", "part_number").count()
    assert sizes.agg(F.max("count"), F.sum("count")).first() == (100, 5000)


def test_guarded_join_gives_the_same_rows_both_ways(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left"):
        rows = [sorted(joins.join_small(big, small, ["k"], how, limit=n).collect()) for n in (10**9, 0)]
        assert rows[0] == rows[1] and len(rows[0]) > 1500


def test_large_small_side_is_neither_collected_nor_copied_without_bound(spark, monkeypatch):
    big = spark.range(4000).select((F.col("id") % 1000).alias("k"), "id")
    small = spark.range(100_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("w"))  # 15 MB

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    joined = joins.join_small(big, small, ["k"])
    assert "broadcast" not in plan(joined) and joined.count() == 4000
    monkeypatch.setattr(joins, "COPIED_BYTES", joins.BROADCAST_LIMIT_BYTES)
    single = joins.join_small(big, small, ["k"])
    assert "Generate" not in plan(single) and sorted(single.collect()) == sorted(joined.select(*single.columns).collect())


def test_upsert_latest_wins(spark):
    schema = "company_code string, email_received_date string, part_number bigint, output_path string, last_updated_at string"
    old = spark.createDataFrame([("a", "d", 1, "x", "1"), ("a", "d", 2, "y", "1")], schema)
    new = spark.createDataFrame([("a", "d", 1, "z", "2")], schema)
    assert sorted(r.output_path for r in comp.upsert_compiled(old, new).collect()) == ["y", "z"]


def request(i, company="A", day="2024-01-31", files='["f.csv"]', at="1"):
    return (str(i), at, company, day, files)


REQUESTS = "request_id string, arrival string, company_code string, email_received_date string, files string"


def test_request_problems(spark):
    rows = [request(1), request(2, None, None, None), request(3, files="[]"), request(4, files='"f"'), request(5, day="01/31/2024")]
    found = {r.request_id: r.problems for r in req.validate_requests(spark.createDataFrame(rows, REQUESTS)).collect()}
    assert found["1"] == []
    assert found["2"] == [req.MISSING_FIELD + f for f in req.REQUIRED_FIELDS]
    assert (found["3"], found["4"], found["5"]) == ([req.FILES_EMPTY], [req.FILES_NOT_LIST], [req.BAD_DATE])


def test_one_admission_per_key(spark):
    rows = [request(1, at="2"), request(2, at="1"), request(3, "B"), request(4, "A", "2024-02-01")]
    busy = spark.createDataFrame([run(9, "running", "B"), run(8, "completed", "A")], RUNS)
    decided = req.admit(spark.createDataFrame(rows, REQUESTS), busy).collect()
    assert {r.request_id for r in decided if r.admitted} == {"2", "4"} and len(decided) == 4


def test_schema_order(spark, store):
    path = store([run(1)], [log(1, "o1")], [person("o1", "ADA")])
    assert sinks.reread_rosters(spark, f"{path}/rosters").columns[1:10] == ROSTER_COLUMNS


def tasks_of(spark, work):
    """Tasks of all jobs that the work starts."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, group)
    try:
        work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s))


def test_tasks_do_not_grow_with_the_number_of_parts(spark, tmp_path):
    """Listing a store's folders took a task for each part, whenever its rows were read."""
    people = lambda n: spark.createDataFrame([person("a", f"N{i:04d}") for i in range(n)], PEOPLE)
    few, many = (tasks_of(spark, lambda: sinks.write_rosters(people(n), str(tmp_path / f"s{n}"), rows_per_file=2)) for n in (20, 400))
    assert many < few + 60
    index = sinks.write_rosters(people(5), str(tmp_path / "s400"), rows_per_file=2)  # the same run again
    assert sorted(r.row_count for r in index.collect()) == [1, 2, 2]
    assert sinks.reread_rosters(spark, str(tmp_path / "s400")).groupBy("output_path").count().filter("count > 2").isEmpty()


def test_parts_without_a_company_share_the_folder_of_null(spark, tmp_path):
    people = [person("a", "A", company=None), person("a", "B", company=""), person("a", "C")]
    index = sinks.write_rosters(spark.createDataFrame(people, PEOPLE), str(tmp_path / "s"))
    assert [r.company_code for r in index.collect()] == ["007"]
    stored = sinks.reread_rosters(spark, str(tmp_path / "s")).collect()
    assert sorted((r.company_code or "", r.COMPLETE_NAME) for r in stored) == [("", "A"), ("", "B"), ("007", "C")]


def test_roster_rows_are_made_once(spark, tmp_path):
    """Sizes, small outputs, samples and numbers each made the rows again."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    people = spark.createDataFrame([person("a", f"N{i:02d}") for i in range(20)] + [person("b", "M")], PEOPLE)
    index = sinks.write_rosters(people.mapInArrow(count, people.schema), str(tmp_path / "s"), rows_per_file=3).collect()
    assert sorted(r.row_count for r in index) == [1, 2, *[3] * 6] and made.value == 21


def test_runs_are_listed_in_equal_shares(spark, tmp_path):
    """Hashes of eight paths left some of eight tasks idle and gave others several folders."""
    people = [person("a", "A", run_id=i) for i in range(8)]
    sinks.write_rosters(spark.createDataFrame(people, PEOPLE), str(tmp_path / "s")).collect()
    shares = sinks.stored_outputs(spark, str(tmp_path / "s")).groupBy(F.spark_partition_id()).count().collect()
    assert [r["count"] for r in shares] == [1] * 8

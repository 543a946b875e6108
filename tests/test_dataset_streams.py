import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meetpoint.operators import changes, matrix
from meetpoint.schemas import UNREACHABLE
from meetpoint.sources import dataset
from meetpoint.streaming import live
from meetpoint.streaming.state import Batch, KeptTables


def write_dataset(folder, n=4, bad=None):
    rng = np.random.default_rng(1)
    made = {}
    entries = {}
    for k, key in enumerate(("walk", "transit_wed08", "bike")):
        m = rng.integers(0, 3000, (n, n)).astype(np.uint16)
        m[0, 1] = UNREACHABLE
        made[key] = m
        np.save(folder / f"{key}.npy", m if bad != "shape" or key != "bike" else m[:2])
        entries[key] = {"file": f"{key}.npy", "build_hash": "h", "build_inputs": {"mode": key, "departure": None, "departure_window_min": 10}, "shape": [n, n], "wall_seconds": 1.5, "coverage_pct": 90.0, "min_seconds": 0, "max_seconds": 3600 - k}
    entries["transit_wed08"]["timezone"] = "Europe/Vienna"
    (folder / "manifest.json").write_text(json.dumps({"format_version": 2 if bad == "format" else 1, "grid_version": "v1", "grid": {"file": "grid.json", "n_cells": n}, "matrices": entries}, indent=1))
    (folder / "grid.json").write_text(json.dumps({"grid_version": "v0" if bad == "version" else "v1", "n_cells": n, "h3_res": 9, "cells": [{"id": i, "h3": f"c{i}", "lat": 48.0 + i, "lon": 16.0} for i in range(n)]}, indent=1))
    return made


def load(spark, folder):
    matrices = dataset.read_manifest(spark, f"{folder}/manifest.json")
    return matrices, dataset.read_grid(spark, f"{folder}/grid.json"), dataset.ingest_matrices(spark, str(folder), matrices)


def test_dataset_round_trip(spark, tmp_path):
    made = write_dataset(tmp_path)
    matrices, cells, rows = load(spark, tmp_path)
    assert [r.matrix_key for r in matrices.orderBy("pos").collect()] == ["walk", "transit_wed08", "bike"]
    assert dataset.dataset_timezone(matrices).first().timezone == "Europe/Vienna"
    assert dataset.dataset_timezone(matrices.where("matrix_key = 'walk'")).first().timezone == "Europe/Vienna"
    got = {(r.matrix_key, r.origin): r.seconds for r in rows.collect()}
    assert got == {(k, o): m[o].tolist() for k, m in made.items() for o in range(4)}
    checks = dataset.validate_dataset(matrices, cells, rows)
    assert checks.count() == 6 and checks.where("not ok").count() == 0
    dataset.require_valid(checks)
    profile = {r.matrix_key: r for r in matrix.matrix_profile(rows).collect()}
    for k, m in made.items():
        ok = m[m != UNREACHABLE]
        assert (profile[k].n, profile[k].min_seconds, profile[k].max_seconds) == (4, ok.min(), ok.max()) and abs(profile[k].coverage_pct - 100 * ok.size / m.size) < 0.01
    pairs = spark.createDataFrame([("walk", 0, 1), ("bike", 2, 3), ("car", 0, 0)], "matrix_key string, origin int, dest int")
    assert {r.matrix_key: r.seconds for r in matrix.od_lookup(pairs, rows).collect()} == {"walk": UNREACHABLE, "bike": made["bike"][2, 3], "car": None}
    assert {r.matrix_key: r.max_seconds for r in matrix.matrix_horizon(pairs, matrices).collect()} == {"walk": 3600, "bike": 3598, "car": None}


@pytest.mark.parametrize("bad, check", [("format", "format_version"), ("version", "grid_version"), ("shape", "matrix_shape")])
def test_partly_valid_data_are_refused(spark, tmp_path, bad, check):
    write_dataset(tmp_path, bad=bad)
    checks = dataset.validate_dataset(*load(spark, tmp_path))
    assert [r.check for r in checks.where("not ok").collect()] == [check]
    with pytest.raises(ValueError, match=check):
        dataset.require_valid(checks)


def test_bake(spark):
    trips = spark.sql("select * from values ('walk', 0, 1, 1, 100), ('walk', 0, 1, 2, 300), ('walk', 0, 1, 9, 9999), ('walk', 1, 0, 1, 4000) as t(mode, origin, dest, departed_at, seconds)")
    cells = spark.range(3).select(F.col("id").cast("int").alias("cell_id"))
    got = {r.origin: r.seconds for r in matrix.bake_matrix(trips, cells, window=(1, 9)).collect()}
    assert got == {0: [UNREACHABLE, 200, UNREACHABLE], 1: [UNREACHABLE] * 3, 2: [UNREACHABLE] * 3}


def test_bakes_of_windows_and_percentiles(spark):
    rng = np.random.default_rng(4)
    trips = [("walk" if k % 3 else "car", int(rng.integers(4)), int(rng.integers(4)), int(rng.integers(10)), int(rng.choice([5, 60, 3590, 3600, 3601, 3620, 9000]))) for k in range(900)]
    df = spark.createDataFrame(trips, "mode string, origin int, dest int, departed_at int, seconds int").repartition(3)
    cells = spark.range(4).select(F.col("id").cast("int").alias("cell_id"))
    windows, percentiles = {"": None, "early": (0, 5), "none": (50, 60), "mid": (3, 8)}, {"p50": 0.5, "p90": 0.9, "least": 0.0, "most": 1.0}
    got = {(r.mode, r.departures, r.percentile, r.origin): (r.matrix_key, r.seconds) for r in matrix.bake_matrices(df, cells, windows, percentiles).collect()}
    assert len(got) == 2 * 3 * 4 * 4
    for (mode, w, p, origin), (key, seconds) in got.items():
        assert key == "_".join(x for x in (mode, w, p) if x)
        for dest in range(4):
            s = [t[4] for t in trips if t[:3] == (mode, origin, dest) and (windows[w] is None or windows[w][0] <= t[3] < windows[w][1])]
            value = int(np.floor(np.percentile(s, 100 * percentiles[p]) + 0.5)) if s else UNREACHABLE
            assert seconds[dest] == (value if value <= 3600 else UNREACHABLE)


def test_tables_places_and_evolution(spark, tmp_path):
    old = spark.createDataFrame([(1, "a")], "id long, name string")
    new = spark.createDataFrame([(2, "b", 1.5)], "id long, name string, latitude double")
    dataset.write_results(old, f"{tmp_path}/old")
    dataset.write_results(new, f"{tmp_path}/new", partition_by=("id",))
    got = {r.id: r.latitude for r in dataset.read_evolved(spark, f"{tmp_path}/old", f"{tmp_path}/new").collect()}
    assert got == {1: None, 2: 1.5}
    for t in ("accounts", "meetups", "participants", "happenings", "occurrences"):
        spark.createDataFrame([], dataset.TABLES[t]).write.parquet(f"{tmp_path}/tables/{t}")
    tables = dataset.read_tables(spark, f"{tmp_path}/tables")
    assert sorted(tables) == ["accounts", "happenings", "meetups", "occurrences", "participants"] and tables["meetups"].count() == 0
    (tmp_path / "p.json").write_text(json.dumps({"features": [{"geometry": {"coordinates": [16.3, 48.2]}, "properties": {"osm_type": "N", "osm_id": 5, "name": "Cafe", "street": "Graben", "housenumber": "1", "city": "Wien"}}, {"geometry": {"coordinates": [1.0, 2.0]}, "properties": {}}]}))
    got = dataset.read_places(spark, f"{tmp_path}/p.json").orderBy("key").collect()
    assert [(r.key, r.label, r.context, r.lat, r.lon) for r in got] == [("?1-1", "", "", 2.0, 1.0), ("N5-0", "Cafe, Graben 1", "Wien", 48.2, 16.3)]


def test_written_data_set_is_read_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    made = {k: rng.integers(0, 4000, (50, 50)) for k in ("walk", "car", "bike")}
    made["car"][3] = UNREACHABLE
    rows = spark.createDataFrame([(k, o, m[o].tolist()) for k, m in made.items() for o in range(50)], "matrix_key string, origin int, seconds array<int>").repartition(7)
    cells = spark.createDataFrame([(i, 48 + i / 3, 16.1) for i in range(50)], "cell_id int, lat double, lon double").repartition(3)
    folder = f"{tmp_path}/set"
    dataset.write_dataset(rows, cells, folder, "v7", 3600, {"car": "Europe/Vienna"})
    matrices = dataset.read_manifest(spark, f"{folder}/manifest.json")
    assert {r.matrix_key: r.min_seconds for r in matrices.collect()} == {k: int(m[m != UNREACHABLE].min()) for k, m in made.items()}
    for key, file in [(r.matrix_key, r.file) for r in matrices.collect()]:
        assert (np.load(f"{folder}/{file}") == made[key]).all()  # as any reader of the format sees it
    for block in (1, 700, 8 << 20):
        got = dataset.ingest_matrices(spark, folder, matrices, block).collect()
        assert len(got) == 150 and all(r.seconds == made[r.matrix_key][r.origin].tolist() for r in got)
    assert sorted(map(str, dataset.whole_files(spark, folder, matrices).collect())) == sorted(map(str, got))
    grid = dataset.read_grid(spark, dataset.grid_path(spark, folder))
    dataset.require_valid(dataset.validate_dataset(matrices, grid, dataset.ingest_matrices(spark, folder, matrices)))
    assert [(r.cell_id, r.lat) for r in grid.orderBy("cell_id").collect()] == [(i, 48 + i / 3) for i in range(50)]
    for bad in (rows.where("origin <> 7 or matrix_key <> 'bike'"), rows.withColumn("seconds", F.expr("slice(seconds, 1, 50 - int(origin = 4))"))):
        with pytest.raises(ValueError, match="bike"):
            dataset.write_dataset(bad, cells, f"{tmp_path}/bad", "v7", 3600)


def test_a_matrix_of_over_two_gigabytes_is_read_by_ranges(spark, tmp_path):
    n = 33_000
    with open(f"{tmp_path}/big.npy", "wb") as f:  # a sparse file: only the last row is on disk
        np.lib.format.write_array_header_1_0(f, {"descr": "<u2", "fortran_order": False, "shape": (n, n)})
        start = f.tell()
        f.seek(start + 2 * n * (n - 1))
        f.write((np.arange(n) % 60_000).astype("<u2").tobytes())
    named = spark.createDataFrame([("walk", "big.npy")], "matrix_key string, file string")
    uri = dataset.shared_uri(spark, str(tmp_path))
    ranges = dataset.matrix_ranges(named, uri, 8 << 20)
    assert ranges.agg(F.sum("rows"), F.max("rows")).first()[:] == (n, (8 << 20) // (2 * n))
    last = dataset.read_ranges(ranges.where(F.col("first") + F.col("rows") == n), uri).orderBy("origin").collect()
    assert last[-1].origin == n - 1 and last[-1].seconds == (np.arange(n) % 60_000).tolist() and set(last[0].seconds) == {0}


def test_short_and_strange_files_are_refused(spark, tmp_path):
    np.save(tmp_path / "short.npy", np.zeros((9, 9), np.uint16))
    with open(tmp_path / "short.npy", "r+b") as f:
        f.truncate(200)
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.zeros((3, 4), np.uint16)))
    for file, what in (("short.npy", "ends before"), ("columns.npy", "stored by row")):
        with pytest.raises(Exception, match=what):
            dataset.ingest_matrices(spark, str(tmp_path), spark.createDataFrame([("walk", file)], "matrix_key string, file string")).collect()


def test_tables_over_jdbc(spark):
    url = "jdbc:derby:memory:meetpoint;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    values = {"string": "'a' || id", "double": "id + 0.5D", "bigint": "id", "boolean": "id % 2 = 0", "timestamp": "timestamp'2026-01-01 10:00:00'", "timestamp_ntz": "timestamp'2026-01-01 11:00:00'", "date": "date'2026-01-01'", "array<string>": "'[\"x\", \"y\"]'", "map<string,string>": "'{\"k\": \"v\"}'"}
    for name, schema in dataset.TABLES.items():  # one column more than is read
        columns = [f"{values[k.lower()]} as {c.upper()}" for c, k in (x.split() for x in schema.split(", "))]
        spark.range(6).selectExpr(*columns, "1 as OTHER").write.jdbc(url, name.upper(), properties=driver)
    tables = dataset.read_tables(spark, url, "jdbc", {"happenings": ("id", 0, 6, 3)})
    for name, schema in dataset.TABLES.items():
        assert tables[name].schema.simpleString().lower() == spark.createDataFrame([], schema).schema.simpleString().lower()
        assert tables[name].count() == 6
    assert tables["happenings"].rdd.getNumPartitions() == 3 and sorted(r.id for r in tables["happenings"].collect()) == list(range(6))
    r = next(r for r in tables["accounts"].collect() if r.id == "a2")
    assert (r.providers, r.auth_metadata, r.is_active) == (["x", "y"], {"k": "v"}, True)


PEOPLE = "id long, meetup_id long, account_id long, name string, travel_mode string, latitude double, longitude double, created_at long"


LOG = "change_id long, seq long, ts string, meetup_id long, participant_id long, name string, travel_mode string, latitude double, longitude double, account_id long"


def change_log(spark, rows):
    return spark.createDataFrame(rows, LOG).withColumn("ts", F.to_timestamp("ts"))


def change(k, meetup=None, person=None, at=None):
    person = (k * 5) % 12 if person is None else person
    at = k if at is None else at
    return (k, k, f"2026-01-01 {at // 60:02d}:{at % 60:02d}:00", person % 4 if meetup is None else meetup, person, f"N{k}", "car" if k % 2 else None, float(k), 1.0, None)


def people_of(spark):
    return spark.createDataFrame([(i, i % 4, None, f"P{i}", "walk", None, None, 0) for i in range(12)], PEOPLE)


def answer(touched, people):
    return people.groupBy("meetup_id").agg(F.count("latitude").alias("n"), F.sum("latitude").alias("m"))


def events(answers):
    return answers.where("n > 1").select("meetup_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("event_id"), "m")


def rows_of(df, columns=None):
    return sorted(map(str, df.select(columns or df.columns).collect()))


def feed(spark, folder, *rounds):
    """A stream of files; each is a micro-batch."""
    for rows in rounds:
        change_log(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(change_log(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def mixed(rng, n=30, rounds=4):
    """Rounds of changes in random order, some delivered twice and some to a wrong meetup or an unknown person."""
    log = [change(k) for k in range(n)] + [change(n + k, meetup=(k + 1) % 4, person=k % 4) for k in range(6)] + [change(n + 9, 2, 99)]
    rng.shuffle(log)
    parts = [log[k::rounds] for k in range(rounds)]
    return log, [part + parts[k - 1][:3] for k, part in enumerate(parts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_in_any_order_equal_the_batch(spark, tmp_path, seed):
    log, rounds = mixed(np.random.default_rng(seed))
    folk = people_of(spark)
    kept = KeptTables(spark, f"{tmp_path}/kept", live.MEETUP_TABLES, 3)
    kept.start(people=folk)
    live.stream_rendezvous(feed(spark, f"{tmp_path}/in", *rounds), kept, answer, f"{tmp_path}/check", "1 day", events).awaitTermination()
    assert kept.commits() == [2, 3]  # of four micro-batches
    after, answers = live.apply_batch(change_log(spark, log), folk, answer)
    assert rows_of(after) == rows_of(kept.table("people"))
    assert rows_of(answers) == rows_of(kept.table("answers"))
    assert rows_of(events(answers)) == rows_of(kept.table("events"))


def test_a_batch_lost_at_any_step_runs_again(spark, tmp_path, monkeypatch):
    _, rounds = mixed(np.random.default_rng(3), rounds=2)
    source = feed(spark, f"{tmp_path}/in", *rounds)

    def run(name):
        kept = KeptTables(spark, f"{tmp_path}/{name}", live.MEETUP_TABLES, 3)
        kept.start(people=people_of(spark))
        live.stream_rendezvous(source, kept, answer, f"{tmp_path}/check-{name}", "1 day", events).awaitTermination()
        return {t: rows_of(kept.table(t)) for t in live.MEETUP_TABLES}

    want = run("whole")
    seen = set()

    def dying(f, what):
        def call(self, *args):
            step = (self.batch_id, what, args[0] if what == "write" else "")
            for when in ("before", "after"):
                if when == "after":
                    f(self, *args)
                if self.batch_id >= 0 and (step, when) not in seen:
                    seen.add((step, when))
                    raise RuntimeError(f"lost {when} {step}")
        return call

    for what in ("write", "commit"):
        monkeypatch.setattr(Batch, what, dying(getattr(Batch, what), what))
    lost, got = 0, None
    while got is None:
        try:
            got = run("torn")
        except Exception as error:
            assert "lost" in str(error)
            lost += 1
    assert lost == len(seen) == 2 * 2 * 5
    assert got == want


def test_a_batch_writes_no_bucket_that_it_does_not_touch(spark, tmp_path):
    kept = KeptTables(spark, f"{tmp_path}/kept", live.MEETUP_TABLES, 8)
    kept.start(people=people_of(spark))
    mine = [change(1, person=1), change(2, person=5)]  # both of meetup 1
    live.stream_rendezvous(feed(spark, f"{tmp_path}/in", mine), kept, answer, f"{tmp_path}/check", "1 day", events).awaitTermination()
    touched = kept.touched(spark.sql("select 1L as meetup_id"), "meetup_id")
    assert len(touched) == 1
    for name in live.MEETUP_TABLES:
        written = [n for n in dataset.list_names(spark, kept.path(name, 0)) if n.startswith("__bucket")]
        assert written == [f"__bucket={touched[0]}"]
    assert kept.table("people").count() == 12


def test_old_versions_go_and_the_tables_stay(spark, tmp_path):
    kept = KeptTables(spark, f"{tmp_path}/kept", {"t": "k"}, 2)
    kept.start(t=spark.range(20).withColumnRenamed("id", "k"))
    both = list(range(2))
    for n in range(4):
        batch = kept.open(n)
        batch.write("t", batch.read("t").where(F.col("k") != n), both)
        batch.commit(None)
        kept.forget()
    assert kept.open(3) is None
    assert kept.commits() == [2, 3]
    assert rows_of(kept.table("t")) == rows_of(spark.range(4, 20).withColumnRenamed("id", "k"))
    left = [n for v in range(-1, 4) for n in dataset.list_names(spark, kept.path("t", v)) if n.startswith("__bucket")]
    assert len(left) == 4
    batch = kept.open(4)
    with pytest.raises(ValueError, match="other buckets"):
        batch.write("t", batch.read("t"), [0])
    batch.write("t", batch.read("t", [0]).limit(0), [0])
    batch.commit(None)
    assert {r.b for r in kept.table("t").select(kept.bucket("k").alias("b")).distinct().collect()} == {1}


def test_only_applied_changes_are_remembered_while_they_matter(spark, tmp_path):
    kept = KeptTables(spark, f"{tmp_path}/kept", live.MEETUP_TABLES, 1)
    kept.start(people=people_of(spark))
    rounds = [
        [change(50, meetup=2, person=1, at=9), change(9, person=1)],  # the first goes to a meetup that person 1 is not in
        [change(8, person=1), change(10, person=5)],  # older than what was applied; new
        [change(300, person=2, at=300)],
        [change(301, person=3, at=301), change(7, person=7)],  # the second is a day's work too late
    ]
    live.stream_rendezvous(feed(spark, f"{tmp_path}/in", *rounds), kept, answer, f"{tmp_path}/check", "30 minutes").awaitTermination()
    names = {r.id: r.name for r in kept.table("people").collect()}
    assert (names[1], names[5], names[2], names[3], names[7]) == ("N9", "N10", "N300", "N301", "P7")
    assert sorted((r.meetup_id, r.participant_id, r.seq) for r in kept.table("applied").collect()) == [(2, 2, 300), (3, 3, 301)]


def test_newer_changes_by_meetup_and_participant(spark):
    applied = spark.createDataFrame([(1, 1, 5, 50)], "meetup_id long, participant_id long, seq long, change_id long")
    new = spark.createDataFrame([(1, 1, 4, 99), (1, 1, 5, 50), (1, 1, 5, 51), (1, 1, 6, 1), (2, 1, 1, 1)], "meetup_id long, participant_id long, seq long, change_id long")
    assert sorted((r.meetup_id, r.seq, r.change_id) for r in live.newer_than_applied(new, applied).collect()) == [(1, 5, 51), (1, 6, 1), (2, 1, 1)]


def test_events_are_cleared(spark):
    events = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "meetup_id long, event_id long")
    answers = spark.createDataFrame([(1, "ok"), (2, "off")], "meetup_id long, status string")
    got = live.events_after(events, answers, spark.createDataFrame([(1, 11)], "meetup_id long, event_id long"))
    assert sorted((r.meetup_id, r.event_id) for r in got.collect()) == [(1, 11), (3, 30)]


ACCOUNT_COLUMNS = "id string, supabase_user_id string, email string, display_name string, avatar_url string, profile_customized boolean, providers array<string>, auth_metadata map<string,string>, is_active boolean, last_seen_at timestamp, created_at timestamp, updated_at timestamp"


def test_logins_in_any_order_equal_the_batch(spark, tmp_path):
    profiles = spark.sql("select 'u' || (id % 5) as supabase_user_id, timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id div 2 as int),0) as ts, id as seq, 'e' || id as email, 'd' || id as display_name, 'a' || id as avatar_url, array('g') as providers, map('name', 'x' || id) as auth_metadata from range(25)")
    old = spark.sql("select 'i' as id, 'u1' as supabase_user_id, 'old' as email, 'mine' as display_name, cast(null as string) as avatar_url, true as profile_customized, array('m') as providers, map('name', 'o') as auth_metadata, true as is_active, timestamp'2025-01-01' as last_seen_at, timestamp'2024-01-01' as created_at, timestamp'2025-01-01' as updated_at")
    accounts = spark.createDataFrame(old.collect(), ACCOUNT_COLUMNS)
    profiles.withColumn("r", F.xxhash64("seq") % 4).repartitionByRange(4, "r").drop("r").write.parquet(f"{tmp_path}/in")
    kept = KeptTables(spark, f"{tmp_path}/kept", live.ACCOUNT_TABLES, 4)
    kept.start(accounts=changes.with_login_keys(accounts, profiles))
    stream = spark.readStream.schema(profiles.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.stream_accounts(stream, kept, f"{tmp_path}/check").awaitTermination()
    assert kept.commits()[-1] >= 2
    got, want = kept.table("accounts"), changes.upsert_accounts(accounts, profiles)
    assert rows_of(got, want.columns) == rows_of(want)
    assert sorted((r.supabase_user_id, r.display_name, r.email) for r in got.collect()) == [("u0", "d0", "e20"), ("u1", "mine", "e21"), ("u2", "d2", "e22"), ("u3", "d3", "e23"), ("u4", "d4", "e24")]


def test_amended_buckets(spark, tmp_path, monkeypatch):
    """A batch writes only the rows of its keys, and a bucket of many versions is written anew."""
    monkeypatch.setattr("meetpoint.streaming.state.VERSIONS", 3)
    kept = KeptTables(spark, f"{tmp_path}/kept", {"t": "k"}, 2)
    kept.start(t=spark.sql("select id % 6 as k, id as v from range(18)"))
    want, sizes = {(k % 6, k) for k in range(18)}, []
    for n in range(5):
        only = spark.sql(f"select {n % 3}L as k")
        batch = kept.open(n)
        assert {tuple(r) for r in batch.read("t", kept.touched(only, "k"), only).collect()} == {r for r in want if r[0] == n % 3}
        batch.write("t", only.selectExpr("k", f"{100 + n}L as v"), kept.touched(only, "k"), True)
        want = {r for r in want if r[0] != n % 3} | {(n % 3, 100 + n)}
        batch.commit(None)
        kept.forget()
        sizes.append(spark.read.parquet(kept.path("t", n)).count())
        assert {tuple(r) for r in kept.table("t").collect()} == want
    assert sizes[0] == 1 and max(max(map(len, kept.manifest(n)["tables"]["t"]["buckets"].values())) for n in kept.commits()) <= 3

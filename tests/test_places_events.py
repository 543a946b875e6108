import datetime as dt
import random

from pyspark.sql import functions as F

from meetpoint.functions.geo import distance_meters
from meetpoint.operators import happenings, places


def test_radius_join_equals_all_pairs(spark):
    rng = random.Random(3)
    for centre_lat, centre_lon in ((48.2, 16.37), (0.0, 179.995), (-60.0, -0.01), (89.2, 10.0)):
        a = [(i, centre_lat + rng.uniform(-0.06, 0.06), centre_lon + rng.uniform(-0.06, 0.06)) for i in range(120)] + [(900, None, 1.0), (901, float("nan"), 1.0)]
        b = [(i, centre_lat + rng.uniform(-0.06, 0.06), centre_lon + rng.uniform(-0.06, 0.06)) for i in range(60)] + [(902, 1.0, None)]
        wrap = lambda x: x if x is None else (x + 180) % 360 - 180
        left = spark.createDataFrame([(i, la, wrap(lo)) for i, la, lo in a], "a long, lat double, lon double")
        right = spark.createDataFrame([(i, la, wrap(lo)) for i, la, lo in b], "b long, r_lat double, r_lon double")
        got = sorted((r.a, r.b) for r in places.within_radius(left, right, 1500, r=("r_lat", "r_lon")).collect())
        every = left.where("a < 900").join(right.where("b < 900"), how="cross").where(distance_meters(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= 1500)
        assert got == sorted((r.a, r.b) for r in every.collect()) and got


def test_nearest_place(spark):
    points = spark.createDataFrame([(1, 48.2, 16.37), (2, 0.0, 0.0), (3, None, 1.0)], "id long, lat double, lon double")
    p = spark.createDataFrame([(7, 48.2001, 16.37), (5, 48.1999, 16.37), (9, 48.21, 16.37)], "place_id long, place_lat double, place_lon double")
    got = {r.id: r.place_id for r in places.nearest_place(points, p, "id").collect()}
    assert got[2] is None and got[3] is None and got[1] in (5, 7)


def test_events_of_a_meetup(spark):
    answers = spark.sql("select 1L as meetup_id, 'ok' as status, named_struct('latitude', 48.2D, 'longitude', 16.37D) as position union all select 2L, 'no_positioned_participants', null")
    meetups = spark.sql("select id, timestamp_ntz'2026-08-05 18:00:00' as starts_at from range(1, 3)")  # 20:00 in Vienna
    base = dict(lang_primary="de", title_de="", title_en="T", description_de="", description_en="", url="u", origin_url=None, image_url=" ", venue_name_raw="v", street=None, postcode="1010", city="Wien", lat=48.2, lon=16.37, disappeared_at=None)
    rows = [base | {"id": i} for i in range(1, 7)]
    rows[1] |= {"lat": 48.3}
    rows[2] |= {"disappeared_at": dt.datetime(2026, 8, 1)}
    rows[3] |= {"lat": None}
    rows[4] |= {"lat": 48.201, "street": "Graben 1"}
    schema = "id long, lang_primary string, title_de string, title_en string, description_de string, description_en string, url string, origin_url string, image_url string, venue_name_raw string, street string, postcode string, city string, lat double, lon double, disappeared_at timestamp_ntz"
    names = [c.split()[0] for c in schema.split(", ")]
    events = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    at = lambda h, d=5: dt.datetime(2026, 8, d, h)
    occ = [
        (10, 1, at(16), at(18), dt.date(2026, 8, 5), False),  # began before the meetup
        (11, 1, at(19), at(21), dt.date(2026, 8, 5), False), (12, 1, at(20), at(22), dt.date(2026, 8, 5), False),
        (13, 5, at(22, 4), at(0), dt.date(2026, 8, 5), True),
        (14, 6, at(19, 6), at(21, 6), dt.date(2026, 8, 6), False), (15, 2, at(19), at(21), dt.date(2026, 8, 5), False), (16, 3, at(19), at(21), dt.date(2026, 8, 5), False),
    ]
    occurrences = spark.createDataFrame(occ, "id long, event_id long, start_utc timestamp_ntz, start_local timestamp_ntz, date_local date, all_day boolean")
    got = happenings.rendezvous_events(answers, meetups, events, occurrences).orderBy("rank").collect()
    assert [(r.meetup_id, r.event_id, r.rank, r.all_day) for r in got] == [(1, 1, 1, False), (1, 5, 2, True)]
    assert got[0].start_local == at(21) and got[0].link == "u" and got[0].address is None and got[0].image_url is None and got[0].title == "T"
    assert got[1].address == "Graben 1, 1010 Wien" and got[1].distance_meters == 111
    p = spark.createDataFrame([(1, 48.2002, 16.37, "Here 1")], "place_id long, lat double, lon double, label string")
    filled = happenings.fill_missing_address(happenings.rendezvous_events(answers, meetups, events, occurrences), p)
    assert {r.event_id: r.address for r in filled.collect()} == {1: "Here 1", 5: "Graben 1, 1010 Wien"}


def test_bounds():
    import pytest

    for radius, limit in ((99, 20), (10_001, 20), (1000, 0), (1000, 101)):
        with pytest.raises(ValueError):
            happenings.check_bounds(radius, limit)
    happenings.check_bounds(100, 100)


def test_snapping(spark):
    from meetpoint.plans.model import RES, centres

    cells = spark.createDataFrame(centres(), "cell_id int, lat double, lon double")
    back = places.snap(cells.select(F.col("cell_id").alias("c"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude")), cells, RES)
    assert back.where("c <> cell_id").count() == 0
    named = places.snap_by_id(spark.createDataFrame([("x",), ("y",)], "h3 string"), spark.createDataFrame([("x", 4)], "h3 string, cell_id int"))
    assert sorted(r.cell_id for r in named.collect()) == [-1, 4]
    assert places.cell_position(named, spark.createDataFrame([(4, 1.0, 2.0)], "cell_id int, lat double, lon double")).where("position is null").count() == 1


def test_ever_nearest_keeps_what_any_start_can_show(spark):
    import random

    rng = random.Random(3)
    rows = [(g, k, rng.randrange(40) * (1.0 if g else 0.0), rng.randrange(60)) for g in range(3) for k in range(400 if g < 2 else 3)]
    shown = spark.createDataFrame(rows, "spot long, event_id long, distance_meters double, at long").selectExpr("*", "timestamp_ntz'2026-08-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(at as int), 0) as latest")
    for limit in (1, 5):
        kept = happenings.ever_nearest(shown.repartition(3), ["spot"], limit).collect()
        out = {(r.spot, r.event_id) for r in kept}
        assert len(out) == len(kept)
        for g in range(3):
            mine = [r for r in rows if r[0] == g]
            want = set()
            for t in range(61):
                still = sorted(r[2] for r in mine if r[3] >= t)
                if still:
                    last = still[min(limit, len(still)) - 1]
                    want |= {r[1] for r in mine if r[3] >= t and r[2] <= last}
            assert {k for s, k in out if s == g} == want


def test_few_of_many_events_stay(spark, monkeypatch):
    n = 100_000
    shown = spark.range(n).selectExpr("0 as spot", "id as event_id", "rand(1) * 1000 as distance_meters", "timestamp_ntz'2026-08-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, rand(2) * 86400) as latest")
    kept = happenings.ever_nearest(shown, ["spot"], 20)
    assert 150 < kept.count() < 400  # 20 * (1 + log(n / 20)) = 190
    monkeypatch.setattr(happenings, "ARRAY_EVENTS", 50)
    sizes = {r.chunk: r["count"] for r in happenings.ever_nearest(shown, ["spot"], 20).groupBy("chunk").count().collect()}
    assert len(sizes) > 2 and max(sizes.values()) == 50


def test_events_of_naive_local_starts(spark):
    meetups = spark.sql("select 1L as id, timestamp_ntz'2026-08-05 21:30:00' as starts_at")
    occ = [(1, 1, dt.datetime(2026, 8, 5, 19, 0), dt.datetime(2026, 8, 5, 21, 0), dt.date(2026, 8, 5), False), (2, 1, dt.datetime(2026, 8, 5, 20, 0), dt.datetime(2026, 8, 5, 22, 0), dt.date(2026, 8, 5), False)]
    occurrences = spark.createDataFrame(occ, "id long, event_id long, start_utc timestamp_ntz, start_local timestamp_ntz, date_local date, all_day boolean")
    near = spark.sql("select 1L as meetup_id, 1L as event_id")
    assert [r.occurrence_id for r in happenings.next_occurrence(meetups, occurrences, near, naive="local").collect()] == [2]
    assert happenings.next_occurrence(meetups, occurrences, near).count() == 0
    zoned = occurrences.withColumn("start_utc", F.col("start_utc").cast("timestamp"))
    assert [r.occurrence_id for r in happenings.next_occurrence(meetups, zoned, near, naive="local").collect()] == [2]


def test_crowded_spots_are_dealt_out(spark, monkeypatch):
    import random

    rng = random.Random(7)
    day = dt.date(2026, 8, 5)
    rows = [(k, 48.2 + rng.randrange(90) * 1e-4, 16.37 + rng.randrange(90) * 1e-4, rng.randrange(24)) for k in range(300)]
    events = spark.createDataFrame([r[:3] for r in rows], "id long, lat double, lon double").withColumn("disappeared_at", F.lit(None).cast("timestamp"))
    occ = spark.createDataFrame([(k, k, dt.datetime(2026, 8, 5, h), day, k % 11 == 0) for k, _, _, h in rows], "id long, event_id long, start_utc timestamp_ntz, date_local date, all_day boolean")
    centres = spark.createDataFrame([(g, dt.datetime(2026, 8, 5, g), day, 48.204, 16.374) for g in range(24)], "meetup_id long, starts_at timestamp_ntz, date_local date, centre_lat double, centre_lon double")
    at = {r.id: r.d for r in events.select("id", distance_meters(F.col("lat"), F.col("lon"), F.lit(48.204), F.lit(16.374)).alias("d")).collect()}
    for size in (4000, 37):
        monkeypatch.setattr(happenings, "ARRAY_EVENTS", size)
        got = {}
        for r in happenings.nearest_showing(centres, events, occ, 600, 5).collect():
            got.setdefault(r.meetup_id, set()).add(r.event_id)
        for g in range(24):
            still = sorted(at[k] for k, _, _, h in rows if (h >= g or k % 11 == 0) and at[k] <= 600)
            last = still[min(5, len(still)) - 1]
            least = {k for k, _, _, h in rows if (h >= g or k % 11 == 0) and at[k] <= last}
            assert least <= got[g] and (size == 37 or got[g] == least)


def metres(spark, pairs):
    """Distances of (lat, lon, lat, lon) by the library's own formula."""
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, a double, b double, c double, d double")
    return {r.i: r.m for r in df.select("i", distance_meters(*map(F.col, "abcd")).alias("m")).collect()}


def test_dense_buckets_are_dealt_out(spark, monkeypatch):
    rng = random.Random(4)
    crowd = [(k, 48.2 + rng.random() * 1e-3, 16.37 + rng.random() * 1e-3) for k in range(300)] + [(k, 48 + rng.random(), 16 + rng.random()) for k in range(300, 400)]
    spots = [(k, 48.2 + rng.random() * 2e-3, 16.37 + rng.random() * 2e-3) for k in range(30)]
    far = metres(spark, [(a, b, c, d) for _, a, b in crowd for _, c, d in spots])
    want = sorted((i, j) for n, (i, j) in enumerate((i, j) for i, _, _ in crowd for j, _, _ in spots) if far[n] <= 60)
    left, right = spark.createDataFrame(crowd, "i long, lat double, lon double"), spark.createDataFrame(spots, "j long, x double, y double")
    for rows in (20_000, 10):
        monkeypatch.setattr(places, "BUCKET_ROWS", rows)
        found = places.within_radius(left, right, 60, r=("x", "y"))
        assert sorted((r.i, r.j) for r in found.collect()) == want and len(want) > 100
        assert found.columns == ["i", "lat", "lon", "j", "x", "y", "distance_meters"]


def test_nearest_places_ring_by_ring(spark):
    rng = random.Random(5)
    dense = [(48.2 + rng.random() * 1e-4, 16.37 + rng.random() * 1e-4) for _ in range(400)]
    loose = [(48.1 + rng.random() * 0.05, 16.3 + rng.random() * 0.05) for _ in range(60)]
    spots = [(k, *p) for k, p in enumerate([*dense, *loose, *[(48.2005, 16.3705)] * 50])]
    asked = [(k, *p) for k, p in enumerate([*[dense[0]] * 3, *[(48.2005, 16.3705)] * 2, *((48.1 + rng.random() * 0.06, 16.3 + rng.random() * 0.06) for _ in range(40)), (10.0, 10.0)])]
    asked.append((99, None, None))
    solid = [p for p in asked if p[1] is not None]
    far = metres(spark, [(a, b, c, d) for _, a, b in solid for _, c, d in spots])
    for k in (1, 3):
        found = places.nearest_place(spark.createDataFrame(asked, "id long, lat double, lon double"), spark.createDataFrame(spots, "place_id long, place_lat double, place_lon double"), "id", 2000, k)
        got = {}
        for r in found.collect():
            got.setdefault(r.id, []).append((r.rank, r.place_id))
        for n, (i, _, _) in enumerate(solid):
            near = sorted((far[n * len(spots) + j], spots[j][0]) for j in range(len(spots)) if far[n * len(spots) + j] <= 2000)[:k]
            assert sorted(got[i]) == ([(r, p) for r, (_, p) in enumerate(near, 1)] or [(None, None)])
        assert got[99] == [(None, None)]


def test_few_places_of_one_spot_are_searched(spark):
    spots = spark.range(200_000).selectExpr("id as place_id", "48.2D as place_lat", "16.37D as place_lon")
    asked = spark.range(2000).selectExpr("id", "48.2D + id * 1e-8 as lat", "16.37D as lon")
    assert places.nearest_place(asked, spots, "id", k=2).groupBy("place_id", "rank").count().orderBy("rank").collect() == [(0, 1, 2000), (1, 2, 2000)]


def test_showings_near_are_those_of_each_pair_counted(spark):
    import random
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from meetpoint.operators import happenings

    pick = random.Random(5)
    day = datetime(2026, 8, 1)
    at = lambda: day + timedelta(hours=pick.randrange(0, 50))
    spots = [(48.2 + i * 0.004, 16.37) for i in range(3)]
    meetups = spark.createDataFrame([(i, at()) for i in range(60)], "id long, starts_at timestamp_ntz")
    centres = spark.createDataFrame([(i, *spots[i % 3]) for i in range(60)], "meetup_id long, centre_lat double, centre_lon double")
    events = spark.createDataFrame([(e, 48.195 + pick.randrange(8) * 0.003, 16.37, None) for e in range(25)] + [(99, None, 16.37, None)], "id long, lat double, lon double, disappeared_at timestamp_ntz")
    rows = []
    for i in range(400):
        start = at()
        all_day = pick.random() < 0.2
        local = start + timedelta(hours=2)
        rows.append((i, pick.randrange(25), None if pick.random() < 0.05 else start, local if pick.random() < 0.9 else day, local.date(), all_day))
    occurrences = spark.createDataFrame(rows, "id long, event_id long, start_utc timestamp_ntz, start_local timestamp_ntz, date_local date, all_day boolean")
    pairs = happenings.next_occurrence(meetups, occurrences, happenings.events_in_radius(centres, events, 1000))
    want = pairs.groupBy("meetup_id").agg(F.count("*"), F.count_if("all_day"), F.min("start_local"), F.sum("event_id"))
    got = happenings.showings_near(centres, meetups, events, occurrences, 1000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 30


def test_meetups_of_a_spot_are_dealt_out(spark):
    """The join's result is far larger than its input, so its partitions are not put together by the input's size."""
    centres = spark.sql("select id as meetup_id, 48.2 + (id % 2) * 1e-4 as centre_lat, 16.37D as centre_lon from range(40)")
    events = spark.sql("select id, 48.2 + id * 1e-4 as lat, 16.37D as lon, cast(null as timestamp_ntz) as disappeared_at from range(30)")
    found = happenings.events_in_radius(centres, events, 200)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = {(r.meetup_id, r.event_id): r.distance_meters for r in found.collect()}
    assert len(want) == found.count() == 20 * 18 + 20 * 19 and want[0, 0] == 0
    whole = happenings.events_in_radius(centres, events, 200, whole=True)
    assert {(r.meetup_id, r.event_id): r.distance_meters for r in whole.collect()} == {k: round(d) for k, d in want.items()}


def test_listings_serve_several_batches(spark):
    day = "timestamp_ntz'2026-08-01 00:00:00'"
    events = spark.sql("select id, 48.2 + id * 1e-4 as lat, 16.37D as lon, cast(null as timestamp_ntz) as disappeared_at from range(30)")
    shown = spark.sql(f"select id, id as event_id, {day} + make_interval(0,0,0,0,cast(id % 20 as int),0,0) as start_utc, {day} as start_local, date'2026-08-01' as date_local, false as all_day from range(30)")
    spots = spark.sql("select 48.2D as centre_lat, 16.37D as centre_lon")
    listed, some, showings = happenings.listed_around(spots, events, shown, 200, 2)
    assert 0 < some.count() == showings.count() < 18
    for hour in (0, 7, 15, 19):
        centres = spots.selectExpr("1L as meetup_id", "*", f"{day} + make_interval(0,0,0,0,{hour},0,0) as starts_at", "date'2026-08-01' as date_local")
        direct, served = happenings.nearest_showing(centres, events, shown, 200, 2), happenings.nearest_showing(centres, some, showings, 200, 2, listed)
        assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, served.collect()))


def test_first_showings_of_crowded_places_by_brute_force(spark):
    """Events at a few places, with several showings a day, equal times, whole days and missing times; few spans stay."""
    rng = random.Random(11)
    day = dt.datetime(2026, 8, 5)
    spots = [(48.2, 16.37), (48.203, 16.37)]
    where = [(48.2 + i * 0.001, 16.37) for i in range(8)]
    rows = [(e, *where[rng.randrange(8)]) for e in range(400)]
    occ = []
    for e, *_ in rows:
        for _ in range(rng.randrange(1, 4)):
            start = day + dt.timedelta(hours=rng.randrange(24))
            occ.append((len(occ), e, None if rng.random() < 0.05 else start, None if rng.random() < 0.1 else start + dt.timedelta(hours=2 * (rng.random() < 0.9)), day.date(), rng.random() < 0.02))
    asked = [(g, spots[g % 2], day + dt.timedelta(minutes=rng.randrange(1440))) for g in range(60)]
    events = spark.createDataFrame(rows, "id long, lat double, lon double").withColumn("disappeared_at", F.lit(None).cast("timestamp"))
    occurrences = spark.createDataFrame(occ, "id long, event_id long, start_utc timestamp_ntz, start_local timestamp_ntz, date_local date, all_day boolean")
    centres = spark.createDataFrame([(g, at, day.date(), *spot) for g, spot, at in asked], "meetup_id long, starts_at timestamp_ntz, date_local date, centre_lat double, centre_lon double")
    far = metres(spark, [(*a, *b) for a in where for b in spots])
    far = {(a, b): far[i * 2 + j] for i, a in enumerate(where) for j, b in enumerate(spots)}
    want = []
    for g, spot, at in asked:
        found = []
        for e, *place in rows:
            still = [(s is not None, s or day, o, local, whole) for o, ev, s, local, _, whole in occ if ev == e and (whole or (s is not None and s >= at))]
            if far[tuple(place), spot] <= 500 and still:
                _, _, o, local, whole = min(still, key=lambda x: x[:3])
                found.append((far[tuple(place), spot], local is not None, local or day, e, o))
        want += [(g, n, e, o) for n, (*_, e, o) in enumerate(sorted(found)[:5], 1)]
    listed = happenings.spans_around(centres, events, occurrences, 500, 5)
    got = happenings.first_showings(centres, listed, 5)
    assert sorted((r.meetup_id, r["rank"], r.event_id, r.occurrence_id) for r in got.collect()) == sorted(want) and len(want) > 250
    around = happenings.spans_of(occurrences).join(happenings.near_spots(centres, events, 500), "event_id").count()
    assert listed.count() < around / 3  # by place: with ties of distance, whole places would stay


def test_meetups_of_an_event_come_one_after_another(spark):
    """So that files of a row per meetup and event are small."""
    centres = spark.sql("select id as meetup_id, 48.2D as centre_lat, 16.37D as centre_lon from range(400)")
    events = spark.sql("select id, 48.2 + (id % 10) * 1e-4 as lat, 16.37D as lon, cast(null as timestamp_ntz) as disappeared_at from range(50)")
    found = happenings.events_in_radius(centres, events, 200)
    parts = found.rdd.mapPartitions(lambda rows: [[r.event_id for r in rows]]).collect()
    assert sum(map(len, parts)) == 400 * 50
    assert sum(x != y for p in parts for x, y in zip(p, p[1:])) < 4 * 50

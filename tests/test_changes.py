import datetime as dt
import json


from meetpoint.operators import changes
from meetpoint.schemas import OUTCOMES

PEOPLE = "id long, meetup_id long, account_id long, created_by_account_id long, name string, travel_mode string, latitude double, longitude double, created_at long"
CHANGES = "change_id long, seq long, meetup_id long, participant_id long, name string, travel_mode string, latitude double, longitude double, account_id long"


def test_replace_and_patch(spark):
    folk = spark.createDataFrame([(1, 1, 5, 0, "Ada", "walk", 48.2, 16.4, 0), (2, 1, None, 0, "Bo", "car", None, None, 0), (3, 2, 6, 0, "Cy", "walk", 1.0, 2.0, 0)], PEOPLE)
    done = spark.createDataFrame([(1, 1, 1, 1, "old", "car", 1.0, 1.0, 9), (2, 2, 1, 1, "New", None, None, None, None), (3, 3, 2, 1, "wrong meetup", "car", None, None, None)], CHANGES)
    got = {r.id: r for r in changes.replace_participants(folk, done).collect()}
    assert tuple(got[1])[2:8] == (None, 0, "New", "transit", None, None)
    assert got[2].name == "Bo" and got[3].account_id == 6
    patched = {r.id: r for r in changes.patch_participants(folk, done).collect()}
    assert (patched[1].name, patched[1].travel_mode, patched[1].latitude, patched[1].account_id) == ("New", "car", 1.0, 9)
    twice = changes.replace_participants(folk, done.union(done))
    assert sorted(map(str, twice.collect())) == sorted(map(str, got.values()))


def test_links_validation_and_deletes(spark):
    done = spark.createDataFrame([(1, 1, 1, 1, "a", "car", None, None, 77), (2, 2, 1, 1, "a", "car", None, None, None), (3, 3, 1, 1, "a", "car", None, None, 5)], CHANGES)
    accounts = spark.createDataFrame([(5,)], "id long")
    bad = changes.linked_account_rejects(done, accounts).collect()
    assert [(r.change_id, r.status, r.message) for r in bad] == [(1, "account_not_found", "Account 77 not found")]
    asked = spark.createDataFrame([("n", "teleport", None, None), (None, None, "x", None), ("ok", None, None, None), ("ok", "walk", "1", "2")], "name string, travel_mode string, latitude string, longitude string")
    got = changes.validate_requests(asked).collect()
    assert [[e.location + ":" + e.type for e in r.errors] for r in got] == [["body.travel_mode:enum"], ["body.name:missing", "body.position.latitude:float_parsing", "body.position.longitude:missing"], [], []]
    folk = spark.createDataFrame([(1, 1, 5, 0, "Ada", "walk", 48.2, 16.4, 0), (2, 2, 6, 0, "Bo", "car", None, None, 0)], PEOPLE)
    assert [r.id for r in changes.delete_meetups(folk, spark.createDataFrame([(1,)], "meetup_id long")).collect()] == [2]
    left = changes.delete_accounts(folk, spark.createDataFrame([(5,), (5,)], "account_id long"))
    assert left.columns == folk.columns and {r.id: r.account_id for r in left.collect()} == {1: None, 2: 6}


def login(ts, seq, sub, **user):
    claims = {"sub": sub, "iss": "i", "aud": "a", "iat": 1, "exp": 4e9, "role": "authenticated", "email": f"{seq}@x", "user_metadata": user, "app_metadata": {"providers": ["g"]}}
    return (dt.datetime(2026, 1, 1 + ts), seq, claims)


def test_logins_and_upserts(spark):
    a, b = "00000000-0000-0000-0000-00000000000a", "00000000-0000-0000-0000-00000000000b"
    rows = [login(1, 1, a, full_name="First"), login(2, 2, a, full_name="Second"), login(1, 3, b.upper(), full_name="B", picture="p")]
    bad = [("invalid_bearer_token", {"sub": "x"}), ("invalid_bearer_token", {"exp": 5}), ("invalid_bearer_token", {"iss": "z"}), ("invalid_bearer_token", {"iat": None}), ("unauthenticated_role", {"role": "anon"})]
    for k, (_, change) in enumerate(bad):
        t, seq, claims = login(1, 10 + k, a)
        rows.append((t, seq, {x: y for x, y in (claims | change).items() if y is not None}))
    logins = spark.createDataFrame([(t, s, json.dumps(c)) for t, s, c in rows] + [(dt.datetime(2026, 1, 1), 99, None), (dt.datetime(2026, 1, 1), 98, "not json")], "ts timestamp_ntz, seq long, claims string")
    checked = changes.valid_logins(logins, "i", "a")
    status = {r.seq: r.status for r in checked.collect()}
    assert [status[10 + k] for k in range(len(bad))] == [s for s, _ in bad]
    assert status[99] == "missing_bearer_token" and status[98] == "invalid_bearer_token" and status[1] == status[3] == "ok"
    schema = "id string, supabase_user_id string, email string, display_name string, avatar_url string, profile_customized boolean, providers array<string>, auth_metadata map<string,string>, is_active boolean, last_seen_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
    stored = spark.createDataFrame([("id-b", b, "old@x", "Mine", None, True, [], {}, True, None, None, None), ("id-c", "c", "c@x", "C", None, False, [], {}, True, None, None, None)], schema)
    profiles = changes.login_profiles(checked.where("status = 'ok'"))
    after = {r.supabase_user_id: r for r in changes.upsert_accounts(stored, profiles).collect()}
    assert (after[a].display_name, after[a].email, after[a].last_seen_at, after[a].created_at) == ("First", "2@x", dt.datetime(2026, 1, 3), dt.datetime(2026, 1, 2))
    assert (after[b].id, after[b].display_name, after[b].email, after[b].profile_customized, after[b].providers) == ("id-b", "Mine", "3@x", True, ["g"])
    assert after["c"].email == "c@x" and len(after) == 3
    # the same logins in two steps give the same accounts
    half = changes.upsert_accounts(stored, profiles.where("seq <> 2"))
    again = {r.supabase_user_id: r for r in changes.upsert_accounts(half, profiles.where("seq = 2")).collect()}
    assert again == after
    assert changes.duplicate_accounts(stored.union(stored)).count() == 2


def test_creation_and_catalogue(spark):
    meetups = spark.createDataFrame([("m0", "a", "n", "l", None)], "id string, created_by_account_id string, name string, location string, starts_at timestamp_ntz")
    asked = spark.sql("select 5L as request_id, 'a' as account_id, 'N' as name, 'L' as location, timestamp_ntz'2026-01-01 00:00:00' as starts_at union all select 6L, 'a', null, 'L', timestamp_ntz'2026-01-01 00:00:00'")
    assert sorted(r.id for r in changes.create_meetups(meetups, asked).collect()) == ["m0", "m5"]
    folk = spark.createDataFrame([], "id string, meetup_id string, account_id string, created_by_account_id string, name string, travel_mode string, latitude double, longitude double, created_at timestamp_ntz")
    joined = spark.sql("select 1L as request_id, 'm0' as meetup_id, null as account_id, 'a' as owner_id, 'P' as name, null as travel_mode, timestamp_ntz'2026-01-01 00:00:00' as ts union all select 2L, 'm0', null, 'b', 'Q', 'car', null")
    got = changes.add_participants(folk, joined, meetups).collect()
    assert [(r.id, r.travel_mode, r.latitude) for r in got] == [("p1", "transit", None)]
    assert changes.outcome_catalogue(spark).count() == len(OUTCOMES) == 10

"""Accounts and changes: logins, upserts, full replaces, patches, checks and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import MODES, OK, OUTCOMES


def valid_logins(logins: DataFrame, issuer: str, audience: str, now=None) -> DataFrame:
    """logins(ts, claims) with ``status``; claims is the decoded token as JSON, null if there was none.

    A token must have sub (a UUID), iss, aud, iat and exp, name the issuer and
    audience, and not have expired at ``now`` (by default its own ts).
    """
    at = F.lit(now).cast("timestamp") if now is not None else F.col("ts").cast("timestamp")
    parsed = logins.withColumn("__claims", F.try_parse_json("claims"))
    get = lambda k, kind="string": F.try_variant_get(F.col("__claims"), f"$.{k}", kind)
    audiences = F.coalesce(get("aud", "array<string>"), F.array(get("aud")))
    ok = (
        (get("iss") == issuer) & F.array_contains(audiences, audience) & get("iat", "double").isNotNull()
        & (get("exp", "double") > F.unix_timestamp(at)) & text.normalize_uuid(get("sub")).isNotNull()
    )
    status = F.when(F.col("claims").isNull(), "missing_bearer_token").when(~F.coalesce(ok, F.lit(False)), "invalid_bearer_token").when(~F.coalesce(get("role") == "authenticated", F.lit(False)), "unauthenticated_role").otherwise(OK)
    return parsed.withColumn("status", status).withColumn("supabase_user_id", F.when(F.col("status") == OK, text.normalize_uuid(get("sub")))).drop("__claims")


def login_profiles(logins: DataFrame) -> DataFrame:
    """Accepted logins (ts, supabase_user_id, claims) with email, display_name, avatar_url, providers, auth_metadata."""
    c = F.col("claims")
    return logins.withColumns({
        "email": F.try_variant_get(F.try_parse_json(c), "$.email", "string"), "display_name": text.display_name(c), "avatar_url": text.avatar_url(c),
        "providers": text.providers(c), "auth_metadata": text.auth_metadata(c),
    })


OWNED = ("display_name", "avatar_url")
REFRESHED = ("email", "providers", "auth_metadata")


LOGIN_KEYS = ("first_login", "last_login")


def with_login_keys(accounts: DataFrame, profiles: DataFrame, order: str = "seq") -> DataFrame:
    """Accounts with the keys (ts, seq) of the first and last login merged into them, none yet."""
    key = f"struct<ts: {dict(profiles.dtypes)['ts']}, {order}: {dict(profiles.dtypes)[order]}>"
    return accounts.withColumns({c: F.lit(None).cast(key) for c in LOGIN_KEYS})


def merge_logins(accounts: DataFrame, profiles: DataFrame, order: str = "seq") -> DataFrame:
    """accounts(..., first_login, last_login) after the logins, which may come in any order, batch by batch.

    profiles(supabase_user_id, ts, seq, email, ...).  One row per user comes
    out of a partial aggregate, then one full outer join.  What a login refreshes
    follows the latest one; what it gives a new account follows the earliest one,
    unless the user has customised the profile meanwhile.
    """
    key = "supabase_user_id"
    when = F.struct(F.col("ts"), F.col(order))
    seen = profiles.groupBy(key).agg(
        F.min_by(F.struct(*OWNED), when).alias("first"), F.max_by(F.struct(*REFRESHED), when).alias("last"), F.min(when).alias("first_login"), F.max(when).alias("last_login")
    )
    known = F.col(f"a.{key}").isNotNull()
    customised = F.coalesce("a.profile_customized", F.lit(False))
    joined = accounts.alias("a").join(seen.alias("l"), F.col(f"a.{key}") == F.col(f"l.{key}"), "full")
    user = F.coalesce(f"a.{key}", f"l.{key}")
    later = F.col("l.last_login").isNotNull() & F.coalesce(F.col("l.last_login") > F.col("a.last_login"), F.lit(True))
    made = ~known | F.coalesce(F.col("l.first_login") < F.col("a.first_login"), F.lit(False))  # by a login, and none earlier was seen
    new_id = text.normalize_uuid(F.substring(F.sha2(user, 256), 1, 32))
    out = {
        "id": F.coalesce("a.id", new_id), key: user,
        **{c: F.when(later, F.col(f"l.last.{c}")).otherwise(F.col(f"a.{c}")) for c in REFRESHED},
        **{c: F.when(made & ~customised, F.col(f"l.first.{c}")).otherwise(F.col(f"a.{c}")) for c in OWNED},
        "profile_customized": customised, "is_active": F.coalesce("a.is_active", F.lit(True)),
        "last_seen_at": F.when(later, F.col("l.last_login.ts")).otherwise(F.col("a.last_seen_at")), "updated_at": F.when(later, F.col("l.last_login.ts")).otherwise(F.col("a.updated_at")),
        "created_at": F.when(made, F.col("l.first_login.ts")).otherwise(F.coalesce("a.created_at", "l.first_login.ts")),
        "first_login": F.when(made, F.col("l.first_login")).otherwise(F.col("a.first_login")), "last_login": F.when(later, F.col("l.last_login")).otherwise(F.col("a.last_login")),
    }
    return joined.select(*[out[c].cast(t).alias(c) for c, t in accounts.dtypes])


def upsert_accounts(accounts: DataFrame, profiles: DataFrame, order: str = "seq") -> DataFrame:
    """Accounts after the logins: the first login makes an account, later ones refresh what is not the user's own."""
    return merge_logins(with_login_keys(accounts, profiles, order), profiles, order).drop(*LOGIN_KEYS)


def duplicate_accounts(accounts: DataFrame) -> DataFrame:
    """Users with more than one account: empty if the key is unique."""
    return accounts.groupBy("supabase_user_id").count().where("count > 1")


def create_meetups(meetups: DataFrame, requests: DataFrame) -> DataFrame:
    """Meetups with the valid requests(request_id, account_id, name, location, starts_at) added; ids follow from the request's."""
    new = requests.where("name is not null and location is not null and starts_at is not null")
    rows = new.select(F.concat(F.lit("m"), F.col("request_id")).alias("id"), F.col("account_id").alias("created_by_account_id"), "name", "location", "starts_at")
    return meetups.unionByName(rows.select(*[F.col(c).cast(t) for c, t in meetups.dtypes]))


def add_participants(participants: DataFrame, requests: DataFrame, meetups: DataFrame) -> DataFrame:
    """Participants with requests(request_id, meetup_id, account_id, owner_id, name, travel_mode, ts) to owned meetups added."""
    own = requests.join(meetups.select(F.col("id").alias("meetup_id"), F.col("created_by_account_id").alias("owner_id")), ["meetup_id", "owner_id"], "left_semi")
    rows = own.select(
        F.concat(F.lit("p"), F.col("request_id")).alias("id"), "meetup_id", "account_id", F.col("owner_id").alias("created_by_account_id"), "name",
        F.coalesce("travel_mode", F.lit("transit")).alias("travel_mode"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), F.col("ts").alias("created_at"),
    )
    return participants.unionByName(rows.select(*[F.col(c).cast(t) for c, t in participants.dtypes]))


CHANGED = ("name", "travel_mode", "latitude", "longitude", "account_id")


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each participant by (seq, change_id)."""
    fields = [c for c in changes.columns if c not in ("meetup_id", "participant_id")]
    last = changes.groupBy("meetup_id", "participant_id").agg(F.max_by(F.struct(*fields), F.struct("seq", "change_id")).alias("c"))
    return last.select("meetup_id", "participant_id", "c.*")


def replace_participants(participants: DataFrame, changes: DataFrame) -> DataFrame:
    """Participants after full replaces: what the last change leaves out is null, a mode left out is transit.

    A change to an unknown pair of meetup and participant has no effect.
    """
    last = latest_changes(changes).select(F.col("meetup_id").alias("m"), F.col("participant_id").alias("p"), F.struct(*CHANGED).alias("c"))
    joined = participants.join(last, (F.col("meetup_id") == F.col("m")) & (F.col("id") == F.col("p")), "left")
    new = {c: F.when(F.col("c").isNotNull(), F.coalesce("c.travel_mode", F.lit("transit")) if c == "travel_mode" else F.col(f"c.{c}")).otherwise(F.col(c)) for c in CHANGED}
    return joined.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in participants.columns])


def patch_participants(participants: DataFrame, changes: DataFrame) -> DataFrame:
    """Participants after partial changes: each column takes its last value that is not null."""
    order = F.struct("seq", "change_id")
    last = changes.groupBy(F.col("meetup_id").alias("m"), F.col("participant_id").alias("p")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"n_{c}") for c in CHANGED])
    joined = participants.join(last, (F.col("meetup_id") == F.col("m")) & (F.col("id") == F.col("p")), "left")
    return joined.select(*[(F.coalesce(f"n_{c}", c) if c in CHANGED else F.col(c)).alias(c) for c in participants.columns])


def linked_account_rejects(changes: DataFrame, accounts: DataFrame) -> DataFrame:
    """Changes that link an account that does not exist; a null link passes."""
    bad = changes.where("account_id is not null").join(accounts.select(F.col("id").alias("account_id")), "account_id", "left_anti")
    return bad.withColumn("status", F.lit("account_not_found")).withColumn("message", F.format_string(OUTCOMES["account_not_found"][1], F.col("account_id").cast("string")))


def error(bad, place: str, kind: str):
    """The place and type of an error where ``bad`` holds."""
    return F.when(bad, F.struct(F.lit(place).alias("location"), F.lit(kind).alias("type")))


def link_errors(requests: DataFrame) -> list:
    """An account_id that is there must be a UUID; requests without the column link nothing."""
    if "account_id" not in requests.columns:
        return []
    c = F.col("account_id").cast("string")
    return [error(c.isNotNull() & text.normalize_uuid(c).isNull(), "body.account_id", "uuid_parsing")]


def with_errors(requests: DataFrame, errors: list) -> DataFrame:
    found = requests.withColumn("errors", F.array_compact(F.array(*errors)))
    return found.withColumn("status", F.when(F.size("errors") > 0, "validation_error").otherwise(OK))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Participants' requests of strings (name, travel_mode, latitude, longitude, account_id if any) with ``errors``: every bad field's place and type at once."""

    def number(c):
        return F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()

    both = F.col("latitude").isNull() != F.col("longitude").isNull()
    return with_errors(requests, [
        error(F.col("name").isNull(), "body.name", "missing"),
        error(F.col("travel_mode").isNotNull() & ~F.col("travel_mode").isin(*MODES), "body.travel_mode", "enum"),
        error(number("latitude"), "body.position.latitude", "float_parsing"), error(number("longitude"), "body.position.longitude", "float_parsing"),
        error(both & F.col("latitude").isNull(), "body.position.latitude", "missing"), error(both & F.col("longitude").isNull(), "body.position.longitude", "missing"),
        *link_errors(requests),
    ])


def validate_meetups(requests: DataFrame) -> DataFrame:
    """Requests of strings (name, location, starts_at) that make meetups, with ``errors`` likewise; starts_at is an ISO time."""
    at = F.col("starts_at")
    return with_errors(requests, [
        error(F.col("name").isNull(), "body.name", "missing"), error(F.col("location").isNull(), "body.location", "missing"),
        error(at.isNull(), "body.starts_at", "missing"), error(at.isNotNull() & at.try_cast("timestamp").isNull(), "body.starts_at", "datetime_parsing"),
        *link_errors(requests),
    ])


def delete_meetups(participants: DataFrame, deleted: DataFrame) -> DataFrame:
    """Participants that are left after deleted(meetup_id): those of the meetups go too."""
    return participants.join(deleted.select("meetup_id"), "meetup_id", "left_anti")


def delete_accounts(participants: DataFrame, deleted: DataFrame) -> DataFrame:
    """Participants after deleted(account_id): links to them become null."""
    gone = deleted.select(F.col("account_id").alias("__a")).distinct()
    joined = participants.join(gone, F.col("account_id") == F.col("__a"), "left")
    return joined.withColumn("account_id", F.when(F.col("__a").isNull(), F.col("account_id"))).select(*participants.columns)


def outcome_catalogue(spark) -> DataFrame:
    return spark.createDataFrame([(k, s, m) for k, (s, m) in OUTCOMES.items()], "code string, status int, message string")

"""Text expressions: blanks, localised texts, addresses, profiles, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All Unicode white space and the four information separators.
BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: The user's metadata that an account keeps.
PROFILE_KEYS = ("full_name", "name", "user_name", "preferred_username", "locale")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, BLANKS, "")


def first_nonblank(*columns: Column) -> Column:
    """The first that is neither null nor blank, stripped."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns])


def first_nonempty(*columns: Column) -> Column:
    """The first that is neither null nor empty; a blank one counts."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def localised(lang: Column, de: Column, en: Column) -> Column:
    return F.when(lang == "en", first_nonblank(en, de)).otherwise(first_nonblank(de, en))


def title(lang: Column, de: Column, en: Column) -> Column:
    return F.coalesce(localised(lang, de, en), F.lit("Untitled event"))


def address(street: Column, postcode: Column, city: Column) -> Column:
    """`street, postcode city`; null without a street, the street alone without the rest."""
    locality = F.nullif(F.concat_ws(" ", first_nonblank(postcode), first_nonblank(city)), F.lit(""))
    return F.when(first_nonblank(street).isNotNull(), F.concat_ws(", ", first_nonblank(street), locality))


def rounded(metres: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.bround(metres, 0).cast("int")


def minutes(seconds: Column) -> Column:
    """Whole minutes, halves up."""
    return F.floor(seconds / 60 + F.lit(0.5)).cast("long")


def _get(json: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(json), path, kind)


def display_name(claims: Column) -> Column:
    return first_nonempty(*[_get(claims, f"$.user_metadata.{k}") for k in ("full_name", "name", "user_name", "preferred_username")])


def avatar_url(claims: Column) -> Column:
    return first_nonempty(_get(claims, "$.user_metadata.avatar_url"), _get(claims, "$.user_metadata.picture"))


def providers(claims: Column) -> Column:
    """The list of providers; else the one provider as a list; else an empty list."""
    many = _get(claims, "$.app_metadata.providers", "array<string>")
    one = F.nullif(_get(claims, "$.app_metadata.provider"), F.lit(""))
    return F.when(F.size(many) > 0, many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def auth_metadata(claims: Column) -> Column:
    everything = F.coalesce(_get(claims, "$.user_metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_filter(everything, lambda k, _: k.isin(*PROFILE_KEYS))


def normalize_uuid(c: Column) -> Column:
    """Canonical lower-case form of a UUID in any usual spelling; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(c, "urn:|uuid:", ""), r"^[{}]+|[{}]+$", "")
    digits = F.lower(F.regexp_replace(bare, "-", ""))
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(digits.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))

"""User profiles, roles and ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import strip


def normalized_role(raw: Column) -> Column:
    """'admin' for the two administrator spellings, everything else is an inspector."""
    return F.when(F.lower(F.trim(F.coalesce(raw, F.lit("inspector")))).isin(V.ADMIN_ROLES), F.lit("admin")).otherwise(
        "inspector"
    )


def is_admin(role: Column) -> Column:
    return F.lower(F.coalesce(role, F.lit(""))).isin(V.ADMIN_ROLES)


def profile_name(full_name: Column, name: Column, email: Column) -> Column:
    """Name for a new profile: given name, else the e-mail's local part, else the default."""
    return F.coalesce(full_name, name, F.split_part(email, F.lit("@"), F.lit(1)), F.lit(V.DEFAULT_OFFICER))


def _real_name(value: Column) -> Column:
    tidy = F.regexp_replace(strip(F.coalesce(value, F.lit(""))), r"\s+", " ")
    return F.when((tidy != "") & ~F.lower(tidy).isin(V.PLACEHOLDER_NAMES), tidy)


def display_name(full_name: Column, name: Column, email: Column, role: Column) -> Column:
    """Name shown to people: placeholders count as missing, an e-mail prefix is made readable."""
    prefix = F.split_part(F.coalesce(email, F.lit("")), F.lit("@"), F.lit(1))
    readable = _real_name(F.regexp_replace(prefix, r"[._-]+", " "))
    capital = F.array_join(
        F.transform(
            F.split(readable, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
        ),
        " ",
    )
    return F.coalesce(
        _real_name(full_name), _real_name(name), capital, F.when(is_admin(role), F.lit("Admin")).otherwise("User")
    )


def resolve_users(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Signed-in users with the profile's name and role winning over the token's."""
    p = profiles.select(
        "user_no", F.col("full_name").alias("p_name"), F.col("role").alias("p_role"), F.lit(True).alias("stored")
    )
    # a stored profile wins even where it is null
    role = F.when(F.col("stored"), F.col("p_role")).otherwise(F.coalesce("raw_role", F.lit("inspector")))
    return users.join(p, "user_no", "left").select(
        "user_no",
        "email",
        F.when(F.col("stored"), F.col("p_name"))
        .otherwise(F.coalesce("full_name", F.lit(V.DEFAULT_INSPECTOR)))
        .alias("full_name"),
        F.when(role.isin(V.KNOWN_ROLES), role).otherwise("inspector").alias("role"),
    )


def new_profiles(users: DataFrame) -> DataFrame:
    return users.select(
        "user_no",
        profile_name(F.col("full_name"), F.lit(None).cast("string"), F.col("email")).alias("full_name"),
        normalized_role(F.col("raw_role")).alias("role"),
    )


def backfill_profiles(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Existing profiles plus one for every user without."""
    missing = users.join(profiles.select("user_no"), "user_no", "left_anti")
    return profiles.select("user_no", "full_name", "role").unionByName(new_profiles(missing))


def upsert_profiles(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Insert or complete profiles: what is already stored and not null stays."""
    new = new_profiles(users).select(
        "user_no", F.col("full_name").alias("n_name"), F.col("role").alias("n_role")
    )
    return profiles.join(new, "user_no", "full_outer").select(
        "user_no",
        F.coalesce("full_name", "n_name").alias("full_name"),
        F.coalesce("role", "n_role").alias("role"),
    )


def drop_unknown_owners(records: DataFrame, profiles: DataFrame, owner: str = "user_no") -> DataFrame:
    """Owner set to null where no profile exists."""
    known = profiles.select(F.col("user_no").alias("__known"))
    return (
        records.join(known, F.col(owner) == F.col("__known"), "left").withColumn(owner, F.col("__known")).drop("__known")
    )


def backfill_owner(records: DataFrame, owner: str, legacy: str) -> DataFrame:
    """Owner taken from the legacy column where it is null."""
    return records.withColumn(owner, F.coalesce(F.col(owner), F.col(legacy)))


def uuid_or_null(value: Column) -> Column:
    """Only values shaped like a UUID may be owners of stored records."""
    return F.when(value.rlike(V.UUID_SHAPE), value)

"""Membership, invitations, roles, paging and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OWNER, INSTRUCTOR, MEMBER = "OWNER", "INSTRUCTOR", "MEMBER"


def access_state(requests: DataFrame, memberships: DataFrame, courses: DataFrame, user: str, course: str) -> DataFrame:
    """requests with `status`: 200 for members, 403 where the course exists, else 404."""
    m = memberships.select(F.col(user).alias("_u"), F.col(course).alias("_c")).distinct()
    c = courses.select(F.col(course).alias("_k")).distinct()
    out = requests.join(m, (F.col(user) == F.col("_u")) & (F.col(course) == F.col("_c")), "left").join(c, F.col(course) == F.col("_k"), "left")
    return out.withColumn("status", F.when(F.col("_u").isNotNull(), 200).when(F.col("_k").isNotNull(), 403).otherwise(404)).drop("_u", "_c", "_k")


def manages(role: Column) -> Column:
    return role != MEMBER


def may_grant(actor: Column, granted: Column) -> Column:
    """Owners grant all but ownership; instructors grant membership."""
    return F.when(granted == OWNER, False).when(granted == INSTRUCTOR, actor == OWNER).otherwise(manages(actor))


def expired(expires_at: Column, now: Column) -> Column:
    return F.coalesce(expires_at < now, F.lit(False))


def invite_state(found: Column, revoked: Column, expires_at: Column, bound_email: Column, email: Column, now: Column) -> Column:
    """404 for an unknown or revoked invitation, then 410 for an expired one, then 403 for another's, else 200."""
    other = bound_email.isNotNull() & ~F.coalesce(F.lower(bound_email) == F.lower(email), F.lit(False))
    return F.when(~found | revoked, 404).when(expired(expires_at, now), 410).when(other, 403).otherwise(200)


def accept_invites(requests: DataFrame, memberships: DataFrame, user: str, course: str, role: str) -> DataFrame:
    """requests with the role held afterwards and `joined`: whether a membership is new. Only then is an e-mail invitation spent."""
    m = memberships.select(F.col(user).alias("_u"), F.col(course).alias("_c"), F.col(role).alias("_held"))
    first = Window.partitionBy(user, course).orderBy(role)
    asked = requests.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    out = asked.join(m, (F.col(user) == F.col("_u")) & (F.col(course) == F.col("_c")), "left")
    return out.select(user, course, F.coalesce("_held", role).alias("held_role"), F.col("_u").isNull().alias("joined"))


def expires_in(now: Column, hours: Column) -> Column:
    """The time `hours` from now; null hours never expire."""
    return now + F.make_dt_interval(hours=hours)


def invites_by_token(asked: DataFrame, invites: DataFrame, courses: DataFrame, owners: DataFrame, token: str, course: str, owner: str) -> DataFrame:
    """asked with the invitation of its token, that invitation's course and the course's owner; unknown tokens go."""
    return asked.join(invites, token).join(courses, course).join(owners, owner)


def clamp_page(number: Column, n_pages: Column) -> Column:
    """Pages are counted from 1."""
    return F.least(F.greatest(number, F.lit(1)), n_pages)


def page(rows: DataFrame, order: list[Column], number: int = 0, size: int = 20) -> DataFrame:
    """One page of rows, pages counted from 0."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def page_totals(rows: DataFrame, size: int = 20) -> DataFrame:
    """(total_elements, total_pages), without the joins of the listing."""
    return rows.agg(F.count(F.lit(1)).alias("total_elements")).withColumn("total_pages", F.ceil(F.col("total_elements") / size).cast("long"))


def errors(rules: dict[str, list[tuple[Column, str]]]) -> Column:
    """A map of field to its first broken rule's message; rules are (whether it holds, message), and null doesn't hold."""
    found = [F.struct(F.lit(name).alias("key"), F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(said)) for ok, said in checks]).alias("value")) for name, checks in rules.items()]
    return F.map_from_entries(F.filter(F.array(*found), lambda x: x["value"].isNotNull()))

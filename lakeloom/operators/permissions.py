"""Who may do what: roles with inheritance, stored once, and checks of one, any or all permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.joins import closure


class AccessTable:
    """A stored row for each user: super (may do anything) and the permissions of all roles that the user has or inherits.

    The closure of the roles is made when the table is built, from role edges only; checks read the stored rows and join nothing. A user's list is
    as long as there are permissions at most. Null roles and permissions grant nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def build(self, users: DataFrame, user_roles: DataFrame, hierarchy: DataFrame, role_permissions: DataFrame) -> AccessTable:
        """users: user, super; user_roles: user, role; hierarchy: child, parent (a child has what its parents have); role_permissions: role, permission."""
        closure(self.spark, hierarchy).select(F.col("node").alias("role"), F.col("ancestor").alias("has")).write.parquet(f"{self.root}/inherited")
        inherited = self.spark.read.parquet(f"{self.root}/inherited")
        own = role_permissions.select(F.col("role").alias("has"), "permission")
        direct = own.select(F.col("has").alias("role"), "permission")
        of_role = direct.unionByName(inherited.join(own, "has").select("role", "permission")).filter("permission is not null").distinct()
        sets = user_roles.join(of_role, "role").groupBy("user").agg(F.array_sort(F.collect_set("permission")).alias("permissions"))
        both = users.join(sets, "user", "left")
        both.select("user", F.coalesce("super", F.lit(False)).alias("super"), F.coalesce("permissions", F.array().cast("array<string>")).alias("permissions")).write.parquet(f"{self.root}/access")
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/access")


def _list(wanted) -> Column:
    return wanted if isinstance(wanted, Column) else F.array(*map(F.lit, wanted)).cast("array<string>")


def has_permission(permission: str | Column) -> Column:
    return F.col("super") | F.array_contains("permissions", permission)


def has_any(wanted: list[str] | Column) -> Column:
    """Whether one of the wanted is there; of none, only a super user has one."""
    return F.col("super") | F.coalesce(F.arrays_overlap("permissions", _list(wanted)), F.lit(False))


def has_all(wanted: list[str] | Column) -> Column:
    """Whether none of the wanted is missing; everyone has all of none."""
    return F.col("super") | (F.size(F.array_except(_list(wanted), F.col("permissions"))) == 0)

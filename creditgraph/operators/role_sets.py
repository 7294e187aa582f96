"""Which roles a request means: expansion of names and categories, defaults, and the split into structural and other roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import STRUCTURAL

# The roles of a request that names none, by type of entity.
DEFAULT_ROLES = {1: ("Alias", "Member Of"), 2: ("Released On",)}


def expand_roles(requests: DataFrame, role: DataFrame) -> DataFrame:
    """(request_id, role_name), distinct, of requests (request_id, entity_type, roles).

    roles is a list of names with commas between, a comma inside a name after a backslash. A name of a category or subcategory stands for all its
    roles, else one of a role for that role, and others for nothing; what then has no role gets the defaults of its type.
    """
    known = role.select("role_name").distinct()
    groups = [role.select(F.col(c).cast("string").alias("term"), "role_name") for c in ("role_category", "role_subcategory") if c in role.columns]
    of_group = groups[0]
    for g in groups[1:]:
        of_group = of_group.unionByName(g)
    of_group = of_group.where("term is not null").distinct()
    terms = requests.select("request_id", F.explode(F.split("roles", r"(?<!\\),")).alias("t")).select("request_id", F.replace("t", F.lit("\\,"), F.lit(",")).alias("term")).distinct()
    by_group = terms.join(of_group, "term").select("request_id", "role_name")
    by_name = terms.join(of_group, "term", "left_anti").join(known.withColumn("term", F.col("role_name")), "term").select("request_id", "role_name")
    found = by_group.unionByName(by_name).distinct()
    defaults = F.create_map(*(x for k, v in DEFAULT_ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rest = requests.join(found.select("request_id").distinct(), "request_id", "left_anti").select("request_id", F.explode(F.try_element_at(defaults, F.col("entity_type"))).alias("role_name"))
    return found.unionByName(rest.distinct())


def partition_roles(names: list[str], role: DataFrame) -> tuple[list[str], list[str]]:
    """names, split into structural roles and others, in their order; a name that role (role_name) lacks is an error."""
    known = {r["role_name"] for r in role.where(F.col("role_name").isin(names)).select("role_name").distinct().collect()}
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown roles: {', '.join(unknown)}")
    return [n for n in names if n in STRUCTURAL], [n for n in names if n not in STRUCTURAL]

"""Internal ids, entity and link keys, URLs: pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
ARTIST, LABEL = 1, 2
LABEL_OFFSET = 1_000_000_000
MISSING = -2_000_000_000
TYPE_NAMES = {ARTIST: "artist", LABEL: "label"}


def internal_id(entity_id: Column, entity_type: Column) -> Column:
    """Artists keep their id, labels add an offset; an artist id that reaches the offset is an error."""
    bad = F.raise_error(F.concat(F.lit("artist id out of range: "), entity_id.cast("string"))).cast("bigint")
    return F.when(entity_type == LABEL, F.when(entity_id < 0, F.lit(MISSING)).otherwise(entity_id + LABEL_OFFSET)).when(entity_id >= LABEL_OFFSET, bad).otherwise(entity_id).cast("bigint")


def external_id(id_: Column) -> Column:
    """struct(entity_id, entity_type) of an internal id; the missing label is (-1, label)."""
    return F.when(id_ == MISSING, F.struct(F.lit(-1).cast("bigint").alias("entity_id"), F.lit(LABEL).alias("entity_type"))).when(id_ >= LABEL_OFFSET, F.struct((id_ - LABEL_OFFSET).cast("bigint").alias("entity_id"), F.lit(LABEL).alias("entity_type"))).otherwise(F.struct(id_.cast("bigint").alias("entity_id"), F.lit(ARTIST).alias("entity_type")))


def label_internal_id(entity_id: Column) -> Column:
    """A label's internal id; null and 0 are the missing label, encoded ids stay as they are."""
    return F.when(entity_id.isNull() | (entity_id == 0), F.lit(MISSING)).when((entity_id == MISSING) | (entity_id >= LABEL_OFFSET), entity_id).otherwise(entity_id + LABEL_OFFSET).cast("bigint")


def type_name(entity_type: Column) -> Column:
    return F.when(entity_type == ARTIST, TYPE_NAMES[ARTIST]).when(entity_type == LABEL, TYPE_NAMES[LABEL])


def entity_key(id_: Column) -> Column:
    """artist-9 or label-9 of an internal id."""
    own = external_id(id_)
    return F.concat_ws("-", type_name(own["entity_type"]), own["entity_id"])


def role_slug(role: Column) -> Column:
    return F.lower(F.regexp_replace(role, r"\s+", "-"))


def link_key(one: Column, role: Column, two: Column) -> Column:
    return F.concat_ws("-", entity_key(one), role_slug(role), entity_key(two))


def ends_key(one: Column, role: Column, two: Column) -> Column:
    """struct(role, smaller end, larger end), ends compared as (type name, id)."""
    a, b = (F.struct(type_name(external_id(x)["entity_type"]).alias("type"), external_id(x)["entity_id"].alias("id")) for x in (one, two))
    return F.struct(role.alias("role"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def entity_url(id_: Column, base: str) -> Column:
    own = external_id(id_)
    return F.when(own["entity_id"] > 0, F.concat_ws("/", F.lit(base.rstrip("/")), type_name(own["entity_type"]), own["entity_id"]))

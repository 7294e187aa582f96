"""Dump files: gzip XML of artists, labels, releases and masters; role and instrument tables; the dump calendar."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import ARTIST, LABEL, internal_id
from ..functions.role_grammar import normalise_roles, parse_roles
from ..functions.roles import instrument_subcategory
from ..functions.text import clean_text, release_date

# Names and layouts of dump files.
FILE = "discogs_{date}_{tag}s.xml.gz"
ARTIST_SCHEMA = "id BIGINT, name STRING, realname STRING, profile STRING, namevariations STRUCT<name: ARRAY<STRING>>, urls STRUCT<url: ARRAY<STRING>>, aliases STRUCT<name: ARRAY<STRING>>, groups STRUCT<name: ARRAY<STRING>>, members STRING"
LABEL_SCHEMA = "id BIGINT, name STRING, contact_info STRING, profile STRING, parentLabel STRING, sublabels STRUCT<label: ARRAY<STRING>>, urls STRUCT<url: ARRAY<STRING>>"
CREDIT = "ARRAY<STRUCT<id: BIGINT, name: STRING, anv: STRING, `join`: STRING, role: STRING, tracks: STRING>>"
RELEASE_SCHEMA = (
    "_id BIGINT, title STRING, country STRING, released STRING, master_id STRING, notes STRING, genres STRUCT<genre: ARRAY<STRING>>, styles STRUCT<style: ARRAY<STRING>>, "
    f"artists STRUCT<artist: {CREDIT}>, extraartists STRUCT<artist: {CREDIT}>, labels STRUCT<label: ARRAY<STRUCT<_name: STRING, _catno: STRING>>>, "
    "companies STRUCT<company: ARRAY<STRUCT<id: BIGINT, name: STRING, catno: STRING, entity_type: STRING, entity_type_name: STRING>>>, "
    "formats STRUCT<format: ARRAY<STRUCT<_name: STRING, _qty: STRING, _text: STRING, descriptions: STRUCT<description: ARRAY<STRING>>>>>, "
    "identifiers STRUCT<identifier: ARRAY<STRUCT<_type: STRING, _value: STRING, _description: STRING>>>, "
    f"tracklist STRUCT<track: ARRAY<STRUCT<position: STRING, title: STRING, duration: STRING, artists: STRUCT<artist: {CREDIT}>, extraartists: STRUCT<artist: {CREDIT}>>>>"
)
MASTER_SCHEMA = (
    f"_id BIGINT, title STRING, year STRING, main_release STRING, data_quality STRING, artists STRUCT<artist: {CREDIT}>, genres STRUCT<genre: ARRAY<STRING>>, styles STRUCT<style: ARRAY<STRING>>, "
    "videos STRUCT<video: ARRAY<STRUCT<_src: STRING, _duration: STRING, _embed: STRING, title: STRING, description: STRING>>>, images STRUCT<image: ARRAY<STRUCT<_type: STRING, _width: STRING, _height: STRING>>>"
)


def read_xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("nullValue", "").schema(schema).load(path)


def name_map(names):
    """map name -> null of an array of names, nulls and repeats left out; null if none is left."""
    kept = F.array_distinct(F.filter(names, lambda n: clean_text(n).isNotNull()))
    return F.when(F.size(kept) > 0, F.map_from_arrays(kept, F.transform(kept, lambda _: F.lit(None).cast("bigint"))))


def pair_members(inner):
    """map name -> id of a members element's inner XML: an <id> holds for the next <name> only; of repeated names the last counts."""
    tags = F.regexp_extract_all(inner, F.lit(r"<(?:id|name)[^>]*>[^<]*</(?:id|name)>"), F.lit(0))
    start = F.struct(F.lit(0).cast("bigint").alias("id"), F.array().cast("array<struct<name: string, id: bigint>>").alias("pairs"))

    def step(s, tag):
        body = F.regexp_extract(tag, ">([^<]*)<", 1)
        named = F.concat(F.filter(s["pairs"], lambda p: p["name"] != unescaped(body)), F.array(F.struct(unescaped(body).alias("name"), s["id"].alias("id"))))
        return F.when(F.startswith(tag, F.lit("<id")), F.struct(F.coalesce(body.try_cast("bigint"), F.lit(0).cast("bigint")).alias("id"), s["pairs"].alias("pairs"))).otherwise(F.struct(F.lit(0).cast("bigint").alias("id"), named.alias("pairs")))

    pairs = F.aggregate(tags, start, step)["pairs"]
    return F.when(F.size(pairs) > 0, F.map_from_entries(pairs))


def unescaped(text):
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def read_artists(spark: SparkSession, path: str) -> DataFrame:
    raw = read_xml(spark, path, "artist", ARTIST_SCHEMA)
    entities = F.struct(name_map(F.col("aliases.name")).alias("aliases"), name_map(F.col("groups.name")).alias("groups"), pair_members(F.col("members")).alias("members"), F.lit(None).cast("map<string,bigint>").alias("parent_label"), F.lit(None).cast("map<string,bigint>").alias("sublabels"))
    meta = F.struct(clean_text(F.col("profile")).alias("profile"), clean_text(F.col("realname")).alias("real_name"), F.lit(None).cast("string").alias("contact_info"), F.col("namevariations.name").alias("name_variations"), F.col("urls.url").alias("urls"))
    return packed(raw, ARTIST, meta, entities)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels at the top only: those nested in sublabels are names of the outer one."""
    raw = read_xml(spark, path, "label", LABEL_SCHEMA)
    none = F.lit(None).cast("map<string,bigint>")
    entities = F.struct(none.alias("aliases"), none.alias("groups"), none.alias("members"), name_map(F.array("parentLabel")).alias("parent_label"), name_map(F.col("sublabels.label")).alias("sublabels"))
    meta = F.struct(clean_text(F.col("profile")).alias("profile"), F.lit(None).cast("string").alias("real_name"), clean_text(F.col("contact_info")).alias("contact_info"), F.lit(None).cast("array<string>").alias("name_variations"), F.col("urls.url").alias("urls"))
    return packed(raw, LABEL, meta, entities)


def packed(raw: DataFrame, kind: int, meta, entities) -> DataFrame:
    named = raw.withColumn("entity_name", clean_text(F.col("name"))).where("entity_name is not null")
    return named.select(internal_id(F.col("id"), F.lit(kind)).alias("id"), F.col("id").alias("entity_id"), F.lit(kind).alias("entity_type"), "entity_name", F.lit(None).cast("map<string,bigint>").alias("relation_counts"), meta.alias("entity_metadata"), entities.alias("entities"))


def with_roles(credits):
    """Credits with the role text beside; the roles themselves are parsed once for each distinct text, see role_table()."""
    return F.transform(credits, lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["anv"].alias("anv"), c["join"].alias("join"), F.when(c["role"].isNotNull(), F.array(F.struct(c["role"].alias("name")))).alias("roles"), c["tracks"].alias("tracks")))


def role_table(texts: DataFrame) -> DataFrame:
    """(raw, name, detail) of distinct role texts (raw)."""
    return texts.select("raw").distinct().select("raw", F.explode(parse_roles(F.col("raw"))).alias("r")).select("raw", "r.name", "r.detail")


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    r = read_xml(spark, path, "release", RELEASE_SCHEMA).where(clean_text(F.col("title")).isNotNull())
    track = F.transform("tracklist.track", lambda t: F.struct(t["position"].alias("position"), t["title"].alias("title"), t["duration"].alias("duration"), with_roles(t["artists"]["artist"]).alias("artists"), with_roles(t["extraartists"]["artist"]).alias("extra_artists")))
    formats = F.transform("formats.format", lambda f: F.struct(f["_name"].alias("name"), f["_qty"].alias("quantity"), f["_text"].alias("text"), f["descriptions"]["description"].alias("descriptions")))
    identifiers = F.transform("identifiers.identifier", lambda i: F.struct(i["_description"].alias("description"), i["_type"].alias("type"), i["_value"].alias("value")))
    companies = F.transform("companies.company", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["catno"].alias("catalog_number"), c["entity_type"].try_cast("int").alias("entity_type"), c["entity_type_name"].alias("entity_type_name")))
    labels = F.transform("labels.label", lambda x: F.struct(F.lit(None).cast("bigint").alias("id"), x["_name"].alias("name"), x["_catno"].alias("catalog_number")))
    return r.select(
        F.col("_id").alias("release_id"), clean_text(F.col("title")).alias("title"), clean_text(F.col("country")).alias("country"), release_date(F.col("released")).alias("release_date"), F.col("master_id").try_cast("bigint").alias("master_id"), F.lit(None).cast("string").alias("notes"),
        F.col("genres.genre").alias("genres"), F.col("styles.style").alias("styles"), with_roles(F.col("artists.artist")).alias("artists"), with_roles(F.col("extraartists.artist")).alias("extra_artists"),
        labels.alias("labels"), companies.alias("companies"), formats.alias("formats"), identifiers.alias("identifiers"), track.alias("tracklist"),
    )


def read_masters(spark: SparkSession, path: str) -> DataFrame:
    m = read_xml(spark, path, "master", MASTER_SCHEMA).where(clean_text(F.col("title")).isNotNull())
    videos = F.transform("videos.video", lambda v: F.struct(v["_src"].alias("src"), (F.lower(v["_embed"]) == "true").alias("embed"), v["_duration"].try_cast("int").alias("duration"), v["title"].alias("title"), v["description"].alias("description")))
    images = F.transform("images.image", lambda i: F.struct(i["_type"].alias("type"), i["_width"].try_cast("int").alias("width"), i["_height"].try_cast("int").alias("height")))
    return m.select(F.col("_id").alias("master_id"), clean_text(F.col("title")).alias("title"), F.col("year").try_cast("int").alias("year"), "main_release", "data_quality", with_roles(F.col("artists.artist")).alias("artists"), F.col("genres.genre").alias("genres"), F.col("styles.style").alias("styles"), videos.alias("videos"), images.alias("images"))


def resolve_dump(spark: SparkSession, folder: str, tag: str, date: str = "") -> str:
    """The dump of a tag: of a date, or the last by name among those whose date begins so."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/{FILE.format(date=date + '*', tag=tag)}")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    names = sorted(str(f.getPath()) for f in found or [])
    if not names:
        raise FileNotFoundError(f"no dump of {tag}s for {date or 'any date'} in {folder}")
    return names[-1]


def dump_dates(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(date): the first of each month, stepping by months from start until end."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(days).alias("d")).select(F.trunc("d", "MM").cast("date").alias("date"))


def read_roles(spark: SparkSession, folder: str) -> DataFrame:
    """(role_name, category, subcategory) of all role tables in a folder."""
    raw = spark.read.option("header", True).schema("name STRING, category STRING, subcategory STRING").csv(f"{folder}/*.csv")
    return raw.select(F.explode(normalise_roles(F.col("name"))).alias("role_name"), "category", F.coalesce("subcategory", F.lit("NONE")).alias("subcategory")).distinct()


def read_instruments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Instrument tables, whose columns differ; each is read by its own header."""
    out = None
    for p in paths:
        t = spark.read.option("header", True).csv(p).select("Instrument", F.lit(re.sub(r".*/|\.csv$", "", p)).alias("kind"))
        out = t if out is None else out.unionByName(t)
    named = out.select(F.explode(normalise_roles(F.col("Instrument"))).alias("role_name"), F.lit("INSTRUMENTS").alias("category"), instrument_subcategory(F.col("kind")).alias("subcategory"))
    return named.distinct()


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Instruments of a taxonomy {key: {Label, Instruments, Description}}; the class is the label of the key's first character."""
    text = spark.read.text(path, wholetext=True)
    nodes = text.select(F.explode(F.from_json("value", "MAP<STRING, STRUCT<Label: STRING, Instruments: ARRAY<STRING>, Description: STRING>>")).alias("key", "n"))
    top = nodes.select(F.col("key").alias("top"), F.col("n.Label").alias("kind"))
    each = nodes.select(F.substring("key", 1, 1).alias("top"), F.explode("n.Instruments").alias("name")).join(F.broadcast(top), "top", "left").withColumn("kind", F.coalesce("kind", F.lit("Unknown")))
    return each.select(F.explode(normalise_roles(F.col("name"))).alias("role_name"), F.lit("INSTRUMENTS").alias("category"), instrument_subcategory(F.col("kind")).alias("subcategory")).distinct()

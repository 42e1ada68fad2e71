"""Build the restricted-party list from its published CSV files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PRIMARY = "ent_num string, name string, kind string, program string"
_ALIAS = "ent_num string, alias_num string, alias_type string, alias string"


def _clean(c: str) -> Column:
    return F.nullif(F.regexp_replace(F.trim(c), "^-0-$", ""), F.lit(""))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).csv(path, header=False, quote='"', escape='"', mode="PERMISSIVE")
    # Order decides which duplicate wins and the order of aliases: files by name, rows by their place in the file, which
    # ids of one file's splits keep.
    return rows.withColumn("row", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place")))


def build_sanctions_snapshot(spark: SparkSession, primary_csv: str, alias_csv: str, list_name: str) -> DataFrame:
    names = [c.strip().split()[0] for c in _PRIMARY.split(",")]
    primary = _read(spark, primary_csv, _PRIMARY).select("row", *[_clean(c).alias(c) for c in names]).where(
        "ent_num is not null and name is not null")
    # The last row of an entity wins but keeps the place of its first.
    entities = primary.groupBy("ent_num").agg(
        F.min("row").alias("list_row"), F.max_by(F.struct("name", "kind", "program"), "row").alias("e")).select("ent_num", "list_row", "e.*")
    aliases = (
        _read(spark, alias_csv, _ALIAS).select("row", _clean("ent_num").alias("ent_num"), _clean("alias").alias("alias"))
        .where("ent_num is not null and alias is not null")
        .groupBy("ent_num", "alias").agg(F.min("row").alias("row"))
        .groupBy("ent_num").agg(F.array_sort(F.collect_list(F.struct("row", "alias"))).alias("a"))
        .select("ent_num", F.transform("a", lambda x: x["alias"]).alias("aliases"))
    )
    kind = F.lower("kind")
    return entities.join(aliases, "ent_num", "left").select(
        F.concat(F.lit(f"{list_name}-"), "ent_num").alias("record_id"), "name",
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "program",
        F.when(kind.isin("individual", "vessel", "aircraft"), kind).when(kind.isNull(), "entity").otherwise("unknown").alias("entity_type"),
        F.lit(list_name).alias("list"), F.lit(None).cast("string").alias("jurisdiction"), "list_row")


def union_snapshots(parts: list[DataFrame]) -> DataFrame:
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, tagged)

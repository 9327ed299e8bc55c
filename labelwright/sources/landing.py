"""Landed JSON lines: items, contributors and provider answers, read under an explicit schema and laid out as flat tables.

Lines are parsed once and kept as Parquet; every table comes from there.  What is no JSON object of the schema, or has no
id, goes to a quarantine with its reason and its text, and no line is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.functions.text import blank_to_null, strip
from labelwright.sources.shared import fresh_path

_LABELS = "array<struct<id:string,name:string>>"
_PERSON = f"id:string,name:string,category:string,birth_date:string,group_text:string,country:string,metric_a:int,metric_b:int,text_a:string,text_b:string,labels:{_LABELS}"
CONTRIBUTOR = ", ".join(x.replace(":", " ", 1) for x in _PERSON.split(",labels:")[0].split(",")) + f", labels {_LABELS}"
ITEM = (
    "id string, title string, date string, code string, details string, director string, urls array<string>, files array<struct<path:string,fingerprints:array<struct<type:string,value:string>>>>, "
    f"labels {_LABELS}, contributors array<struct<{_PERSON}>>, source struct<id:string,name:string>, external_ids array<struct<endpoint:string,ext_id:string>>"
)
ANSWER = (
    "item_id string, provider string, failure string, candidates array<struct<title:string,date:string,code:string,details:string,director:string,urls:array<string>,remote_id:string,"
    "labels:array<struct<stored_id:string,name:string>>,contributors:array<struct<stored_id:string,name:string,remote_id:string>>,source:struct<stored_id:string,name:string,remote_id:string>>>"
)


@dataclass
class Landed:
    """rows of the schema, and quarantine (file, reason, line)."""

    rows: DataFrame
    quarantine: DataFrame


def read(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("id",)) -> Landed:
    """JSON lines under ``path``.  Lines that do not parse or have a value of another type are quarantined, and so are those with a blank key."""
    kind = T._parse_datatype_string(schema)
    full = T.StructType([*kind.fields, T.StructField("_line", T.StringType())])
    out = fresh_path(spark, "landed")
    lines = spark.read.schema(full).option("columnNameOfCorruptRecord", "_line").json(path).select("*", F.col("_metadata.file_path").alias("_file"))
    lines.write.parquet(out)
    parsed = spark.read.parquet(out)
    blank = F.lit(False)
    for k in keys:
        blank = blank | (F.coalesce(strip(F.col(k)), F.lit("")) == "")
    reason = F.when(F.col("_line").isNotNull(), "malformed").when(blank, "no id")
    kept = parsed.withColumn("_reason", reason)
    said = F.coalesce("_line", F.to_json(F.struct(*kind.names)))
    return Landed(kept.where("_reason IS NULL").select(*kind.names), kept.where("_reason IS NOT NULL").select(F.col("_file").alias("file"), F.col("_reason").alias("reason"), said.alias("line")))


def _each(rows: DataFrame, key: Column, array: str, **columns: str) -> DataFrame:
    """A row for each entry of ``array``: item_id (or the key's name), pos from 1, and the named parts of the entry; rows without entries have none."""
    out = rows.select(key, F.posexplode_outer(array).alias("_pos", "_x")).where("_x IS NOT NULL")
    return out.select(out.columns[0], (F.col("_pos") + 1).cast("long").alias("pos"), *(F.expr(e).alias(c) for c, e in columns.items()))


def item_tables(items: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of landed items, each with the place of a row in its list.

    items (item_id, scalars, source_id, source_name), urls, files, fingerprints (file_pos), labels, contributors, contributor_labels
    (contributor_pos) and external_ids.  An item without any has no row in the others.
    """
    key = F.col("id").alias("item_id")
    people = _each(items, key, "contributors", contributor_id="_x.id", **{c: f"_x.{c}" for c in ("name", "category", "birth_date", "group_text", "country", "metric_a", "metric_b", "text_a", "text_b", "labels")})
    files = _each(items, key, "files", path="_x.path", fingerprints="_x.fingerprints")
    inner = lambda df, outer, array, **cols: df.select("item_id", F.col("pos").alias(outer), F.posexplode_outer(array).alias("_pos", "_x")).where("_x IS NOT NULL").select("item_id", outer, (F.col("_pos") + 1).cast("long").alias("pos"), *(F.expr(e).alias(c) for c, e in cols.items()))
    return {
        "items": items.select(key, "title", F.to_date("date").alias("item_date"), "code", "details", "director", F.col("source.id").alias("source_id"), F.col("source.name").alias("source_name")),
        "urls": _each(items, key, "urls", url="_x"), "files": files.drop("fingerprints"), "fingerprints": inner(files, "file_pos", "fingerprints", type="_x.type", value="_x.value"),
        "labels": _each(items, key, "labels", label_id="_x.id", label_name="_x.name"), "contributors": people.drop("labels"), "contributor_labels": inner(people, "contributor_pos", "labels", label_id="_x.id", label_name="_x.name"),
        "external_ids": _each(items, key, "external_ids", endpoint="_x.endpoint", ext_id="_x.ext_id"),
    }


def contributor_tables(contributors: DataFrame) -> dict[str, DataFrame]:
    """contributors (contributor_id and their attributes) and labels (contributor_id, pos, label_id, label_name) of landed contributors."""
    key = F.col("id").alias("contributor_id")
    return {"contributors": contributors.select(key, *(c for c in contributors.columns if c not in ("id", "labels"))), "labels": _each(contributors, key, "labels", label_id="_x.id", label_name="_x.name")}


def answers(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes: item_id, provider, failure; candidates: item_id, provider, nth, candidate) of landed provider answers.

    A call that failed has no candidates, whatever came with it.
    """
    outcomes = landed.select("item_id", "provider", blank_to_null(F.col("failure")).alias("failure"))
    found = landed.where(blank_to_null(F.col("failure")).isNull()).select("item_id", "provider", F.posexplode_outer("candidates").alias("nth", "candidate")).where("candidate IS NOT NULL")
    return outcomes, found.withColumn("nth", (F.col("nth") + 1).cast("long"))

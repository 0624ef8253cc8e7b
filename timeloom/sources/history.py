"""The library's history as versioned JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "id string, uri string, lastOpened long, displayName string, sourceKey string, streamIndex int"


def read_history(documents: DataFrame) -> DataFrame:
    """Records of JSON texts in ``value``: version 1 is a bare list, version 2 an
    object with ``items``.  Each item is decoded alone; one that is broken or has
    no id or time is kept as not valid."""
    v = F.col("value")
    items = F.when(F.ltrim(v).startswith("["), v).otherwise(F.get_json_object(v, "$.items"))
    each = F.explode(F.from_json(items, "array<string>"))
    rec = documents.select(each.alias("raw")).withColumn("r", F.from_json("raw", ITEM, {"mode": "PERMISSIVE"}))
    good = F.coalesce(F.col("r.id").isNotNull() & F.col("r.lastOpened").isNotNull(), F.lit(False))
    return rec.select("r.*", good.alias("valid"))


def write_history(records: DataFrame, version: int = 2) -> DataFrame:
    """One JSON text of all records; meant for the bounded list of a library."""
    items = F.sort_array(F.collect_list(F.struct(F.col("lastOpened"), F.to_json(F.struct(*[c for c in records.columns if c != "valid"])).alias("j"))), asc=False)
    lines = F.transform(items, lambda x: x.j)
    return records.agg(F.concat(F.lit(f'{{"version":{version},"items":['), F.array_join(lines, ","), F.lit("]}")).alias("value"))

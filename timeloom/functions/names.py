"""Keys, envelopes and error codes as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINDING = r"^t([0-9]+):s([01]):((?s:.*))$"


def binding_key(generation: Column, seek_safe: Column, key: Column) -> Column:
    return F.concat(F.lit("t"), generation, F.lit(":s"), F.when(seek_safe, "1").otherwise("0"), F.lit(":"), key)


def binding(stored: Column) -> tuple[Column, Column, Column]:
    """Generation, seek safety and key; an old key without a prefix is of the
    first generation and ambiguous."""
    new = stored.rlike(_BINDING)
    part = lambda k: F.regexp_extract(stored, _BINDING, k)
    return F.when(new, part(1)).otherwise("1").cast("long"), new & (part(2) == "1"), F.when(new, part(3)).otherwise(stored)


def envelope(ok: Column, data: Column, code: Column) -> Column:
    """{"status":"ok","data":...} or {"status":"error","code":...}"""
    return F.to_json(F.struct(F.when(ok, "ok").otherwise("error").alias("status"), F.when(ok, data).alias("data"), F.when(~ok, code).alias("code")))


def error_code(message: Column) -> Column:
    """A stable code for a message chain."""
    m = F.lower(message)
    return (
        F.when(m.rlike("no space left|enospc|quota exceeded|disk full|storage full"), "storage_full").when(m.rlike("cancel"), "cancelled")
        .when(m.rlike("permission|denied"), "permission_denied").when(m.rlike("not found|no such file"), "not_found").otherwise("internal")
    )

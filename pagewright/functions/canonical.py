"""Canonical JSON text and the keys hashed from it.

The text is what Python's ``json.dumps(obj, sort_keys=True)`` writes: keys in order, ``", "`` and
``": "`` between parts, everything outside printable ASCII as ``\\uXXXX``. A store filled by another
program with the same rule is therefore found again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: short escapes of JSON text by the escape they stand for
SHORT_ESCAPES = {r"\u0008": r"\b", r"\u0009": r"\t", r"\u000a": r"\n", r"\u000c": r"\f", r"\u000d": r"\r"}
# fixed values: request fields that do not shape the answer
IGNORED_FIELDS = ("timeout", "extra_headers")


def json_string(text: Column) -> Column:
    """``text`` as a quoted JSON string in plain ASCII.

    The text is cut into runs of printable ASCII and runs of the rest, so each character is looked at a fixed number of times.
    """
    plain = ~text.rlike(r'[^ !#-\[\]-~]')

    def printable(run: Column) -> Column:
        return F.replace(F.replace(run, F.lit("\\"), F.lit(r"\\")), F.lit('"'), F.lit(r"\""))

    def escaped(run: Column) -> Column:
        out = F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(.{4})", r"\\u$1")
        for long, short in SHORT_ESCAPES.items():
            out = F.replace(out, F.lit(long), F.lit(short))
        return out

    runs = F.regexp_extract_all(text, F.lit("[ -~]+|[^ -~]+"), F.lit(0))
    joined = F.array_join(F.transform(runs, lambda run: F.when(run.rlike("^[ -~]"), printable(run)).otherwise(escaped(run))), "")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(joined), F.lit('"'))


def json_object(fields: dict[str, Column]) -> Column:
    """An object of fragments that are JSON text already, keys in order."""
    parts = [F.concat(F.lit(f'"{k}": '), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def json_array(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *items), F.lit("]"))


def request_key(payload: Column) -> Column:
    """SHA-256 of a request held as ``map<field name, JSON fragment>``."""
    shaping = F.map_filter(payload, lambda k, _: ~k.isin(*IGNORED_FIELDS))
    parts = F.transform(
        F.array_sort(F.map_entries(shaping)), lambda e: F.concat(json_string(e["key"]), F.lit(": "), e["value"])
    )
    return F.sha2(F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}")), 256)


def bytes_key(data: Column, *extra: Column) -> Column:
    """SHA-256 of raw bytes followed by the text of each extra setting."""
    return F.sha2(F.concat(data, *[F.encode(e, "UTF-8") for e in extra]), 256)

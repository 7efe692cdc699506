"""Placeholder rules and template filling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billrate.functions.text import jtrim, let

EMPTY_MAP = "map<string,string>"


def _last_wins(entries: Column) -> Column:
    return F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))),
        lambda later: later["key"] == e["key"],
    ))


def parse_replacements(c: Column) -> Column:
    """Map of ``${name}`` to value from lines of ``${name}=value``.

    Lines without ``=``, keys of another form and empty values are dropped; a
    later line wins over an earlier one with the same key.
    """
    lines = F.filter(F.split(c, "\n"), lambda s: F.contains(s, F.lit("=")))
    entries = F.transform(lines, lambda s: F.struct(
        jtrim(F.substring_index(s, "=", 1)).alias("key"),
        jtrim(F.substring(s, F.instr(s, "=") + 1, F.length(s))).alias("value"),
    ))
    entries = F.filter(
        entries,
        lambda e: F.startswith(e["key"], F.lit("${")) & F.endswith(e["key"], F.lit("}"))
        & (e["value"] != ""),
    )

    kept = F.map_from_entries(let(entries, _last_wins))
    return F.coalesce(kept, F.create_map().cast(EMPTY_MAP))


def render_template(text: Column, replacements: Column) -> Column:
    """Replace every key in key order, one after another; keys without a value stay."""
    return F.aggregate(
        F.sort_array(F.map_entries(F.map_filter(replacements, lambda k, v: v.isNotNull()))), text,
        lambda acc, e: F.replace(acc, e["key"], e["value"]),
    )


def replacements_from_json(c: Column) -> Column:
    """Stored ``{name: value}`` JSON as a map of ``${name}`` to value.

    Of names that are equal after trimming the last one wins.
    """
    pairs = F.map_filter(
        F.from_json(c, EMPTY_MAP),
        lambda k, v: (jtrim(k) != "") & (F.coalesce(jtrim(v), F.lit("")) != ""),
    )
    keyed = F.transform(F.map_entries(pairs), lambda e: F.struct(
        F.concat(F.lit("${"), jtrim(e["key"]), F.lit("}")).alias("key"), jtrim(e["value"]).alias("value"),
    ))
    return F.coalesce(F.map_from_entries(let(keyed, _last_wins)), F.create_map().cast(EMPTY_MAP))

"""Catalogue, bill and version maintenance as batch change-sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billrate.functions.money import line_total
from billrate.functions.text import is_blank
from billrate.operators.ranking import latest_override
from billrate.schemas import ITEM_FIELDS, QUOTA_FIELDS, VERSION_FIELDS, conform
from billrate.session import stage

PATCHABLE = ("item_code", "item_name", "feature_value", "unit", "quantity", "remark")
QUOTA_EDITS = (
    "quota_code", "quota_name", "feature_value", "unit", "unit_price", "labor_cost",
    "material_cost", "machine_cost", "remark",
)
# Before the first change of any batch.
_START = -(2**63)


def _drop_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    gone = ids.select(F.col("id").alias(column)).distinct()
    return df.join(gone, column, "left_anti").select(*df.columns)


def insert_items(items: DataFrame, new: DataFrame, user_id: int) -> DataFrame:
    """Append new items: unmatched, without match columns or remark."""
    none = F.lit(None)
    blank = {c: none for c in ITEM_FIELDS if c.startswith("matched_")}
    rows = conform(
        new, ITEM_FIELDS, user_id=F.lit(user_id), match_status=F.lit(0),
        total_price=none, remark=none, **blank,
    )
    return items.unionByName(rows)


def patch_items(items: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Partial updates: returns (items, rejects).

    ``patches`` has (item_id, user_id, edit_seq) and for each field it may
    change a value and a flag ``set_<field>``.  Only the owner may patch; a
    blank new name spoils the patch.
    """
    fields = [f for f in PATCHABLE if f"set_{f}" in patches.columns]
    owned = items.select(F.col("id").alias("item_id"), "user_id")
    ok = patches.join(owned, ["item_id", "user_id"], "left_semi")
    if "item_name" in fields:
        ok = ok.filter(~(F.col("set_item_name") & is_blank(F.col("item_name"))))
    rejects = patches.join(ok.select("edit_seq"), "edit_seq", "left_anti")

    def last(f: str):
        given = F.col(f"set_{f}")
        given = given & F.col(f).isNotNull() if f == "quantity" else given
        return F.max_by(
            F.struct(F.col(f).alias("v")), F.when(given, F.col("edit_seq"))
        ).alias(f"new_{f}")

    edits = ok.groupBy("item_id").agg(*[last(f) for f in fields])
    joined = items.join(edits, items["id"] == edits["item_id"], "left")
    value = {
        f: F.when(F.col(f"new_{f}").isNotNull(), F.col(f"new_{f}.v")).otherwise(items[f])
        for f in fields
    }
    quantity = value.get("quantity", items["quantity"])
    value["total_price"] = F.when(
        F.col("item_id").isNotNull(),
        F.coalesce(line_total(quantity, items["matched_unit_price"]), items["total_price"]),
    ).otherwise(items["total_price"])
    out = joined.select(*[
        value.get(c, items[c]).cast(ITEM_FIELDS[c]).alias(c) for c in items.columns
    ])
    return out, rejects


def upsert_quotas(quotas: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert or replace catalogue rows: returns (quotas, rejects).

    ``changes`` has an ``op`` of insert or update and an ``edit_seq``; an
    update replaces the nine price and text fields and keeps the version.
    """
    inserts = changes.filter(F.col("op") == "insert")
    updates = changes.filter(F.col("op") == "update")
    known = updates.join(quotas.select("id"), "id", "left_semi")
    rejects = updates.join(known.select("edit_seq"), "edit_seq", "left_anti")
    last = latest_override(known.select("id", "edit_seq", *QUOTA_EDITS), "id").select(
        F.col("id").alias("cid"), "edit_seq",
        *[F.col(f).alias(f"new_{f}") for f in QUOTA_EDITS],
    )
    joined = quotas.join(last, quotas["id"] == last["cid"], "left")
    changed = F.col("cid").isNotNull()
    updated = joined.select(*[
        F.when(changed, F.col(f"new_{c}")).otherwise(quotas[c])
        .cast(QUOTA_FIELDS[c]).alias(c) if c in QUOTA_EDITS else quotas[c]
        for c in quotas.columns
    ])
    return updated.unionByName(conform(inserts, QUOTA_FIELDS)), rejects


def delete_quotas(quotas: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop catalogue rows; bill items are left as they are."""
    return _drop_ids(quotas, ids)


def _accepted_names(versions: DataFrame, claims: DataFrame) -> DataFrame:
    """Who bears which name since when: (id, version_name, since).

    Rows of ``versions`` bear theirs from the start.  A claim is judged once no
    earlier open claim can change its outcome, so each round settles all claims
    that do not wait for each other; the earliest open one never waits.
    """
    names = stage(
        versions.select("id", "version_name", F.lit(_START).alias("since")), "version-names"
    )
    claims = stage(claims.select("op", "id", "version_name", "edit_seq"), "version-claims")
    while not claims.isEmpty():
        until = F.lead("since").over(Window.partitionBy("id").orderBy("since"))
        edits = claims.groupBy("id").agg(
            F.min("edit_seq").alias("first_edit"),
            F.min(F.when(F.col("op") == "insert", F.col("edit_seq"))).alias("first_insert"),
        )
        spans = names.withColumn("until", until).join(edits, "id", "left").select(
            F.col("id").alias("bearer"), F.col("version_name").alias("borne"), "since", "until",
            F.col("first_edit").alias("bearer_edit"),
        )
        at = F.col("edit_seq")
        borne = (
            (F.col("version_name") == F.col("borne")) & (F.col("since") < at)
            & (F.col("until").isNull() | (F.col("until") > at))
        )
        first = claims.groupBy("version_name").agg(F.min("edit_seq").alias("first_claim"))
        born = names.groupBy("id").agg(F.min("since").alias("born"))
        no = F.lit(False)
        insert = F.col("op") == "insert"
        exists = insert | F.coalesce(F.col("born") < at, no)
        may_exist = exists | F.coalesce(F.col("first_insert") < at, no)
        taken = F.col("bearer").isNotNull() & (insert | (F.col("bearer") != F.col("id")))
        may_leave = F.coalesce(F.col("bearer_edit") < at, no)
        verdict = F.when(~may_exist | (taken & ~may_leave), False).when(
            exists & ~taken & (at == F.col("first_claim")), True
        )
        judged = stage(
            claims.join(spans, borne, "left").join(first, "version_name")
            .join(born, "id", "left").join(edits.drop("first_edit"), "id", "left")
            .select(*claims.columns, verdict.alias("accepted")),
            "version-verdicts",
        )
        names = stage(
            names.unionByName(judged.filter("accepted").select(
                "id", "version_name", at.alias("since")
            )),
            "version-names",
        )
        claims = judged.filter("accepted is null").drop("accepted")
    return names


def upsert_versions(
    versions: DataFrame, changes: DataFrame, now: str
) -> tuple[DataFrame, DataFrame]:
    """Create or rename versions: returns (versions, rejects).

    ``changes`` has (op, id, version_name, description, edit_seq) and counts as
    applied one after the other by ``edit_seq`` (unique; without one a change is
    rejected).  An insert brings a new id and needs a name; an update needs an
    id that exists by then.  The name must not be borne by another version at
    that moment: refused changes claim nothing, and a rename sets the old name
    free.
    """
    stamp = F.lit(now).cast("timestamp")
    named = F.coalesce(~is_blank(F.col("version_name")), F.lit(False))
    insert = F.col("op") == "insert"
    names = _accepted_names(versions, changes.filter(named & F.col("edit_seq").isNotNull()))
    claimed = names.select("id", F.col("since").alias("edit_seq"))
    born = names.groupBy("id").agg(F.min("since").alias("born"))
    accepted = changes.filter(named).join(claimed, ["id", "edit_seq"], "left_semi").unionByName(
        changes.filter(~named & ~insert).join(born, "id")
        .filter(F.col("born") < F.col("edit_seq")).select(*changes.columns)
    )
    rejects = changes.join(accepted.select("edit_seq"), "edit_seq", "left_anti")
    edits = (
        accepted.filter(~insert).groupBy(F.col("id").alias("cid")).agg(
            F.max_by("version_name", F.when(named, F.col("edit_seq"))).alias("new_name"),
            F.max_by(
                "description", F.when(F.col("description").isNotNull(), F.col("edit_seq"))
            ).alias("new_description"),
        )
    )
    created = conform(
        accepted.filter(insert), VERSION_FIELDS, create_time=stamp, update_time=stamp
    )
    rows = versions.unionByName(created)
    updated = rows.join(edits, rows["id"] == edits["cid"], "left").select(
        "id", F.coalesce("new_name", "version_name").alias("version_name"),
        F.coalesce("new_description", "description").alias("description"), "create_time",
        F.when(F.col("cid").isNotNull(), stamp).otherwise(F.col("update_time"))
        .alias("update_time"),
    )
    return updated, rejects


def delete_versions(
    versions: DataFrame, quotas: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop versions with their quotas: (versions, quotas, deleted count)."""
    gone = ids.select(F.col("id").alias("version_id")).distinct()
    deleted = quotas.join(gone, "version_id", "left_semi").agg(
        F.count(F.lit(1)).alias("deleted_quotas")
    )
    return _drop_ids(versions, ids), _drop_ids(quotas, ids, "version_id"), deleted


def delete_items(
    items: DataFrame, item_quotas: DataFrame, ids: DataFrame, user_id: int
) -> tuple[DataFrame, DataFrame]:
    """Drop a user's own items and their links."""
    own = items.filter(F.col("user_id") == user_id).join(
        ids.select("id").distinct(), "id", "left_semi"
    ).select("id")
    return _drop_ids(items, own), _drop_ids(item_quotas, own, "project_item_id")


def clear_items(items: DataFrame, item_quotas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Empty the bill and its links; the catalogue stays."""
    return items.limit(0), item_quotas.limit(0)


def mark_added(hits: DataFrame, item_quotas: DataFrame, item_id: int) -> DataFrame:
    """Flag search hits the item already holds."""
    held = (
        item_quotas.filter(F.col("project_item_id") == item_id)
        .select(F.col("quota_id").alias("id")).distinct().withColumn("_held", F.lit(True))
    )
    return hits.join(held, "id", "left").select(
        *hits.columns, F.coalesce(F.col("_held"), F.lit(False)).alias("already_added")
    )


def save_replacement_sets(sets: DataFrame, new: DataFrame) -> DataFrame:
    return sets.unionByName(new.select(*sets.columns))


def delete_replacement_sets(sets: DataFrame, ids: DataFrame) -> DataFrame:
    return _drop_ids(sets, ids)

"""Old table + change set -> new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from covenantry.functions.keys import last_per_key, order_of
from covenantry.schema import EDITABLE_OBLIGATION_FIELDS, EDITABLE_RISK_FIELDS


def apply_reviews(
    items: DataFrame, reviews: DataFrame, key: str,
    editable: tuple[str, ...] = EDITABLE_OBLIGATION_FIELDS,
) -> DataFrame:
    """All reviews in the order of their decisions, folded into one aggregate per item.

    ``reviews``: key, review_id, decision, reviewer_id, reviewer_confidence,
    field_edits map<string,string>, decided_at.  The last decision sets the status, the
    last given confidence and the last edit of each whitelisted field win.
    """
    order = F.struct("decided_at", "review_id")
    edits = F.when(F.col("decision") == "edit_approve", F.col("field_edits"))
    fields = [f for f in editable if f in items.columns]
    latest = reviews.groupBy(key).agg(
        F.max_by("decision", order).alias("_decision"),
        F.max_by("reviewer_confidence", F.when(F.col("reviewer_confidence").isNotNull(), order))
        .alias("_confidence"),
        *(
            F.max_by(F.struct(F.try_element_at(edits, F.lit(f)).alias("v")),
                     F.when(F.map_contains_key(edits, f), order)).alias("_" + f)
            for f in fields
        ),
    )
    df = items.join(latest, key, "left")
    status = (
        F.when(F.col("_decision").isin("approve", "edit_approve"), "confirmed")
        .when(F.col("_decision").isNotNull(), "rejected").otherwise(F.col("status"))
    )
    new = {"status": status}
    if "reviewer_confidence" in items.columns:
        new["reviewer_confidence"] = F.coalesce("_confidence", "reviewer_confidence")
    else:
        new["reviewer_confidence"] = F.col("_confidence")
    for f in fields:
        kind = items.schema[f].dataType
        new[f] = F.when(F.col("_" + f).isNotNull(), F.col(f"_{f}.v").cast(kind)).otherwise(F.col(f))
    return df.withColumns(new).drop("_decision", "_confidence", *("_" + f for f in fields))


def apply_risk_reviews(risks: DataFrame, reviews: DataFrame) -> DataFrame:
    return apply_reviews(risks, reviews, "risk_id", EDITABLE_RISK_FIELDS)


def review_audit(reviews: DataFrame, key: str, table: str) -> DataFrame:
    """One audit row per review."""
    status = F.when(F.col("decision") == "reject", "rejected").otherwise("confirmed")
    return reviews.select(
        F.lit(table).alias("table_name"), F.col(key).alias("record_id"),
        F.lit("update").alias("action"), F.lit(None).cast("string").alias("old_values"),
        F.to_json(F.struct(
            status.alias("status"), F.col("decision").alias("review_decision"),
            F.col("reviewer_id").cast("string").alias("reviewer_id"))).alias("new_values"),
        F.col("reviewer_id").alias("performed_by"), F.col("decided_at").alias("performed_at"),
    )


def audit_rows(
    changes: DataFrame, table: str, key: str, action: str, *, old: list[str] | None = None,
    new: list[str] | None = None,
) -> DataFrame:
    """Audit rows of a change set: the named columns as JSON objects."""
    def packed(names):
        return F.to_json(F.struct(*names)) if names else F.lit(None).cast("string")

    return changes.select(
        F.lit(table).alias("table_name"), F.col(key).alias("record_id"),
        F.lit(action).alias("action"), packed(old).alias("old_values"),
        packed(new).alias("new_values"),
    )


def resolve_merges(merges: DataFrame) -> DataFrame:
    """source_id -> final target_id, following chains by pointer doubling.

    ``merges``: source_id, target_id.  A self-merge is an error.  Each round doubles the
    distance covered and its result is written, so n merges settle within log2(n) + 1
    rounds; what has not settled by then runs in a circle and is an error too.
    """
    from covenantry.session import written

    if merges.filter(F.col("source_id") == F.col("target_id")).limit(1).count():
        raise ValueError("source and target entity must differ")
    hops = written(merges.select("source_id", "target_id").distinct())
    for _ in range(hops.count().bit_length() + 1):
        onward = hops.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("_next"))
        moved = hops.join(onward, "target_id", "left").select(
            "source_id", F.coalesce("_next", "target_id").alias("target_id"),
            F.col("_next").isNotNull().alias("_moved"))
        moved = written(moved)
        hops = moved.drop("_moved")
        if not moved.filter("_moved").limit(1).count():
            return hops
    raise ValueError("entity merges form a cycle")


def merge_entities(
    entities: DataFrame, mentions: DataFrame, merges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(entities, mentions) after merges; ``merges`` maps source_id to its final target_id."""
    final = merges.select(F.col("source_id").alias("entity_id"), "target_id")
    moved = entities.join(final, "entity_id").select(
        F.col("target_id").alias("entity_id"),
        F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
        .alias("names"))
    gained = moved.select("entity_id", F.explode("names").alias("n")).groupBy("entity_id").agg(
        F.collect_set("n").alias("gained"))
    left = entities.join(final, "entity_id", "left_anti").join(gained, "entity_id", "left")
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    entities_out = left.withColumn(
        "aliases",
        F.when(F.col("gained").isNull(), F.col("aliases")).otherwise(F.array_sort(
            F.array_union(F.array_union(aliases, F.array("canonical_name")), "gained"))),
    ).drop("gained")

    def repoint(df: DataFrame, column: str) -> DataFrame:
        to = merges.select(F.col("source_id").alias(column), F.col("target_id").alias("_to"))
        return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).select(*df.columns)

    return entities_out, repoint(repoint(mentions, "entity_id"), "suggested_entity_id")


def resolve_mentions(mentions: DataFrame, decisions: DataFrame, entities: DataFrame) -> DataFrame:
    """``decisions``: mention_id, entity_id, resolved_by; unknown entities are ignored, the last decision counts."""
    valid = last_per_key(decisions.join(entities.select("entity_id"), "entity_id", "left_semi"), "mention_id").select(
        "mention_id", F.col("entity_id").alias("_entity"), F.col("resolved_by").alias("_by"))
    hit = F.col("_entity").isNotNull()
    df = mentions.join(valid, "mention_id", "left")
    return df.withColumns({
        "entity_id": F.coalesce("_entity", "entity_id"),
        "resolved": F.col("resolved") | hit,
        "resolved_by": F.coalesce("_by", "resolved_by"),
    }).drop("_entity", "_by")


# Tables that go with a document, and the key they hang on.
CHILD_KEYS = {
    "text_spans": "document_id", "chunks": "document_id", "document_pages": "document_id",
    "entity_mentions": "document_id", "extraction_runs": "document_id",
    "obligations": "document_id", "risks": "document_id",
    "obligation_evidence": "obligation_id", "obligation_reviews": "obligation_id",
    "risk_evidence": "risk_id", "risk_reviews": "risk_id",
    "user_asset_assignments": "asset_id",
}


def cascade_delete(tables: dict[str, DataFrame], documents_gone: DataFrame) -> dict[str, DataFrame]:
    """Remove documents and everything below them: one anti join per table."""
    gone = {"document_id": documents_gone.select("document_id")}
    for table, key in (("obligations", "obligation_id"), ("risks", "risk_id")):
        if table in tables:
            gone[key] = tables[table].join(gone["document_id"], "document_id", "left_semi").select(key)
    out = {}
    for name, df in tables.items():
        if name == "documents":
            out[name] = df.join(gone["document_id"], "document_id", "left_anti")
        elif name == "obligation_contradictions":
            for column in ("a_id", "b_id"):
                df = df.join(gone["obligation_id"].withColumnRenamed("obligation_id", column), column, "left_anti")
            if "risk_id" in df.columns and "risk_id" in gone:
                df = df.join(gone["risk_id"], "risk_id", "left_anti")
            out[name] = df
        elif CHILD_KEYS.get(name) in gone:
            out[name] = df.join(gone[CHILD_KEYS[name]], CHILD_KEYS[name], "left_anti")
        else:
            out[name] = df
    return out


def delete_assets(tables: dict[str, DataFrame], assets_gone: DataFrame) -> dict[str, DataFrame]:
    keys = assets_gone.select("asset_id")
    out = cascade_delete(tables, tables["documents"].join(keys, "asset_id", "left_semi"))
    for name in ("assets", "user_asset_assignments"):
        if name in out:
            out[name] = out[name].join(keys, "asset_id", "left_anti")
    return out


RERUN_TABLES = ("obligations", "risks", "obligation_evidence", "risk_evidence", "entity_mentions",
                "extraction_runs", "obligation_contradictions")


def clear_extractions(tables: dict[str, DataFrame], documents: DataFrame) -> dict[str, DataFrame]:
    """Drop what extraction made for the given documents; the documents stay."""
    chosen = {n: tables[n] for n in RERUN_TABLES if n in tables}
    return {**tables, **cascade_delete(chosen, documents)}


def mark_read(notifications: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests``: notification_id, user_id, read_at; another user's rows are untouched."""
    seen = requests.groupBy("notification_id", "user_id").agg(F.max("read_at").alias("_at"))
    df = notifications.join(seen, ["notification_id", "user_id"], "left")
    hit = F.col("_at").isNotNull()
    return df.withColumns({
        "status": F.when(hit, "read").otherwise(F.col("status")),
        "read_at": F.coalesce("_at", "read_at"),
    }).drop("_at")


def assign_assets(assignments: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assignments, newly added); asking twice adds one row."""
    key = ["user_id", "asset_id"]
    added = requests.select(*key).distinct().join(assignments.select(*key), key, "left_anti")
    return assignments.select(*key).unionByName(added), added


def remove_assets(assignments: DataFrame, requests: DataFrame) -> DataFrame:
    key = ["user_id", "asset_id"]
    return assignments.join(requests.select(*key), key, "left_anti")


def advance_status(documents: DataFrame, to: str) -> DataFrame:
    status = F.col("parse_status")
    if to != "failed":
        return documents.withColumn("parse_status", F.when(status == "failed", status).otherwise(to))
    return documents.withColumn("parse_status", F.lit("failed"))


def update_users(users: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: user_id, role, digest_enabled, digest_timezone; NULL means not given.

    Of several changes of one user each column takes the last that is given.  An unknown time zone is
    refused as if it were not given (see :func:`refused_timezones`); the rest of its change counts.
    """
    names = [c for c in ("role", "digest_enabled", "digest_timezone") if c in changes.columns]
    if "digest_timezone" in names:
        changes = changes.withColumn("digest_timezone", F.when(_known_timezone(), F.col("digest_timezone")))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order_of(changes, [c]))).alias("_" + c) for c in names]
    given = changes.groupBy("user_id").agg(*last) if last else changes.select("user_id").distinct()
    df = users.join(given, "user_id", "left")
    new = {c: F.coalesce("_" + c, c) if c in users.columns else F.col("_" + c) for c in names}
    return df.withColumns(new).drop(*("_" + c for c in names))


def _known_timezone() -> Column:
    from zoneinfo import available_timezones

    return F.col("digest_timezone").isin(*sorted(available_timezones()))


def refused_timezones(changes: DataFrame) -> DataFrame:
    """Changes that give a time zone which is not known."""
    return changes.filter(F.col("digest_timezone").isNotNull() & ~_known_timezone())


def role_audit(users: DataFrame, changes: DataFrame) -> DataFrame:
    """An audit row for every change of a known user that gives a role; the old value is not kept."""
    given = changes.filter(F.col("role").isNotNull()).join(users.select("user_id"), "user_id", "left_semi")
    rest = [c for c in ("performed_by", "performed_at") if c in changes.columns]
    return given.select(
        F.lit("users").alias("table_name"), F.col("user_id").alias("record_id"), F.lit("update").alias("action"),
        F.lit(None).cast("string").alias("old_values"), F.to_json(F.struct("role")).alias("new_values"), *rest)

"""Snapshots and change logs: upserts, votes, logged changes, rollback, compaction.

Parquet has no update in place. Every operator takes the current snapshot and
returns the new one; nothing is changed where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirwise.functions.payloads import own_values, template_form, template_hash
from dirwise.functions.sets import pair_key
from dirwise.functions.values import or_null, text
from dirwise.operators.ranking import latest


def one_per_key(delta: DataFrame, key: str, order: list[str] | None, first: bool = False) -> DataFrame:
    """The last row per key by ``order`` (the first, if asked for). Rows that agree in it, or without an order, go by their values."""
    rest = [c for c in delta.columns if c != key]
    if not rest:
        return delta.distinct()
    rank = F.struct(*(order or []), *[c for c in rest if c not in (order or [])])
    pick = F.min_by if first else F.max_by
    return delta.groupBy(key).agg(pick(F.struct(*rest), rank).alias("_r")).select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in delta.columns])


def upsert(base: DataFrame, delta: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """Whole rows of ``delta`` replace or join those of ``base``; of rows with one key the last by ``order`` counts."""
    last = one_per_key(delta, key, order)
    return base.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def insert_new(base: DataFrame, delta: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """Only rows with a key that is not there yet are added; the first per key by ``order``."""
    fresh = one_per_key(delta, key, order, first=True).join(base.select(key), key, "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def patch(base: DataFrame, delta: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """Named columns of the rows whose key ``delta`` holds are set, to null as well; other keys are ignored.

    Of several rows with one key the last by ``order`` counts; columns named only in ``order`` are not set.
    """
    delta = one_per_key(delta, key, order)
    cols = [c for c in delta.columns if c != key and c in base.columns]
    d = delta.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    out = base.join(d, key, "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns])


def patch_many(base: DataFrame, keys: DataFrame, values: dict[str, Column], key: str = "id") -> DataFrame:
    """One patch for all listed keys."""
    hit = keys.select(F.col(keys.columns[0]).alias(key)).distinct().withColumn("_hit", F.lit(True))
    out = base.join(hit, key, "left")
    return out.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns])


def delete(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return base.join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_anti")


def update_where(base: DataFrame, cond: Column, values: dict[str, Column]) -> DataFrame:
    return base.withColumns({c: F.when(cond, v).otherwise(F.col(c)) for c, v in values.items()})


def confidence_floor(base: DataFrame, floor: int = 90, value: int = 95) -> DataFrame:
    """Automatically verified rows below the floor are lifted."""
    low = (F.col("verification_status") == "auto_verified") & (F.coalesce("confidence_score", F.lit(0)) < floor)
    return update_where(base, F.coalesce(low, F.lit(False)), {"confidence_score": F.lit(value)})


def upsert_by_key(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Natural-key upsert: the last delta row per key replaces the stored one."""
    last = latest(delta, keys, order)
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def current_votes(votes: DataFrame, order: list[str]) -> DataFrame:
    """The last vote per user, entity and field as +1 or -1; a last vote of 0 withdraws it."""
    last = latest(votes, ["userId", "schoolId", "fieldName"], order)
    return last.filter("vote <> 0").withColumn("vote", F.when(F.col("vote") > 0, 1).otherwise(-1))


def rekey(rows: DataFrame, mapping: DataFrame, keys: list[str], key: str = "schoolId", order: str | None = None) -> DataFrame:
    """References re-pointed from ``old`` to ``new`` ids; where the target holds the key already, its row stays.

    mapping: (old, new). Of several moved rows that meet on one key the first
    by ``order`` is kept.
    """
    m = mapping.select(F.col("old").alias(key), F.col("new").alias("_new"))
    moved = rows.join(m, key, "left").withColumn("_moved", F.col("_new").isNotNull()).withColumn(key, F.coalesce("_new", key))
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct("_moved", F.col(order) if order else F.lit(0))
    best = moved.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in rows.columns])


def remap_arrays(rows: DataFrame, mapping: DataFrame, row_key: str, arrays: list[str]) -> DataFrame:
    """Ids inside array columns replaced by the mapping, order and repeats kept."""
    out = rows
    m = mapping.select(F.col("old").alias("_id"), F.col("new").alias("_new"))
    for c in arrays:
        items = rows.select(row_key, F.posexplode(c).alias("_pos", "_id")).join(m, "_id", "left")
        back = items.groupBy(row_key).agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_new", "_id").alias("v")))).alias("_l"))
        out = out.join(back, row_key, "left").withColumn(c, F.when(F.col("_l").isNull(), F.col(c)).otherwise(F.transform("_l", lambda s: s["v"]))).drop("_l")
    return out


# ---- change log --------------------------------------------------------------------------------


def log_changes(before: DataFrame, after: DataFrame, action: str, batch: str, by: str, as_of: Column, key: str = "id") -> DataFrame:
    """One log row per changed entity with both states as JSON."""
    b = before.select(key, F.to_json(F.struct("*")).alias("previousState"))
    a = after.select(key, F.to_json(F.struct("*")).alias("newState"))
    both = b.join(a, key, "full").filter(~F.col("previousState").eqNullSafe(F.col("newState")))
    return both.select(
        F.lit(action).alias("actionType"), F.lit(batch).alias("batchId"), F.col(key).alias("schoolId"), "previousState",
        F.coalesce("newState", F.lit("")).alias("newState"), F.lit(by).alias("appliedBy"), as_of.alias("appliedAt"),
        F.lit(None).cast("timestamp_ntz").alias("rolledBackAt"))


def restore_states(log: DataFrame, batches: list[str]) -> DataFrame:
    """(schoolId, id, previousState): the state of each entity before the first open change of the batches.

    Where a batch touched an entity twice, the earliest logged state is the
    one before the batch.
    """
    open_rows = log.filter(F.col("batchId").isin(batches) & F.col("rolledBackAt").isNull())
    return open_rows.groupBy("schoolId").agg(F.min("id").alias("id"), F.min_by("previousState", "id").alias("previousState"))


def roll_back(base: DataFrame, log: DataFrame, batches: list[str], as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(snapshot, log) after undoing all open changes of the batches.

    Columns the logged state does not hold keep their value.
    """
    schema = base.drop("id").schema
    s = restore_states(log, batches).select(F.col("schoolId").alias("id"), F.from_json("previousState", schema).alias("_s"),
                                            F.json_object_keys("previousState").alias("_k"))
    out = base.join(s, "id", "left")
    held = lambda c: F.coalesce(F.array_contains("_k", c), F.lit(False))
    snapshot = out.select(*[F.col(c) if c == "id" else F.when(held(c), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in base.columns])
    hit = F.col("batchId").isin(batches) & F.col("rolledBackAt").isNull()
    return snapshot, log.withColumn("rolledBackAt", F.when(hit, as_of).otherwise(F.col("rolledBackAt")))


# What a single-version rollback restores, keeps where the version is silent, or resets to.
RESTORED = ("website", "phone", "email")
KEPT = ("name", "schoolType", "rawSchoolType", "la", "region", "postcode", "address")
RESET = {"gender": "Mixed", "entranceExamType": "Unknown", "verification_status": "unverified"}


def roll_back_version(base: DataFrame, log: DataFrame, log_id: int, entity_id: str, by: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(snapshot, log) after returning one entity to the state logged with one change; the return is logged too."""
    version = log.filter((F.col("id") == log_id) & (F.col("schoolId") == entity_id)).select(F.col("schoolId").alias("id"), F.col("previousState").alias("_p"))
    was = lambda c: or_null(F.get_json_object("_p", f"$.{c}"))
    new = {c: was(c) for c in RESTORED if c in base.columns}
    new |= {c: F.coalesce(was(c), F.col(c)) for c in KEPT if c in base.columns}
    new |= {c: F.coalesce(was(c), F.lit(v)) for c, v in RESET.items() if c in base.columns}
    if "confidence_score" in base.columns:
        new["confidence_score"] = F.coalesce(was("confidence_score").try_cast("int"), F.lit(70))
    joined = base.join(version, "id", "left")
    hit = F.col("_p").isNotNull()
    snapshot = joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).cast(dict(base.dtypes)[c]).alias(c) if c in new else F.col(c) for c in base.columns])
    current = base.filter(F.col("id") == entity_id).select("id", F.to_json(F.struct("*")).alias("_now"))
    entry = version.join(current, "id").select(
        F.lit(None).cast("bigint").alias("id"), F.lit("MANUAL_VERSION_ROLLBACK").alias("actionType"), F.lit(f"rollback_v_{log_id}").alias("batchId"),
        F.col("id").alias("schoolId"), F.col("_now").alias("previousState"), F.col("_p").alias("newState"), F.lit(by).alias("appliedBy"),
        as_of.alias("appliedAt"), F.lit(None).cast("timestamp_ntz").alias("rolledBackAt"))
    stamped = log.withColumn("rolledBackAt", F.when((F.col("id") == log_id) & (F.col("schoolId") == entity_id), as_of).otherwise(F.col("rolledBackAt")))
    return snapshot, stamped.unionByName(entry.select(*log.columns))


def state_map(c: str) -> Column:
    return F.from_json(F.coalesce(or_null(c), F.lit("{}")), "map<string,string>")


def minimal_diff(log: DataFrame) -> DataFrame:
    """The log with newState cut down to the keys that changed; null where nothing did."""
    prev, new = state_map("previousState"), state_map("newState")
    diff = F.map_filter(new, lambda k, v: ~v.eqNullSafe(F.try_element_at(prev, k)))
    same = (F.col("previousState") == F.col("newState")) | (F.size(diff) == 0)
    return log.withColumn("newState", F.when(~same, F.to_json(diff)))


def prune(log: DataFrame, payload: str, drop: list[str], shorten: dict[str, int], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(log whose JSON payload lacks the named keys and has long texts cut to a length, side table (key, payload) of the whole payloads that changed)."""
    m = F.map_filter(state_map(payload), lambda k, _: ~k.isin(*drop)) if drop else state_map(payload)

    def cut(k, v):
        out = v
        for key, n in shorten.items():
            out = F.when((k == key) & (F.length(v) > n), F.concat(F.substring(v, 1, n), F.lit("..."))).otherwise(out)
        return out

    gone = (F.size(F.map_filter(state_map(payload), lambda k, _: k.isin(*drop))) > 0) if drop else F.lit(False)
    long = F.exists(F.map_entries(m), lambda e: F.coalesce(F.length(e["value"]) > F.try_element_at(F.create_map(*[F.lit(x) for kv in shorten.items() for x in kv]), e["key"]), F.lit(False))) if shorten else F.lit(False)
    side = log.filter(F.col(payload).isNotNull() & (gone | long)).select(key, F.col(payload).alias("payload"))
    return log.withColumn(payload, F.when(F.col(payload).isNotNull(), F.to_json(F.transform_values(m, cut)))), side


def template_dictionary(rows: DataFrame, c: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the template's key and their own values instead of the text, one row per template with its form and use count).

    ``restored_texts`` puts both together again.
    """
    keyed = rows.withColumns({"template": template_hash(c), "own": own_values(c), "_form": template_form(c)})
    templates = keyed.groupBy("template").agg(F.min("_form").alias("text"), F.count("*").alias("uses"))
    return keyed.drop(c, "_form"), templates


def restored_texts(keyed: DataFrame, templates: DataFrame, c: str) -> DataFrame:
    """The rows of ``template_dictionary`` with their texts; a blank before a line's value is taken as given."""
    parts = F.split("text", r"(?<=(?:School Name|URN|Postcode|Website):) \{\}(?=\n)", -1)
    filled_in = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: F.concat(F.get("_p", i), F.coalesce(F.get("own", i), F.lit("")))))
    return keyed.join(templates.select("template", parts.alias("_p")), "template").withColumn(c, filled_in).drop("_p", "own", "template")


def relocate(rows: DataFrame, heavy: str, key: str, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with a compact struct in place of a heavy JSON column, side table, one row with the bytes moved)."""
    has = F.col(heavy).isNotNull() & (F.col(heavy) != "")
    side = rows.filter(has).select(key, F.col(heavy).alias("payload"))
    small = F.to_json(F.struct(*[F.get_json_object(heavy, f"$.{k}").alias(k) for k in keep]))
    moved = side.agg(F.count("*").alias("rows_moved"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes_moved"))
    return rows.withColumn(heavy, F.when(has, small).otherwise(F.col(heavy))), side, moved


def rebuild(rows: DataFrame, schema) -> DataFrame:
    """Rows in a target schema: columns in its order and types, missing ones null, others dropped."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema])


# ---- accepted changes --------------------------------------------------------------------------


def commit_changes(base: DataFrame, accepted: DataFrame, as_of: str, order: list[str] | None = None) -> DataFrame:
    """Base rows with accepted proposals (id, schoolType, rawSchoolType, entranceExamType, entranceExamDates) laid over
    them and marked verified; a null proposal keeps the stored value. Of several proposals for a row the last by ``order`` counts."""
    nested = [c for c, t in accepted.dtypes if t.startswith("map")]
    accepted = accepted.withColumns({c: F.array_sort(F.map_entries(c)) for c in nested})
    accepted = one_per_key(accepted, "id", order)
    accepted = accepted.withColumns({c: F.map_from_entries(c) for c in nested})
    fields = [c for c in ("schoolType", "rawSchoolType", "entranceExamType", "entranceExamDates") if c in accepted.columns and c in base.columns]
    a = accepted.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in fields])
    out = base.join(a, "id", "left")
    new = {c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) for c in fields}
    fixed = {"verification_status": F.lit("auto_verified"), "verification_tags": F.array(F.lit("auto_verified")), "confidence_score": F.lit(98),
             "verified_at": F.lit(as_of)}
    for c, v in fixed.items():
        if c in base.columns:
            new[c] = F.when(F.col("_hit"), v).otherwise(F.col(c))
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in base.columns])


def reviews_for(changed: DataFrame, by: str, as_of: Column) -> DataFrame:
    """(schoolId, fieldName, reviewedBy, reviewedAt) for rows with an array ``fields`` of touched fields."""
    return changed.select(F.col("id").alias("schoolId"), F.explode("fields").alias("fieldName"), F.lit(by).alias("reviewedBy"), as_of.alias("reviewedAt"))


def votes_for(changed: DataFrame, user: str, vote: int, as_of: Column) -> DataFrame:
    """System votes on the touched fields of changed rows."""
    return changed.select(
        F.lit(user).alias("userId"), F.col("id").alias("schoolId"), F.explode("fields").alias("fieldName"), F.lit(vote).alias("vote"), as_of.alias("votedAt"))


def promote_reports(base: DataFrame, reports: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """The newest reported value of each listed field becomes the stored one."""
    use = reports.filter((F.col("status") == "down") & F.col("fieldName").isin(fields) & (text("customValue") != ""))
    last = latest(use, ["schoolId", "fieldName"], order)
    wide = last.groupBy(F.col("schoolId").alias("id")).agg(*[F.max(F.when(F.col("fieldName") == f, F.col("customValue"))).alias(f"_n_{f}") for f in fields])
    out = base.join(wide, "id", "left")
    return out.select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


# ---- reviewed pairs ----------------------------------------------------------------------------


def mark_pairs(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pair decisions (school_a_id, school_b_id, decision, reason, reviewed_by, reviewed_at) added to the ledger, newest per pair."""
    d = decisions.withColumn("pair_id", pair_key(F.trim("school_a_id"), F.trim("school_b_id")))
    return upsert_by_key(ledger, d.select(*ledger.columns), ["pair_id"], ["reviewed_at"])


def unmark_pairs(ledger: DataFrame, pair_ids: DataFrame) -> DataFrame:
    return delete(ledger, pair_ids, "pair_id")


def refresh_candidates(stored: DataFrame, entities: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Stored pairs (idA, idB, status ..): reviewed ones dropped, those with a vanished side marked resolved."""
    keyed = stored.withColumn("_pk", pair_key("idA", "idB"))
    left = keyed.join(reviewed.select(F.col(reviewed.columns[0]).alias("_pk")), "_pk", "left_anti")
    ids = entities.select("id").distinct()
    a = ids.select(F.col("id").alias("idA"), F.lit(True).alias("_a"))
    b = ids.select(F.col("id").alias("idB"), F.lit(True).alias("_b"))
    out = left.join(a, "idA", "left").join(b, "idB", "left")
    gone = F.col("_a").isNull() | F.col("_b").isNull()
    return out.withColumn("status", F.when(gone, "resolved").otherwise(F.col("status"))).select(*stored.columns)


def prune_candidates(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Stored pairs that touch none of the merged-away ids."""
    ids = gone.select(F.col(gone.columns[0]).alias("_g")).distinct()
    return stored.join(ids, F.col("idA") == F.col("_g"), "left_anti").join(ids, F.col("idB") == F.col("_g"), "left_anti")

"""Row rules, uniqueness and references, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.fixed_values import INVOICE_STATUSES, SHIPMENT_STATUSES

EMAIL = r"^[A-Za-z0-9._%+'-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*$"


def present(name: str) -> Column:
    return F.col(name).isNotNull()


def not_blank(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.col(name).rlike(r"^\s*$")


def at_most(name: str, length: int) -> Column:
    return F.col(name).isNull() | (F.length(name) <= length)


def positive(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) > 0)


def not_negative(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) >= 0)


def one_of(name: str, values: list[str]) -> Column:
    return F.col(name).isin(values)


def matches(name: str, pattern: str) -> Column:
    return F.col(name).isNull() | F.col(name).rlike(pattern)


def table_rules(table: str) -> dict[str, Column]:
    """Rules a stored row must keep."""
    if table == "shipments":
        return {
            **{f"{c}_present": present(c) for c in (
                "shipment_id", "reference_no", "shipper_id", "shipper_name", "shipper_email",
                "origin_city", "origin_state", "dest_city", "dest_state", "status",
                "created_at")},
            "status_known": one_of("status", SHIPMENT_STATUSES),
            "weight_positive": positive("weight_lbs"),
            "declared_value_not_negative": not_negative("declared_value"),
        }
    if table == "shipment_legs":
        return {
            **{f"{c}_present": present(c) for c in (
                "shipment_id", "sequence", "carrier_id", "origin_city")},
            "status_known": one_of("status", SHIPMENT_STATUSES),
        }
    if table == "invoices":
        return {
            **{f"{c}_present": present(c) for c in (
                "invoice_id", "invoice_number", "carrier_id", "currency", "status")},
            "status_known": one_of("status", INVOICE_STATUSES),
        }
    if table == "invoice_line_items":
        return {f"{c}_present": present(c) for c in ("invoice_id", "description",
                                                     "total_amount")}
    raise ValueError(f"no rules for {table!r}")


def unique_keys(table: str) -> dict[str, list[str]]:
    """Keys that no two stored rows may share."""
    keys = {
        "shipments": {"shipment_id_unique": ["shipment_id"], "reference_no_unique": ["reference_no"]},
        "shipment_legs": {"shipment_sequence_unique": ["shipment_id", "sequence"]},
        "invoices": {"invoice_id_unique": ["invoice_id"],
                     "invoice_number_unique": ["invoice_number"]},
        "invoice_line_items": {"id_unique": ["id"]},
    }
    if table not in keys:
        raise ValueError(f"no keys for {table!r}")
    return keys[table]


def parent_of(table: str) -> tuple[str, str] | None:
    """The table whose rows this table's rows belong to, and the key that says so."""
    return {"shipment_legs": ("shipments", "shipment_id"),
            "invoice_line_items": ("invoices", "invoice_id")}.get(table)


def request_rules(request: str) -> dict[str, Column]:
    """Rules an incoming request must keep."""
    if request == "create_shipment":
        return {
            "shipper_id_not_blank": not_blank("shipper_id"),
            "shipper_name_not_blank": not_blank("shipper_name"),
            "shipper_name_length": at_most("shipper_name", 200),
            "shipper_email_not_blank": not_blank("shipper_email"),
            "shipper_email_valid": matches("shipper_email", EMAIL),
            "origin_city_not_blank": not_blank("origin_city"),
            "origin_city_length": at_most("origin_city", 100),
            "origin_state_not_blank": not_blank("origin_state"),
            "origin_state_length": at_most("origin_state", 50),
            "dest_city_not_blank": not_blank("dest_city"),
            "dest_city_length": at_most("dest_city", 100),
            "dest_state_not_blank": not_blank("dest_state"),
            "dest_state_length": at_most("dest_state", 50),
            "weight_positive": positive("weight_lbs"),
            "declared_value_not_negative": not_negative("declared_value"),
            "gl_code_length": at_most("gl_code", 20),
            "consignee_name_length": at_most("consignee_name", 200),
            "consignee_email_valid": matches("consignee_email", EMAIL),
            "origin_zip_length": at_most("origin_zip", 20),
            "dest_zip_length": at_most("dest_zip", 20),
            "special_instructions_length": at_most("special_instructions", 1000),
        }
    if request == "update_status":
        allowed = [s for s in SHIPMENT_STATUSES if s != "CREATED"]
        return {
            "status_not_blank": not_blank("status"),
            "status_allowed": matches("status", "^(" + "|".join(allowed) + ")$"),
        }
    if request == "receive_invoice":
        lines_ok = F.forall("line_items", lambda line: F.coalesce(
            ~line["description"].rlike(r"^\s*$") & (line["total_amount"] > 0), F.lit(False)))
        return {
            "invoice_number_not_blank": not_blank("invoice_number"),
            "carrier_id_not_blank": not_blank("carrier_id"),
            "invoice_date_present": present("invoice_date"),
            "invoiced_amount_present": present("invoiced_amount"),
            "invoiced_amount_positive": positive("invoiced_amount"),
            "line_items_valid": F.col("line_items").isNull() | lines_ok,
        }
    raise ValueError(f"no rules for {request!r}")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with the names of the rules they break.  A rule that cannot be decided is broken."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return rows.withColumn("violations", F.array_compact(F.array(*broken)))


def violation_counts(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return (
        violations(rows, rules).select(F.explode("violations").alias("rule"))
        .groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))
    )


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent does not exist."""
    return children.join(parents.select(key), key, "left_anti")


def surplus(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows are too many for ``keys`` to be unique; rows with a null key are equal to none."""
    known = rows.dropna(subset=keys)
    return duplicates(known, keys).agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("rows"))


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Every broken rule of stored tables, with the number of rows: row rules, unique keys, and parents
    that are missing (where the parent's table is given).

    A table is read once.  Each row gives the rules that it breaks and, for each check of keys, its key as
    text and the side it is on; one aggregation counts both sides per key, combining before the shuffle,
    and another adds up the keys: all but one of the own rows are too many, children without an own row
    are orphans.
    """
    found = [_findings(name, rows, tables) for name, rows in tables.items()]
    total = found[0]
    for more in found[1:]:
        total = total.unionByName(more)
    per_key = total.groupBy("table", "rule", "key").agg(
        F.sum("own").alias("own"), F.sum("children").alias("children"))
    counted = (F.when(F.col("key").isNull(), F.col("own"))
               .when(F.col("rule").endswith("_exists"),
                     F.when(F.col("own") == 0, F.col("children")).otherwise(0))
               .otherwise(F.col("own") - 1))
    return (
        per_key.groupBy("rule", "table").agg(F.sum(counted).alias("rows"))
        .filter(F.col("rows") > 0).select("rule", "rows", "table")
    )


def _findings(name: str, rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Of one table: (table, rule) with a null key per broken row rule, and with a key per check of keys
    the row takes part in, as itself (``own``) or as the child of another row."""
    def said(table: str, rule: Column | str, keys: list[str], own: int) -> Column:
        rule = rule if isinstance(rule, Column) else F.lit(rule)
        key = F.array(*[F.col(k).cast("string") for k in keys]) if keys else F.lit(None).cast(
            "array<string>")
        whole = F.struct(F.lit(table).alias("table"), rule.alias("rule"), key.alias("key"),
                         F.lit(own).alias("own"), F.lit(1 - own).alias("children"))
        known = [F.col(k).isNotNull() for k in keys]
        for one in known[1:]:
            known[0] = known[0] & one
        return F.when(known[0], whole) if known else whole

    checks = [said(name, rule, keys, 1) for rule, keys in unique_keys(name).items()
              if set(keys) <= set(rows.columns)]
    parent, key = parent_of(name) or (None, None)
    if parent in tables:
        checks.append(said(name, f"{key}_exists", [key], 0))
    for child in tables:
        parent, key = parent_of(child) or (None, None)
        if parent == name:
            checks.append(said(child, f"{key}_exists", [key], 1))
    broken = F.transform("violations", lambda rule: said(name, rule, [], 1))
    everything = F.concat(broken, F.array_compact(F.array(*checks))) if checks else broken
    return violations(rows, table_rules(name)).select(F.explode(everything).alias("said")).select("said.*")

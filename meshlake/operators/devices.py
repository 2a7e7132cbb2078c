"""What a device record says about its kind: mode (PRJ-14), projection (PRJ-07), eligibility (FLT-13), and the order of derived comparison items (SRT-05)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roles of routers, types of devices, and beginnings of their names.
ROUTER_ROLES = ("router", "leader", "border router", "border_router", "borderrouter")
MESH_TYPES = ("router", "border router", "child", "sleepy-child", "sleepy child")
DEVICE_KINDS = ("FTD", "MTD")


def _kind(text: Column) -> Column:
    value = F.upper(F.trim(text))
    return F.when(value.isin(*DEVICE_KINDS), value)


def mode_device(record: Mapping[str, Column]) -> Column:
    """PRJ-14: FTD or MTD by the first evidence that tells: flat and nested mode text, mode flag, mode number, role, type; null if none does.

    record: flat, nested, flag (boolean), number, role, type.
    """
    role, kind = F.lower(F.trim(record["role"])), F.lower(F.trim(record["type"]))
    full = lambda c: F.when(c, "FTD").otherwise("MTD")
    return F.coalesce(
        _kind(record["flat"]),
        _kind(record["nested"]),
        F.when(record["flag"].isNotNull(), full(record["flag"])),
        F.when(record["number"].isNotNull(), full(F.abs(record["number"]) >= 1)),  # the whole part counts
        F.when(role.isin("router", "border router"), "FTD").when(role == "child", "MTD"),
        F.when(kind.isin("router", "border router"), "FTD").when(kind.contains("child"), "MTD"),
    )


def projection(record: Mapping[str, Column], arrays: Mapping[str, Column]) -> dict[str, Column]:
    """PRJ-07: the columns of a device as every view shows it: what is said outright, else what its role, else what its short address says.

    record: rloc16, role, is_router, is_leader, is_border_router (booleans or null), mode_device, total_children. arrays: relationships by name, counted.
    """
    rloc, role = F.lower(F.coalesce(record["rloc16"], F.lit(""))), F.lower(F.trim(F.coalesce(record["role"], F.lit(""))))
    derived = rloc.rlike("^0x..00$")
    said = record["is_router"].isNotNull() | (role != "")
    kind = F.upper(record["mode_device"])
    out = {
        "rloc16": rloc,
        "device_type": F.when(kind.isin("FTD", "MTD", "REED"), kind).otherwise("unknown"),
        "is_router": F.coalesce(record["is_router"], F.when(role != "", role.isin(*ROUTER_ROLES)), derived),
        "is_leader": F.coalesce(record["is_leader"], role == "leader"),
        "is_border_router": F.coalesce(record["is_border_router"], F.lit(False)),
        "role_evidence": F.when(said, "explicit").when(derived, "rloc16-derived").otherwise("none"),
        "total_children": F.coalesce(record["total_children"], F.lit(0)),
    }
    return out | {f"n_{name}": F.coalesce(F.size(F.when(c.isNotNull(), c)), F.lit(0)) for name, c in arrays.items()}


def eligible(record: Mapping[str, Column]) -> Column:
    """FLT-13: whether a record is one of the mesh: it has a short address, is a border router, or is of a type or role of the mesh."""
    told = F.lit(False)
    for name in ("type", "role"):
        told = told | F.coalesce(F.lower(F.trim(record[name])).isin(*MESH_TYPES), F.lit(False))
    address = F.coalesce(record["rloc16"].rlike("^0[xX][0-9a-fA-F]{4}$"), F.lit(False))
    return address | F.coalesce(record["is_border_router"], F.lit(False)) | told


def derived_order(item: Mapping[str, Column], by: str, descending: bool) -> list[Column]:
    """SRT-05: the order of derived comparison items by subject, evidence or change; descending turns the whole key round, ties included.

    item: scope, subject, kind, relationship, metric, samples, change, id.
    """
    text = lambda c: F.coalesce(item[c], F.lit(""))
    ties = [item["scope"], item["subject"], item["kind"], text("metric"), item["id"]]
    keys = {"subject": [F.lower(item["subject"])], "evidence": [item["kind"], text("relationship"), text("metric"), item["samples"]], "change": [item["change"]]}
    return [c.desc() if descending else c.asc() for c in (*keys[by], *ties)]

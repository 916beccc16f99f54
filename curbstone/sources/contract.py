"""The feed's contract: fields, types and geometry that the pipeline relies on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Fixed values of the feed: name as served, kind, our column.
OID, TEXT, DATE, GUID, GEOMETRY = "esriFieldTypeOID", "esriFieldTypeString", "esriFieldTypeDate", "esriFieldTypeGlobalID", "esriGeometryPoint"
FIELDS = (
    ("OBJECTID", OID, "object_id"),
    ("ReferenceNumber", TEXT, "reference_number"),
    ("CategoryLevel1", TEXT, "category_level1"),
    ("CategoryLevel2", TEXT, "category_level2"),
    ("CategoryName", TEXT, "category_name"),
    ("CouncilDistrictNumber", TEXT, "council_district"),
    ("SourceLevel1", TEXT, "source_level1"),
    ("Neighborhood", TEXT, "neighborhood"),
    ("DateCreated", DATE, "date_created"),
    ("DateUpdated", DATE, "date_updated"),
    ("DateClosed", DATE, "date_closed"),
    ("CrossStreet", TEXT, "cross_street"),
    ("GlobalID", GUID, "global_id"),
    ("ZIP", TEXT, "zip"),
    ("SFTicketID", TEXT, "sf_ticket_id"),
    ("Address", TEXT, "address"),
    ("Data_Source", TEXT, "data_source"),
    ("PublicStatus", TEXT, "public_status"),
)

_KINDS = {OID: T.LongType(), DATE: T.LongType(), TEXT: T.StringType(), GUID: T.StringType()}
#: Raw rows as columns.
RAW = T.StructType([T.StructField(c, _KINDS[k]) for _, k, c in FIELDS] + [T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


@dataclass
class Difference:
    """What differs between a layer and the contract. Added fields are harmless; anything else is drift."""

    missing: list[str] = field(default_factory=list)
    retyped: list[str] = field(default_factory=list)
    added: list[str] = field(default_factory=list)
    geometry: str | None = None

    @property
    def drift(self) -> bool:
        return bool(self.missing or self.retyped or self.geometry)

    def __str__(self) -> str:
        parts = [f"{k}: {', '.join(v)}" for k, v in (("missing", self.missing), ("retyped", self.retyped), ("added", self.added)) if v]
        return "; ".join(parts + [self.geometry] * bool(self.geometry)) or "as expected"


def compare(layer: dict) -> Difference:
    """A layer's description against FIELDS: names in any case, types exactly."""
    served = {f.get("name", "").lower(): (f.get("name", ""), f.get("type", "")) for f in layer.get("fields") or []}
    out = Difference()
    for name, kind, _ in FIELDS:
        if name.lower() not in served:
            out.missing.append(name)
        elif served[name.lower()][1] != kind:
            out.retyped.append(f"{name} ({kind} -> {served[name.lower()][1]})")
    known = {n.lower() for n, _, _ in FIELDS}
    out.added = sorted(n for k, (n, _) in served.items() if k not in known)
    got = layer.get("geometryType")
    if got != GEOMETRY:
        out.geometry = f"geometry {got or '(none)'} instead of {GEOMETRY}"
    return out

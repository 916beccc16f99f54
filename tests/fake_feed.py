"""A feed in memory: it answers the predicates that jobs use and refuses others."""

import re
from datetime import datetime, timezone

from curbstone.plans.jobs import Feed
from curbstone.sources.contract import FIELDS, GEOMETRY


def ms(text: str) -> int:
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1000)


def feature(object_id, ref, updated="2026-09-20T12:00:00", **more):
    a = {n: None for n, _, _ in FIELDS} | {
        "OBJECTID": object_id, "ReferenceNumber": ref, "CategoryLevel1": "Water", "CategoryLevel2": "Leak", "CouncilDistrictNumber": "District 4", "SourceLevel1": "Phone",
        "Neighborhood": "Pocket", "DateCreated": ms("2026-09-01T12:00:00"), "DateUpdated": ms(updated), "PublicStatus": "NEW",
    }
    geometry = more.pop("geometry", {"x": -121.5, "y": 38.5})
    return {"attributes": a | more, "geometry": geometry}


class FakeFeed:
    def __init__(self, features):
        self.features, self.layer, self.calls, self.fail_at = list(features), {"fields": [{"name": n, "type": k} for n, k, _ in FIELDS], "geometryType": GEOMETRY}, [], None

    def _match(self, where: str, a: dict) -> bool:
        for part in where.split(" AND "):
            part = part.strip().lstrip("(")
            part = part if " IN " in part else part.rstrip(")")
            if part == "1=1":
                continue
            if m := re.fullmatch(r"OBJECTID (>|<=) (\d+)", part):
                ok = a["OBJECTID"] > int(m[2]) if m[1] == ">" else a["OBJECTID"] <= int(m[2])
            elif m := re.fullmatch(r"DateUpdated (>=|<|>) TIMESTAMP '([^']+)'", part):
                t, u = ms(m[2].replace(" ", "T")), a["DateUpdated"] or 0
                ok = u >= t if m[1] == ">=" else u < t if m[1] == "<" else u > t
            elif m := re.fullmatch(r"ReferenceNumber IN \((.*?)\)?", part):
                ok = a["ReferenceNumber"] in [x.replace("''", "'") for x in re.findall(r"'((?:[^']|'')*)'", m[1])]
            else:
                raise AssertionError(f"unknown predicate {part}")
            if not ok:
                return False
        return True

    def query(self, where: str, size: int) -> dict:
        self.calls.append(where)
        if self.fail_at == len(self.calls):
            raise RuntimeError("the feed broke off")
        rows = sorted((f for f in self.features if self._match(where, f["attributes"])), key=lambda f: f["attributes"]["OBJECTID"])
        return {"features": rows[:size], "exceededTransferLimit": len(rows) > size}

    def feed(self) -> Feed:
        return Feed(self.query, lambda where: sum(self._match(where, f["attributes"]) for f in self.features), lambda: self.layer)


SHARED = FakeFeed([feature(k * 3, f"S{k:03d}") for k in range(1, 24)])


def shared_query(where: str, size: int) -> dict:
    return SHARED.query(where, size)

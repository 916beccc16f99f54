"""A Parquet table served as a feed: pages and figures for the predicates that this library asks a feed for."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds

#: What a served row is known by; a table's columns are named for these.
ID, KEY, TIME = "OBJECTID", "ReferenceNumber", "DateUpdated"
#: Rows held of a table at a time, in the order of ids: pages are cut from them.
BLOCK = 250_000
_OPS = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "=": "__eq__"}


def argument(path: str, **columns: str) -> str:
    """The argument option of a source that reads the table at path, with the columns that stand for OBJECTID and others."""
    return json.dumps({"path": path, "columns": columns})


class _Table:
    """A table on a file system that tasks can read; its times are UTC."""

    def __init__(self, argument: str):
        told = json.loads(argument)
        self.data, self.columns = ds.dataset(told["path"]), told["columns"]

    def _part(self, text: str) -> pc.Expression | None:
        text, extra = text.strip(), (lambda t: t.count("(") - t.count(")"))(re.sub(r"'[^']*'", "", text))
        text = text[max(0, extra) : len(text) + min(0, extra)]  # brackets around several parts
        while text.startswith("("):
            text = text[1:-1].strip()
        if text == "1=1":
            return None
        if m := re.fullmatch(r"(\w+) IN \((.*)\)", text, re.S):
            return ds.field(self.columns[m[1]]).isin([k.replace("''", "'") for k in re.findall(r"'((?:[^']|'')*)'", m[2])])
        m = re.fullmatch(r"(\w+) (>=|<=|>|<|=) (?:TIMESTAMP '([^']+)'|(-?\d+))", text)
        if not m:
            raise ValueError(f"not a predicate of this feed: {text}")
        value = pa.scalar(datetime.fromisoformat(m[3]), self.data.schema.field(self.columns[m[1]]).type) if m[3] else int(m[4])
        return getattr(ds.field(self.columns[m[1]]), _OPS[m[2]])(value)

    def _filter(self, where: str) -> pc.Expression | None:
        parts = [self._part(t) for t in re.split(r" AND (?=(?:[^']*'[^']*')*[^']*$)", where)]
        keep = None
        for p in parts:
            keep = p if keep is None else keep if p is None else keep & p
        return keep

    def batches(self, where: str, columns: list[str] | None = None) -> Iterator[pa.Table]:
        """Rows of where, few at a time; parts of the table whose least and greatest ids rule them out aren't read."""
        keep = self._filter(where)
        for batch in self.data.to_batches(filter=keep, columns=columns, batch_readahead=2, fragment_readahead=1):
            if len(batch):
                yield pa.Table.from_batches([batch])

    def first(self, where: str, n: int) -> tuple[pa.Table, bool]:
        """(the n rows of where with the smallest ids in their order, whether there are more); about 2 n rows are held."""
        order, more, held, size = self.columns[ID], False, [self.data.schema.empty_table()], 0
        cut = lambda: pa.concat_tables(held).sort_by(order).slice(0, n).combine_chunks()
        for rows in self.batches(where):
            held.append(rows)
            size += len(rows)
            if size > 2 * n:
                more, held, size = True, [cut()], n
        return cut(), more or size > n


def _plain(v):
    return int(v.timestamp() * 1000) if isinstance(v, datetime) else v


def _milliseconds(column: pa.ChunkedArray) -> pa.ChunkedArray:
    return pc.floor(pc.divide(column.cast(pa.timestamp("us")).cast(pa.int64()), 1000)).cast(pa.int64()) if pa.types.is_timestamp(column.type) else column


def pages_of(argument: str, block: int = BLOCK) -> Callable[[str, int], dict]:
    """A feed's query(where, size) over the table that argument() names.

    The rows after a cursor are sorted once in blocks, from which the pages that follow it are cut: a range of ids is read once for
    each block of its rows, not once for each page.
    """
    table, held = _Table(argument), [("", 0, None, False)]

    def page_at(where: str, size: int) -> tuple[pa.Table, bool]:
        m = re.fullmatch(rf"(.*) AND {ID} > (-?\d+)", where, re.S)
        if not m:
            return table.first(where, size)
        rest, after = m[1], int(m[2])
        of, since, rows, more = held[0]
        at = None
        if rows is not None and of == rest and since <= after:
            at = bisect_right(rows.column(table.columns[ID]), after, key=lambda v: v.as_py())
        if at is None or (more and len(rows) - at < size):
            rows, more = table.first(where, max(block, size))
            held[0], at = (rest, after, rows, more), 0
        return rows.slice(at, size), more or len(rows) - at > size

    def query(where: str, size: int) -> dict:
        page, more = page_at(where, size)
        names = {c: n for n, c in table.columns.items()}
        columns = {names.get(c, c): _milliseconds(page.column(c)).to_pylist() for c in page.column_names}
        features = [{"attributes": dict(zip(columns, values)), "geometry": None} for values in zip(*columns.values())]
        return {"features": features, "exceededTransferLimit": more}

    return query


def statistics_of(argument: str) -> Callable[[str, list, str | None], list[dict]]:
    """A feed's statistics(where, asked, group) over the table that argument() names."""
    table = _Table(argument)

    def ask(where: str, asked: list[tuple[str, str]], group: str | None) -> list[dict]:
        kinds = {"count": "count", "min": "min", "max": "max", "distinct": "count_distinct"}
        fields = sorted({table.columns[f] for _, f in asked} | ({table.columns[group]} if group else set()))
        keys, of = [table.columns[group]] if group else [], {(k, f): (table.columns[f], kinds[k]) for k, f in asked}
        names = {f"{s}_{f}".lower(): "_".join(of[s, f]) for s, f in asked} | ({group: table.columns[group]} if group else {})
        plain = lambda rows: pa.table({c: _milliseconds(rows.column(c)) for c in fields})
        if any(k == "distinct" for k, _ in asked):  # values that occur are kept, so all are counted at once
            got = plain(table.data.to_table(filter=table._filter(where), columns=fields)).group_by(keys).aggregate(list(of.values()))
        else:
            # Figures of a few rows at a time are merged: counts are summed, the least and greatest are so again.
            parts = [plain(table.data.schema.empty_table()).group_by(keys).aggregate(list(of.values()))]
            parts += [plain(rows).group_by(keys).aggregate(list(of.values())) for rows in table.batches(where, fields)]
            again = {"count": "sum"}
            merged = pa.concat_tables(parts).group_by(keys).aggregate([("_".join(m), again.get(m[1], m[1])) for m in of.values()])
            got = merged.select(keys + ["_".join((*m, again.get(m[1], m[1]))) for m in of.values()]).rename_columns(keys + ["_".join(m) for m in of.values()])
        return [{n: r[c] for n, c in names.items()} for r in got.to_pylist()]

    return ask

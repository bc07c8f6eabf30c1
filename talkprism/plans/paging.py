"""Deterministic orders and keyset pages.

A page asks for one row more than its limit, which plans as TakeOrderedAndProject: each task
keeps its first rows and no full sort happens. The cursor carries the last row's sort values,
so the next page is a filter on them and costs the same at any depth.
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from talkprism.errors import FragileReferenceStale, InvalidRequest, Oversized

MAX_CURSOR_BYTES = 4096
ORDERS = ("OldestFirst", "NewestFirst", "OldestModifiedFirst", "NewestModifiedFirst", "ReferenceAscending")


@dataclass(frozen=True)
class Key:
    column: str
    descending: bool = False

    def order(self) -> Column:
        c = F.col(self.column)
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()


def keys(order: str, reference: str, time: str, modified: str | None = None, ties: tuple[str, ...] = ()) -> list[Key]:
    """Sort keys of an order; times compare as texts, rows without one come last either way."""
    if order not in ORDERS:
        raise InvalidRequest(f"unknown order {order}")
    if order == "ReferenceAscending":
        return [Key(reference)]
    by = modified if "Modified" in order and modified else time
    return [Key(by, order.startswith("Newest")), *[Key(t) for t in ties], Key(reference)]


BLOCK_TIES = ("source", "source_identifier", "path", "line_number", "block_index")


def after(sort: list[Key], last: list) -> Column:
    """Rows that come after the row with the values ``last``."""
    out: Column = F.lit(False)
    for key, value in reversed(list(zip(sort, last, strict=True))):
        c = F.col(key.column)
        if value is None:
            out = c.isNull() & out
        else:
            at = value if isinstance(value, Column) else F.lit(value)
            beyond = (c < at) if key.descending else (c > at)
            out = F.coalesce(beyond, F.lit(False)) | c.isNull() | ((c == at) & out)
    return out


def ordered(rows: DataFrame, sort: list[Key], limit: int | None = None) -> DataFrame:
    out = rows.orderBy(*[k.order() for k in sort])
    return out if limit is None else out.limit(limit)


def check_limit(value: int, most: int, what: str) -> int:
    if value <= 0:
        raise InvalidRequest(f"{what} must be positive")
    if value > most:
        raise Oversized(f"{what} is above {most}")
    return value


@dataclass(frozen=True)
class Page:
    rows: list
    next_cursor: str | None


def signature(collection: str, order: str, limit: int, query, snapshot: str) -> str:
    """Binds a cursor to its listing, filter and snapshot."""
    text = json.dumps([collection, order, limit, repr(query), snapshot])
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def page(rows: DataFrame, sort: list[Key], limit: int, bound: str, cursor: str | None = None) -> Page:
    """One page of ``rows``; ``bound`` is the listing's signature. A cursor of another one is stale.

    Timestamps stand in a cursor as microseconds since 1970 in UTC, so neither the session's time
    zone nor the driver's has a part in them.
    """
    names, kinds = rows.columns, dict(rows.dtypes)
    times = [k.column for k in sort if kinds[k.column] == "timestamp"]
    if cursor is not None:
        try:
            if len(cursor) > MAX_CURSOR_BYTES:
                raise ValueError("too long")
            own, last = json.loads(base64.urlsafe_b64decode(cursor))
        except ValueError as e:
            raise FragileReferenceStale("the cursor can't be read") from e
        if own != bound or len(last) != len(sort):
            raise FragileReferenceStale("the cursor belongs to another listing or snapshot")
        rows = rows.where(after(sort, [F.timestamp_micros(F.lit(v)) if k.column in times and v is not None else v for k, v in zip(sort, last, strict=True)]))
    found = ordered(rows.select("*", *[F.unix_micros(c).alias(f"micros of {c}") for c in times]), sort, limit + 1).collect()
    more = len(found) > limit
    found = found[:limit]
    last = [found[-1][f"micros of {k.column}" if k.column in times else k.column] for k in sort] if found else []
    own = Row(*names)
    return Page([own(*r[: len(names)]) for r in found], base64.urlsafe_b64encode(json.dumps([bound, last]).encode()).decode() if more else None)

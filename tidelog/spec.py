"""Static descriptions: databases, tables and keys."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class TableSpec:
    """A table with its primary key, time column and foreign keys (column to table)."""

    name: str
    pkey: str | None = None
    time_col: str | None = None
    fkeys: dict[str, str] = field(default_factory=dict)
    #: SQL for a key of the rows, where there is no primary key.
    row_key: str | None = None

    @property
    def key(self) -> str:
        """SQL for what tells rows apart in orderings."""
        return self.row_key or self.pkey or "0"

    @property
    def is_fact(self) -> bool:
        """Rows of a table with a time are events."""
        return self.time_col is not None


@dataclass(frozen=True)
class DatabaseSpec:
    """Tables in declaration order, with the default cutoff and horizon in seconds."""

    name: str
    tables: tuple[TableSpec, ...]
    cutoff: int
    horizon: int

    def __getitem__(self, table: str) -> TableSpec:
        return next(t for t in self.tables if t.name == table)

    @property
    def facts(self) -> list[TableSpec]:
        """Tables with a time, in order; the place is the table's index."""
        return [t for t in self.tables if t.is_fact]

    def table_idx(self, table: str) -> int:
        """Place of a fact table among the facts."""
        return [t.name for t in self.facts].index(table)

    @property
    def entities(self) -> list[TableSpec]:
        """Tables with a primary key that some foreign key points at."""
        targets = {to for t in self.tables for to in t.fkeys.values()}
        return [t for t in self.tables if t.pkey and t.name in targets]

    def slots(self, entity: str) -> list[tuple[TableSpec, str]]:
        """Foreign keys of facts that point at an entity table."""
        return [(t, col) for t in self.facts for col, to in t.fkeys.items() if to == entity]


def union_spec(specs: dict[str, DatabaseSpec]) -> DatabaseSpec:
    """Several databases as one: tables, entities and targets of links named db::table, databases by name.

    Without a name of its own, a link would point at whichever database has a
    table of that name. Facts are numbered on from 0, with no number left out,
    and no link leaves its database; anything else is an error.
    """
    tables = []
    for db in sorted(specs):
        known = {t.name for t in specs[db].tables}
        for t in specs[db].tables:
            if lost := set(t.fkeys.values()) - known:
                raise ValueError(f"{db}::{t.name} links to {sorted(lost)}, which its database lacks")
            tables.append(replace(t, name=f"{db}::{t.name}", fkeys={c: f"{db}::{to}" for c, to in t.fkeys.items()}))
    if len({t.name for t in tables}) < len(tables):
        raise ValueError("two tables of a database share a name")
    return DatabaseSpec("+".join(sorted(specs)), tuple(tables), max(s.cutoff for s in specs.values()), max(s.horizon for s in specs.values()))


DAY = 86400
#: 2000-07-01 and 2024-01-23.
SHOP = DatabaseSpec(
    "shop",
    (
        TableSpec("region", "r_regionkey"),
        TableSpec("nation", "n_nationkey", fkeys={"n_regionkey": "region"}),
        TableSpec("customer", "c_custkey", fkeys={"c_nationkey": "nation"}),
        TableSpec("supplier", "s_suppkey", fkeys={"s_nationkey": "nation"}),
        TableSpec("part", "p_partkey"),
        TableSpec("orders", "o_orderkey", "o_orderdate", {"o_custkey": "customer"}),
        TableSpec("lineitem", None, "l_shipdate", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, "l_orderkey * 10 + l_linenumber"),
    ),
    cutoff=962409600,
    horizon=90 * DAY,
)
CLICKS = DatabaseSpec(
    "clicks",
    (TableSpec("customer", "c_custkey"), TableSpec("events", "event_id", "ts", {"user_id": "customer"})),
    cutoff=1705968000,
    horizon=7 * DAY,
)

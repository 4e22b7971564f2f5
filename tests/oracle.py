"""Holds a query against its SQL on the same tables."""

import os

import duckdb


def rows_of(frame):
    """Rows with columns by name, doubles rounded, in a fixed order."""
    names = sorted(frame.columns)
    return names, _ordered([tuple(r) for r in frame.select(*[f"`{n}`" for n in names]).collect()])


def rows_of_sql(sql, folder):
    """The same of SQL over the tables of a folder."""
    with duckdb.connect() as db:
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            path = path + "/*.parquet" if os.path.isdir(path) else path
            db.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
        found = db.sql(sql)
        names = sorted(found.columns)
        return names, _ordered(found.select(", ".join(f'"{n}"' for n in names)).fetchall())


def _ordered(rows):
    plain = [tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))

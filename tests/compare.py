"""Compare a Spark result with the rows of a DuckDB statement: same columns, types and rows."""

from __future__ import annotations

SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def _text(value):
    return "" if value is None else repr(value) if isinstance(value, float) else str(value)


def assert_same(df, con, sql: str) -> int:
    columns = sorted(df.columns)
    cursor = con.execute(sql)
    types = {c[0]: str(c[1]) for c in cursor.description}
    assert sorted(types) == columns
    assert types == {c: SQL_TYPES[t] for c, t in df.dtypes}
    at = {c[0]: i for i, c in enumerate(cursor.description)}
    expected = sorted(tuple(_text(r[at[c]]) for c in columns) for r in cursor.fetchall())
    got = sorted(tuple(_text(r[c]) for c in columns) for r in df.collect())
    missing, extra = [r for r in expected if r not in set(got)], [r for r in got if r not in set(expected)]
    assert got == expected, f"{len(missing)} missing, e.g. {missing[:2]}; {len(extra)} extra, e.g. {extra[:2]}; {columns}"
    return len(got)

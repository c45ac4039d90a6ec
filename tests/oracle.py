"""Run a registered query and its SQL side by side."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """What differs between the two results, or None."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    types = {d[0]: str(d[1]) for d in relation.description}
    expected = relation.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    actual = [tuple(row) for row in spark_df.collect()]
    known = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for name, spark_type in spark_df.dtypes:
        if known.get(spark_type) != types[name]:
            return f"type of {name}: {spark_type} != {types[name]}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows != {len(expected)}"
    left, right = _rows(spark_df.columns, actual), _rows(names, expected)
    wrong = [(a, e) for a, e in zip(left, right, strict=True) if a != e]
    return f"{len(wrong)} of {len(left)} rows differ, e.g. {wrong[0]}" if wrong else None

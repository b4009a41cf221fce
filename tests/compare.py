"""Rows of a Spark query beside those of its DuckDB SQL."""

import os

import duckdb


def rounded(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(rounded, value)) if isinstance(value, list) else value


def both(frame, sql, folder):
    connection = duckdb.connect()
    for name in os.listdir(folder):
        connection.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    relation = connection.sql(sql)
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    ours = [tuple(rounded(r[c]) for c in columns) for r in frame.collect()]
    theirs = [tuple(map(rounded, r)) for r in relation.select(*[f'"{c}"' for c in columns]).fetchall()]
    return sorted(ours, key=repr), sorted(theirs, key=repr)

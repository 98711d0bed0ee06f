"""Run registered queries against their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return repr(v)


def rows_of(table) -> list[tuple]:
    """Rows of an Arrow table, columns by name, as comparable text."""
    names = sorted(table.column_names)
    columns = [[_cell(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns))


def differences(spark_table, duck_table) -> str | None:
    if sorted(spark_table.column_names) != sorted(duck_table.column_names):
        return f"columns {sorted(spark_table.column_names)} != {sorted(duck_table.column_names)}"
    if spark_table.num_rows != duck_table.num_rows:
        return f"rows {spark_table.num_rows} != {duck_table.num_rows}"
    a, b = rows_of(spark_table), rows_of(duck_table)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ, first: {wrong[0]}"
    types = {
        n: (str(spark_table.schema.field(n).type), str(duck_table.schema.field(n).type))
        for n in spark_table.column_names
    }
    odd = {n: t for n, t in types.items() if t[0] != t[1] and {*t} != {"string", "large_string"}}
    return f"types {odd}" if odd else None


def main(sf_dir: str, wanted: list[str]) -> int:
    from fitgrain.catalog import ORACLES, QUERIES
    from fitgrain.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toArrow()
            took = time.time() - start
            if name not in ORACLES:
                note = "rows only"
            else:
                note = differences(got, con.sql(ORACLES[name]).to_arrow_table()) or "same"
        except Exception as error:  # report every query of a run
            note, took, got = f"{type(error).__name__}: {str(error)[:600]}", time.time() - start, None
        bad += note not in ("same", "rows only")
        print(f"{name:36s} {took:7.2f}s {got.num_rows if got is not None else -1:8d} {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

"""Run registered queries beside their SQL: python tests/check_sql.py [folder] [name ...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

import __spark_entry__ as registered
from parley.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(rows, columns, order):
    def cell(value):
        if isinstance(value, float):
            value = round(value, 6) + 0.0
            return repr(int(value)) if value.is_integer() else repr(value)
        return repr(value)

    at = [columns.index(c) for c in order]
    return sorted(tuple(cell(row[i]) for i in at) for row in rows)


def compare(spark, con, folder, name):
    """Problems found, empty when rows, columns and values agree."""
    frame = registered.queries()[name](spark, folder)
    rows = [tuple(r) for r in frame.collect()]
    text = registered.oracle_sql().get(name)
    if text is None:
        return [] if rows else ["no rows"], len(rows)
    result = con.execute(text)
    names = [d[0] for d in result.description]
    wanted = result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} against {sorted(names)}"], len(rows)
    order = sorted(names)
    mine, theirs = canonical(rows, frame.columns, order), canonical(wanted, names, order)
    if mine != theirs:
        left = [r for r in mine if r not in set(theirs)][:2]
        right = [r for r in theirs if r not in set(mine)][:2]
        return [f"{len(mine)} rows against {len(theirs)}", str(left)[:900], str(right)[:900]], len(rows)
    return [], len(rows)


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in sys.argv[2:] or registered.queries():
        start = time.time()
        try:
            problems, n = compare(spark, con, folder, name)
        except Exception as error:
            problems, n = [f"{type(error).__name__}: {str(error)[:1500]}"], 0
        bad += bool(problems)
        kind = "sql" if name in registered.oracle_sql() else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {name:24} {kind} {n:7} rows {time.time() - start:6.1f}s", flush=True)
        for problem in problems:
            print("     ", problem)
    print("failed:", bad)


if __name__ == "__main__":
    main()

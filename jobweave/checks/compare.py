"""Run a registered query and its SQL, and compare their rows without regard to order."""
import datetime
import decimal
import math


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9g}" if not float(v).is_integer() else str(int(v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return str(v)


def normal_rows(columns, rows):
    """Rows as sorted text, columns in order of name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def oracle_rows(sf_dir: str, sql: str):
    import duckdb

    from jobweave.checks.views import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return columns, cur.fetchall()


def difference(spark_columns, spark_rows, sql_columns, sql_rows) -> str:
    """Empty when equal, else a short report."""
    if sorted(spark_columns) != sorted(sql_columns):
        return f"columns {sorted(spark_columns)} != {sorted(sql_columns)}"
    a, b = normal_rows(spark_columns, spark_rows), normal_rows(sql_columns, sql_rows)
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{len(a)} rows against {len(b)}; only in Spark {only_a}; only in SQL {only_b}"

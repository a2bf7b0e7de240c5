"""Order-free comparison of result rows."""

import math


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value if isinstance(value, bytes) else plain(float(value))


def rows_of(df) -> list[str]:
    names = sorted(df.columns)
    return sorted(repr([plain(v) for v in r]) for r in df.select(*[f"`{n}`" for n in names]).collect())


def rows_of_sql(connection, sql: str) -> tuple[list[str], list[str]]:
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr([plain(r[k]) for k in order]) for r in result.fetchall())

"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import datetime
import decimal


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        if v != v:
            return "NaN"
        return int(v) if float(v) == int(v) and abs(v) < 1 << 62 and not isinstance(v, float) else round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return v.date().isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fixed = [tuple(float(c) if isinstance(c, int) and not isinstance(c, bool) else c for c in (cell(r[i]) for i in order)) for r in data]
    return sorted(names), sorted(fixed, key=repr)


def same(df, con, sql):
    found = con.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    assert have[0] == want[0]
    assert have[1] == want[1]

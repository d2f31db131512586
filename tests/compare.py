"""Order-free comparison of a Spark result with a DuckDB result."""

import math


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(names, rows):
    at = [names.index(n) for n in sorted(names)]
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


def assert_same(df, duck, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    want = rows_of(names, found.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert got == want

"""Compares a Spark result with a DuckDB one, without regard to order."""


def cell(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    return str(v)


def same_rows(df, con, sql):
    cols = sorted(df.columns)
    ours = sorted(tuple(map(cell, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(cell(r[i]) for i in at) for r in got.fetchall())
    assert ours == theirs
    return ours

def same(df, duck, sql: str) -> None:
    """The rows of a DataFrame against those of DuckDB, columns by name, order aside."""
    rel = duck.execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want

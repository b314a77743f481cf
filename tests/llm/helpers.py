def rows(df, *columns):
    """Rows as tuples, sorted with None first."""
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(got, key=lambda r: [(x is not None, x) for x in r])

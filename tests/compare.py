"""Compare a registered query with its SQL twin on the same Parquet files."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, sf_dir, fn, sql):
    """None when equal, else a short text."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    want = rows_of(cols, cur.fetchall())
    if got == want:
        return None if got else "both empty"
    bad = [(g, w) for g, w in zip(got, want) if g != w][:2]
    if not bad or repr(got) != repr(want):
        only_g = [g for g in got if g not in set(want)][:2] if len(got) < 20000 else []
        only_w = [w for w in want if w not in set(got)][:2] if len(got) < 20000 else []
        return f"{len(got)} vs {len(want)} rows; only spark {only_g}; only sql {only_w}; {bad[:1]}"
    return f"{len(got)} vs {len(want)} rows; {bad}"

"""A query's rows against those of its SQL, by column name and without regard to order."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    def one(v):
        return (v is not None, round(v, 6) if isinstance(v, float) else str(v))

    return sorted(tuple(str(one(v)) for v in r) for r in rows)


def differences(df, sql: str, sf_dir: str) -> str:
    """What differs, empty if nothing."""
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    con.execute(f"CREATE TABLE wanted AS {sql}")
    names = sorted(df.columns)
    described = sorted(r[0] for r in con.execute("DESCRIBE wanted").fetchall())
    if names != described:
        return f"columns {names}, SQL {described}"
    want = con.execute("SELECT " + ", ".join(f'"{n}"' for n in names) + " FROM wanted").fetchall()
    got = [tuple(r) for r in df.select(*names).collect()]
    if canonical(got) == canonical(want):
        return ""
    a, b = canonical(got), canonical(want)
    one, two = set(a), set(b)
    return f"{len(a)} rows, SQL {len(b)}; {[x for x in a if x not in two][:2]} / {[x for x in b if x not in one][:2]}"

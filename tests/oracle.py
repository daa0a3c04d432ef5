"""Runs a query and its SQL side by side and compares rows whatever their order."""

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return a == b or math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-5)
    return a == b


def key(row):
    return [repr(x) for x in row if not isinstance(x, float)]


def rest(row):
    return [x for x in row if isinstance(x, float)]


def pair_up(got, want):
    """Rows of ``got`` that no row of ``want`` is left for. Rows are matched by
    their exact columns first; only floats are compared closely."""
    groups = {}
    for w in want:
        groups.setdefault(str(key(w)), []).append(w)
    for g in groups.values():
        g.sort(key=lambda r: [(math.isnan(x), x) for x in rest(r)])
    lost = []
    for g in sorted(got, key=lambda r: [(math.isnan(x), x) for x in rest(r)]):
        found = groups.get(str(key(g)), [])
        at = next((i for i, w in enumerate(found) if len(w) == len(g) and all(map(same, g, w))), None)
        if at is None:
            lost.append(g)
        else:
            found.pop(at)
    return lost


def check(df, con, sql):
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    plain = lambda x: float(x) if isinstance(x, Decimal) else x
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert len(got) == len(want)
    lost = pair_up(got, want)
    assert not lost, (len(lost), lost[:3])

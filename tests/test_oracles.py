"""Every query of the library runs on the smallest tables; those with SQL give the same rows as DuckDB."""

import math

import duckdb
import pytest

from sightline.plans.catalog import ORACLES, QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Queries whose order has ties only in larger tables.
TIES = ["flt22_interval_invariants", "tim5_thinned_frames", "jn1_track_choice", "jn6_stab_last_started", "jn8_stab_priority", "jn23_placeholder_anti", "win6_open_close_states", "win15_ema_smoother", "jn3_jn4_win7_long_keys"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    """A connection for each folder."""
    out = {}
    for folder in (SF, LARGER):
        out[folder] = duckdb.connect()
        for t in TABLES:
            out[folder].execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return out


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name, folder", [(n, SF) for n in sorted(QUERIES)] + [(n, LARGER) for n in TIES])
def test_query(spark, duck, name, folder):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert rows
    if name in ORACLES:
        found = duck[folder].execute(ORACLES[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=key)

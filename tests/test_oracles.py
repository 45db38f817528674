"""Every query that has SQL, by both engines over the smallest tables."""

import math
import os

import duckdb
import pytest

from retort.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Eighty files are written and read; the same readers are in load_peptides_standardized and load_splits.
LONG = {"load_datasets"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - LONG))
def test_both_engines_agree(spark, duck, name):
    out = catalog.queries()[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted((tuple(plain(v) for v in r) for r in out.select(*columns).collect()), key=repr)
    result = duck.execute(catalog.oracle_sql()[name])
    place = [d[0] for d in result.description]
    assert sorted(place) == columns
    want = sorted((tuple(plain(r[place.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_every_query_without_sql_is_named():
    """So that one whose SQL gets lost is noticed."""
    none = set(catalog.queries()) - set(catalog.oracle_sql())
    assert none == {
        "ad_pca_box", "bulk_fragments", "split_randomized_groups", "search_grid", "shape_usrcat", "shape_electroshape", "shape_whim", "shape_getaway", "shape_shells", "molecule_canonical", "fingerprint_property_pairs", "fingerprint_feature_sets", "fingerprint_screening", "fingerprint_fuzzy_pairs", "fingerprint_surface_bins", "fingerprint_circular", "fingerprint_atom_pairs", "fingerprint_torsions", "fingerprint_linear_paths",
        "fingerprint_layered", "fingerprint_keys", "fingerprint_circular_shingles", "fingerprint_minhash", "fingerprint_pair_shingles", "fingerprint_autocorrelation", "fingerprint_burden",
    }

"""A fit stores what its spec names, queries that encode all profiles read what the fit stored."""

import pytest

from workloom.learn import pipelines as pl
from workloom.plans import all_queries
from workloom.session import written
from workloom.sources.catalog import STANDINS, with_arrays


def _customers(spark, n=300):
    return spark.range(n).selectExpr("id AS c_custkey", "CAST(id * 7 % 501 AS DOUBLE) AS c_acctbal")


@pytest.mark.parametrize("name", ["suitability", "job"])
def test_a_fit_stores_the_columns_of_its_spec_only(spark, name):
    profiles = spark.sql(with_arrays(STANDINS["profiles"]), customer=_customers(spark))
    spec, kept = pl.SPECS[name], {}

    def store(df, label):
        kept[label] = written(df, label)
        return kept[label]

    fitted = pl.fit(profiles, spec, (), store=store)
    assert sorted(kept[f"labelled-{name}"].columns) == sorted(spec.columns())
    want = pl.labelled(profiles, spec).select(*spec.columns())
    assert fitted.rows.count() == 300 and fitted.rows.exceptAll(want).isEmpty() and want.exceptAll(fitted.rows).isEmpty()


@pytest.mark.parametrize("name", ["ml5_truncated_svd", "ml7_encoding"])
def test_profiles_are_labelled_once(spark, tmp_path, monkeypatch, name):
    _customers(spark).write.parquet(f"{tmp_path}/customer.parquet")
    seen, plain = [], pl.labelled
    monkeypatch.setattr(pl, "labelled", lambda profiles, spec: seen.append(spec.name) or plain(profiles, spec))
    out = all_queries()[name](spark, str(tmp_path)).collect()
    assert len(seen) == 1
    if name == "ml7_encoding":
        assert sorted(r.profile_id for r in out) == list(range(300)) and {r.domain_ones for r in out} <= {0.0, 1.0}
    else:
        assert [r.component for r in out] == list(range(1, 11)) and all(r.singular_value > 0 for r in out)

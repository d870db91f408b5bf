from assaygrid.operators import stats
from assaygrid.plans import catalogue, registry  # noqa: F401  importing registers the queries


def test_bootstrap_query_draws_as_often_as_the_operator(spark, monkeypatch):
    seen, of = [], stats.bootstrap
    monkeypatch.setattr(stats, "bootstrap", lambda *a, **k: seen.append(k.get("draws", 5000)) or of(*a, **k))
    registry.QUERIES["M02_A21_F15_bootstrap"](spark, "/root/testdata/sf0.001")
    assert seen == [5000]

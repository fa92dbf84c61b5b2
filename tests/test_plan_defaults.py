"""The registered model queries run the operators in full."""

import inspect

import pytest

from eventloom.operators import density, embed, importance, mixtures
from eventloom.plans import catalog, model_queries

SMALLER = {"epochs", "trees", "depth", "levels", "orders", "n_init"}


@pytest.mark.parametrize("name, module, operator", [
    ("M2_umap", embed, "umap_layout"), ("M3_densmap", embed, "umap_layout"), ("M4_tsne", embed, "tsne_layout"),
    ("M6_elbow", mixtures, "elbow"), ("M8_hdbscan", density, "hdbscan"), ("M9_feature_importance", importance, "feature_importance"),
    ("L6_top_importance", importance, "feature_importance"), ("M10_staged_importance", importance, "importance_of_coordinates"),
    ("M13_embedding", embed, "embed"), ("M14_cluster_by_method", density, "cluster"),
])
def test_no_query_runs_less_than_its_operator(monkeypatch, name, module, operator):
    class Called(Exception):
        pass

    whole = inspect.signature(getattr(module, operator))

    def record(*args, **kwargs):
        raise Called(whole.bind(*args, **kwargs).arguments)

    for given in ("cells", "vectors", "_importance_rows"):
        monkeypatch.setattr(model_queries, given, lambda *a: _Any())
    monkeypatch.setattr(module, operator, record)
    with pytest.raises(Called) as called:
        catalog.queries()[name](None, "")
    given = called.value.args[0]
    assert not SMALLER & {*given, *(k for v in given.values() if isinstance(v, dict) for k in v)}


class _Any:
    def select(self, *columns):
        return self


def test_importance_input_has_a_query_over_all_rows():
    assert "limit" not in catalog.oracle_sql()["M11_importance_input_all"]

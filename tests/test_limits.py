"""Registered queries run with the published limits."""
import inspect

import pytest

from ballast.operators import cluster as E
from ballast.operators import synth as H
from ballast.plans import catalog


class Seen(Exception):
    pass


@pytest.mark.parametrize("name, module, fn", [
    ("e2_choose_k_kmeans", E, "choose_k_kmeans"), ("e2_choose_k_kmeans_score", E, "choose_k_kmeans"), ("e3_choose_k_mixture", E, "choose_k_mixture"),
    ("e3_choose_k_mixture_bic", E, "choose_k_mixture"), ("e4_hierarchical", E, "hierarchical"), ("e12_class_subspaces", E, "class_subspaces"),
    ("e12_class_subspaces_rows", E, "class_subspaces"), ("h7_sample_subspace", H, "subspace_resample"), ("h7_sample_subspace_counts", H, "subspace_resample"),
    ("h8_sample_clustered", H, "clustered_resample")])
def test_queries_search_as_far_as_published(spark, sf, monkeypatch, name, module, fn):
    given = inspect.signature(getattr(module, fn))

    def spy(*args, **options):
        bound = given.bind(*args, **options)
        bound.apply_defaults()
        raise Seen({k: v for k, v in bound.arguments.items() if k in ("max_clusters", "max_components", "rounds")})

    monkeypatch.setattr(module, fn, spy)
    with pytest.raises(Seen) as seen:
        catalog.queries()[name](spark, sf)
    limits = seen.value.args[0]
    assert limits.pop("rounds", 100) == 100 and list(limits.values()) == [20]

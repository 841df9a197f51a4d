"""Registered experiments run as many folds, machines, replicates and members as their operators do by default."""

import inspect

import pytest

from sharewise.suite import QUERIES, models


@pytest.mark.parametrize(
    "name",
    ["cross_validate", "benchmark_models", "bootstrap_benchmark", "balanced_benchmark", "class_weight_sweep", "ensemble_benchmark"],
)
def test_registered_experiments_keep_the_defaults(monkeypatch, name):
    own = inspect.signature(getattr(models.ex, name))
    seen = []

    def operator(*args, **options):
        seen.append(own.bind(*args, **options).arguments)
        return None, None

    monkeypatch.setattr(models.ex, name, operator)
    monkeypatch.setattr(models, "training_vectors", lambda *_: (None, None))
    monkeypatch.setattr(models, "train_test", lambda *_: (None, None))
    monkeypatch.setattr(models, "r6", lambda frame: frame)
    QUERIES[name](None, None)
    for option in ("folds", "replicates", "machines", "steps", "ensembles", "size"):
        assert seen[0].get(option, None) in (None, getattr(own.parameters.get(option), "default", None))

import numpy as np
import pytest

from logsift.operators import models, persistence


def same(a: object, b: object) -> bool:
    if isinstance(a, (list, tuple)):
        return type(a) is type(b) and len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    if isinstance(a, np.ndarray):
        return a.dtype == b.dtype and a.shape == b.shape and np.array_equal(a, b)
    return type(a) is type(b) and a == b


X = np.random.default_rng(5).normal(size=(80, 6))
FITTED = [
    models.fit_rpca(X, 2),
    models.fit_autoencoder(X, (4, 2, 4), epochs=3),
    models.fit_forest(X, trees=5, size=32),
    models.fit_one_class(X, features=16, steps=10),
    models.Subspace(np.zeros(3), np.zeros((0, 3)), np.zeros(0)),
    models.Network(np.array([np.nan, np.inf]), []),
]


@pytest.mark.parametrize("model", FITTED, ids=lambda m: type(m).__name__)
def test_a_model_comes_back_whole(spark, tmp_path, model):
    path = str(tmp_path / "model")
    persistence.save(spark, model, path)
    back = persistence.load(spark, path)
    assert type(back) is type(model)
    if not (isinstance(model, models.Network) and not model.layers):
        assert same(vars(model), vars(back))
    else:
        assert np.isnan(back.mean[0]) and np.isinf(back.mean[1]) and back.layers == []
    again = persistence.from_parameters(persistence.parameters(spark, model).orderBy("place", ascending=False))
    assert vars(again).keys() == vars(model).keys()


def test_what_is_no_model_is_refused(spark):
    with pytest.raises(TypeError):
        persistence.parameters(spark, object())
    table = persistence.parameters(spark, FITTED[0])
    with pytest.raises(ValueError):
        persistence.from_parameters(table.unionByName(persistence.parameters(spark, FITTED[1])))
    with pytest.raises(ValueError):
        persistence.from_parameters(table.limit(0))

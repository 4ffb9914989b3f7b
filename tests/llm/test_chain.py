import itertools

import numpy as np
import pytest

from houselights.llm.chain import Chain


def random_chain(seed, labels=4):
    rng = np.random.default_rng(seed)
    chain = Chain(tuple("abcd"[:labels]))
    chain.first, chain.move = rng.normal(size=labels), rng.normal(size=(labels, labels))
    return chain, rng


@pytest.mark.parametrize("seed", range(4))
def test_batches_decode_like_enumeration(seed):
    chain, rng = random_chain(seed)
    sizes = np.array([3, 0, 1, 6, 5, 0, 2])
    score = rng.normal(size=(sizes.sum(), 4))
    best, at = chain.decode(score, sizes), 0
    for n in sizes:
        own = score[at:at + n]
        if n:
            def value(path):
                return (chain.first[path[0]] + sum(own[t, y] for t, y in enumerate(path))
                        + sum(chain.move[a, b] for a, b in zip(path, path[1:])))
            assert tuple(best[at:at + n]) == max(itertools.product(range(4), repeat=n), key=value)
        at += n


def test_nothing_to_decode():
    chain, _ = random_chain(0)
    assert len(chain.decode(np.zeros((0, 4)), np.array([0, 0]))) == 0


def test_slope_is_the_gradient_of_the_likelihood():
    rng = np.random.default_rng(5)
    theta = [rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)]
    items, ys = np.array([[1, 3], [2, 4], [1, 4], [2, 3]]), np.array([0, 2, 1, 1])

    def likelihood():
        score = theta[0][items].sum(axis=1)
        paths = {p: theta[2][p[0]] + sum(score[t, y] for t, y in enumerate(p)) + sum(theta[1][a, b] for a, b in zip(p, p[1:]))
                 for p in itertools.product(range(3), repeat=4)}
        return paths[tuple(ys)] - np.log(sum(np.exp(x) for x in paths.values()))

    slopes = [np.zeros_like(x) for x in theta]
    Chain._slope(items, ys, theta, slopes)
    for x, slope in zip(theta, slopes):
        for at in np.ndindex(x.shape):
            old, step = x[at], 1e-6
            x[at] = old + step
            up = likelihood()
            x[at] = old - step
            assert abs((up - likelihood()) / (2 * step) - slope[at]) < 1e-5
            x[at] = old


def test_training_learns_order():
    data = [([("x",)] * 3, ["a", "b", "b"]), ([("x",)] * 2, ["a", "b"])]
    chain = Chain(("a", "b")).train(data, rounds=100)
    assert list(chain.decode(chain.scores(chain.encode([("x",)] * 3)), np.array([3]))) == [0, 1, 1]
    assert chain.encode([("unseen",)]).tolist() == [[0]]

import numpy as np
import pytest

from veilmill.operators import draw


@pytest.mark.parametrize("spread", [0.0, 1.0, 30.0, 800.0])
def test_winners_are_those_of_all_noise(spread, monkeypatch):
    """the same winner and score as with noise for every pair, with noise for few of them."""
    rng = np.random.default_rng(5)
    high, low = rng.integers(-(2**63), 2**63 - 1, (2, 300))
    mark = rng.integers(-(2**63), 2**63 - 1, 700)
    mark[400] = mark[10]  # two members with the same noise
    weighed, of = rng.normal(size=(7, 700)) * spread, rng.integers(0, 7, 300)
    weighed[:, 400] = weighed[:, 10]
    weighed[3, 50:] = -np.inf
    weighed[4] = -np.inf
    scores = weighed[of] + draw.pair_gumbel(high, low, mark)
    places, noise, drawn = draw.pair_places(high, low, mark), draw.place_gumbel, []
    monkeypatch.setattr(draw, "place_gumbel", lambda p: drawn.append(p.size) or noise(p))
    at, top = draw.winners(weighed, of, places)
    assert (at == scores.argmax(axis=1)).all() and (top == scores.max(axis=1)).all()
    if spread == 1.0:
        assert sum(drawn) < places.size / 2

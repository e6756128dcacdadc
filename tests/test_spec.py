import dataclasses

import pytest

from sievecraft import CollectionSpec


def test_defaults():
    spec = CollectionSpec()
    assert (spec.malware_threshold, spec.n_cleanware, spec.n_malware, spec.random_seed) == (4, 1000, 500, 42)
    assert spec.year_bounds == (2022, 2024)


@pytest.mark.parametrize(
    "change",
    [
        {"date_start": "2024-12-01 00:00:00"},
        {"date_start": "2025-01-01 00:00:00"},
        {"date_start": "2022-04-01"},
        {"malware_threshold": -1},
        {"malware_threshold": 101},
        {"n_malware": 0},
        {"n_cleanware": 0},
    ],
)
def test_rejected(change):
    with pytest.raises(ValueError):
        CollectionSpec(**change)


def test_bounds_of_threshold():
    assert CollectionSpec(malware_threshold=0).malware_threshold == 0
    assert CollectionSpec(malware_threshold=100).malware_threshold == 100


def test_unknown_granularity_is_year():
    with pytest.warns(UserWarning):
        assert CollectionSpec(distribution_granularity="week").distribution_granularity == "year"


def test_fingerprint():
    spec = CollectionSpec()
    key = spec.fingerprint("c", "collect")
    same = dataclasses.replace(spec, n_malware=7, n_cleanware=9, distribution_granularity="month")
    assert same.fingerprint("c", "collect") == key
    others = [
        {"random_seed": 1},
        {"google_play_only": False},
        {"date_start": "2022-04-01 00:00:01"},
        {"malware_threshold": 5},
    ]
    keys = {dataclasses.replace(spec, **o).fingerprint("c", "collect") for o in others}
    keys |= {spec.fingerprint("d", "collect"), spec.fingerprint("c", "survey"), key}
    assert len(keys) == len(others) + 3


def test_seed_is_drawn_once():
    assert CollectionSpec().with_seed().random_seed == 42
    drawn = CollectionSpec(random_seed=None).with_seed()
    assert drawn.random_seed is not None and drawn.with_seed() is drawn
    with pytest.raises(ValueError):
        CollectionSpec(random_seed=None).fingerprint("c", "collect")

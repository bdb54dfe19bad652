import copy

import pytest

from veridra import policy

GOOD = {
    "fx": {"reconcile_tolerance": 0.01, "reference_tolerance": 0.15}, "validation": {"required_columns": ["TXN_ID"]}, "codes": {"processing_code_width": 2, "mcc_width": 4},
    "missing": {"auth_repeat_threshold": 2}, "duplicates": {"business_keys": [["A", "B"]]},
}


def test_policy_is_read():
    assert policy.from_mapping(GOOD).business_keys == (("A", "B"),)


@pytest.mark.parametrize(
    "section, key, value",
    [("fx", "reconcile_tolerance", 0), ("fx", "reconcile_tolerance", True), ("fx", "reference_tolerance", "x"), ("validation", "required_columns", []), ("validation", "required_columns", [1]), ("duplicates", "business_keys", [[]]), ("codes", "mcc_width", -1)],
)
def test_bad_values_are_named(section, key, value):
    bad = copy.deepcopy(GOOD)
    bad[section][key] = value
    with pytest.raises(policy.ConfigError, match=key):
        policy.from_mapping(bad)


@pytest.mark.parametrize("section", GOOD)
def test_missing_sections_are_named(section):
    with pytest.raises(policy.ConfigError, match=section):
        policy.from_mapping({k: v for k, v in GOOD.items() if k != section})


def test_fingerprint_follows_meaning():
    base = policy.fingerprint()
    assert base == policy.fingerprint() and len(policy.short_fingerprint()) == 12
    assert base != policy.fingerprint(policy.from_mapping(GOOD)) and base != policy.fingerprint(master={}) and base != policy.fingerprint(macro={"a": 1})
    assert policy.fingerprint(master={"A": {"mcc": "1", "aliases": []}}) == policy.fingerprint(master={"A": {"aliases": [], "mcc": "1"}})


def test_runtime():
    assert policy.runtime({"paths": {"source": "a", "output": "b"}}).source == "a"
    with pytest.raises(policy.ConfigError, match="output"):
        policy.runtime({"paths": {"source": "a"}})

"""Secrets in lines of the form NAME=value, and secrets without a digit."""

import random

import pytest

from florilege.llm import secrets

MIXED = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _fresh(seed, signs, n=40):
    rng = random.Random(seed)
    return "".join(rng.choice(signs) for _ in range(n))


def _found(text):
    base = secrets.base_spans(text)
    return [text[a:b] for a, _, b in secrets.novel_spans(text, base, secrets.Novelty())]


@pytest.mark.parametrize("name", ["AWS_SECRET_ACCESS_KEY=", "private_key=", "auth_key=", "A=B=login="])
@pytest.mark.parametrize("end", ["", "=="])
def test_name_and_value(name, end):
    value = _fresh(len(name), MIXED + "23456789") + end
    assert _found(f"x\n{name}{value}\ny") == [value]


def test_known_prefix_behind_a_name():
    value = "ghp_" + _fresh(4, MIXED + "23456789", 36)
    assert _found(f"GH={value}\n") == [value]


def test_no_digit():
    value = _fresh(6, MIXED)
    assert _found(f"auth header Bearer {value} end") == [value]


def test_names_are_not_secrets():
    assert _found("the key config_value_name_for_authentication=false auth") == []
    assert _found("nothing=" + _fresh(8, MIXED)) == []

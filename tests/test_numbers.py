from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from heddle.functions import hashing, numbers, values

decimals = st.builds(lambda s, d, e: f"{s}{d}e{e}", st.sampled_from(["", "-", "+"]), st.integers(0, 10**38 - 1), st.integers(-90, 80))


@given(decimals, decimals)
def test_sort_key_orders_as_numbers(a, b):
    x, y = numbers.sort_key(a), numbers.sort_key(b)
    assert len(x) == 41
    assert (x < y) == (Decimal(a) < Decimal(b))
    assert (x == y) == (Decimal(a) == Decimal(b))


@given(decimals)
def test_canonical_keeps_the_value(a):
    text = numbers.canonical(a)
    assert Decimal(text) == Decimal(a)
    assert numbers.canonical(text) == text
    assert numbers.from_sort_key(numbers.sort_key(a)) == text


@pytest.mark.parametrize("text", ["", "1 ", "1e", ".", "--1", "1" * 39, "1e126", "1e-131", "NaN"])
def test_bad_numbers(text):
    with pytest.raises(numbers.NumberError):
        numbers.canonical(text)


@pytest.mark.parametrize(("text", "plain"), [("1.0", "1"), ("-0", "0"), ("1e3", "1000"), ("0012.50", "12.5"), ("5e-3", "0.005"), (".5", "0.5")])
def test_canonical(text, plain):
    assert numbers.canonical(text) == plain


def test_exact_arithmetic():
    assert numbers.add("0.1", "0.2") == "0.3"
    assert numbers.add("9" * 38, "1", minus=True) == "9" * 37 + "8"
    with pytest.raises(numbers.NumberError):
        numbers.add("1e38", "0.1")


def test_sizes_and_equality():
    assert numbers.size("0") == 2 and numbers.size("-123") == 4
    assert values.item_size({"pk": {"S": "é"}, "n": {"N": "12"}, "l": {"L": [{"BOOL": True}]}}) == 2 + 2 + 1 + 2 + 1 + 3 + 1 + 1
    assert values.equal({"NS": ["1.0", "2"]}, {"NS": ["2", "1"]})
    assert not values.equal({"L": [{"N": "1"}, {"N": "2"}]}, {"L": [{"N": "2"}, {"N": "1"}]})
    assert values.size_of({"S": "é😀"}) == 3
    with pytest.raises(ValueError):
        values.check({"SS": ["a", "a"]})
    assert values.to_plain(values.from_plain({"a": [1, None, "x", True]})) == {"a": [1, None, "x", True]}


def test_prefix_bounds():
    assert hashing.prefix_upper_bound("ab") == "ac"
    assert hashing.prefix_upper_bound("a\U0010ffff") == "b"
    assert hashing.prefix_upper_bound(chr(0xD7FF)) == chr(0xE000)
    assert hashing.prefix_upper_bound("\U0010ffff") is None
    assert hashing.prefix_upper_bytes(b"a\xff") == b"b" and hashing.prefix_upper_bytes(b"\xff") is None
    assert hashing.fnv1a("") == 0x811C9DC5

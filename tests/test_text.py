from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandline.functions.text import checked_int, parse_gap, parse_region


@pytest.mark.parametrize(("text", "want"), [("ref:1-4", ("ref", 1, 4)), ("a:b:1,000-2,000", ("a:b", 1000, 2000)), ("ref#0#chr1:105-107", ("ref#0#chr1", 105, 107))])
def test_region(text, want):
    assert parse_region(text) == want


@pytest.mark.parametrize("text", ["ref", "ref:4-4", "ref:5-4", ":1-2", "ref:1", "ref:-1-2", "ref:a-b"])
def test_bad_region(text):
    with pytest.raises(ValueError):
        parse_region(text)


@pytest.mark.parametrize(("text", "want"), [(None, None), ("", None), ("0", 0), ("1bp", 1), ("1BP", 1), ("1KB", 1000), ("2mb", 2_000_000), ("1,000", 1000), ("3Gb", 3 * 10**9)])
def test_gap(text, want):
    assert parse_gap(text) == want


@pytest.mark.parametrize("text", ["1xb", "-1", "kb", "1.5kb", "99999999999999999999gb"])
def test_bad_gap(text):
    with pytest.raises(ValueError):
        parse_gap(text)


@given(st.integers(0, 2**63 - 1))
def test_checked_int(n):
    assert checked_int(str(n)) == n


@pytest.mark.parametrize("text", ["", "-1", "1x", " 1", "1 ", str(2**63), "٣"])
def test_bad_int(text):
    with pytest.raises(ValueError):
        checked_int(text)

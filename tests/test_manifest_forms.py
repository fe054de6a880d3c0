"""Forms of dependencies in a package manifest written in YAML."""

import pytest

from corvidex.sources.files import _apm


@pytest.mark.parametrize("text, want", [
    ("name: kit\nversion: 1\ndependencies:\n  - base\n", ("kit", "1", ["base"])),
    ("name: 'a b' # x\nversion: \"2.0\"\ndependencies:\n- owner/repo\n- \"x y\"\nother:\n  - z\n", ("a b", "2.0", ["owner/repo", "x y"])),
    ("name: k\ndependencies:\n  alpha: ^1\n  beta:\n    version: 2\n# no\n  gamma: '*'\n", ("k", None, ["alpha", "beta", "gamma"])),
    ("dependencies: [a, 'b']\nname: q", ("q", None, ["a", "b"])),
    ("dependencies: {a: 1, b: 2}", (None, None, ["a", "b"])),
    ("", (None, None, [])),
])
def test_forms(text, want):
    assert _apm(text) == want

from itertools import product
from string import ascii_lowercase as AZ

from accessloom.llm import pii


def test_lone_names_of_one_shape_have_surrogates_of_their_own():
    listed = [x for names in pii.NAMES.values() for x in names]
    assert len(listed) == len(set(listed))
    replacer = pii.Replacer(b"accessloom surrogate key of the test corpus")
    names = [f"{a.upper()}{b}{c}a" for a, b, c in product(AZ, AZ, AZ)]
    assert "Anna" in names and "anna" in listed
    seen = {}
    for x in names:
        assert seen.setdefault(replacer.family(x), x) == x

"""Sizes in titles, word by word."""

import pytest

from vetrina.functions import sizes


@pytest.mark.parametrize(
    ("text", "found", "rest"),
    [
        ("Giacca taglia: M/L blu", "M/L", "Giacca  blu"),
        ("Giacca taglia: S/M/lungo", "S/M", "Giacca /lungo"),
        ("Scarpa - 38,5", "38,5", "Scarpa"),
        ("Scarpa EU 42", "EU 42", "Scarpa"),
        ("Scarpa eu42", "eu42", "Scarpa"),
        ("Jeans W 32 L 34", "W 32 L 34", "Jeans"),
        ("Jeans misura - w32l34", "w32l34", "Jeans"),
        ("Polo XXL estate", None, "Polo  estate"),
        ("Berretto taglia unica Nero", None, "Berretto  Nero"),
        ("Guanti taglia unica", "taglia unica", "Guanti"),
        ("Foulard - One Size", "One Size", "Foulard"),
        ("Serie 3 07", None, "Serie 3 07"),
        ("Nike 97", None, "Nike 97"),
        ("Felpa 42 43", "43", "Felpa 42"),
        ("Taglia 42x", None, "Taglia 42x"),
        ("uk 16 uk 7", "uk 7", "uk 16"),
        ("42", None, "42"),
        ("", None, ""),
        ("x" * 5000 + " - 42", "42", "x" * 5000),
    ],
)
def test_sizes(text, found, rest):
    assert (sizes.find(text), sizes.strip(text)) == (found, rest)


def test_columns(one):
    assert one(sizes.found, ["Scarpa - 42", None, ""]) == ["42", None, None]
    assert one(sizes.stripped, ["Scarpa - 42", None]) == ["Scarpa", None]

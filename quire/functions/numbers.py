"""Page numbers in words and letters, as SQL text."""

from __future__ import annotations

# Roman numerals by decimal place.
ROMAN = [["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]]


def roman(n: str) -> str:
    """SQL: Roman numeral of n (thousands repeat M)."""
    digit = lambda row, power: f"element_at(array({', '.join(repr(x) for x in row)}), cast({n} div {power} % 10 as int) + 1)"
    return f"concat(repeat('M', cast({n} div 1000 as int)), {digit(ROMAN[2], 100)}, {digit(ROMAN[1], 10)}, {digit(ROMAN[0], 1)})"


def number_text(style: str, n: str) -> str:
    """SQL: a page number in a style: D decimal, R/r Roman to 100000, A/a letters to 2600 (27 is AA), others none; null out of range."""
    letters = f"repeat(char(65 + cast(({n} - 1) % 26 as int)), cast(({n} - 1) div 26 + 1 as int))"
    return (
        f"case {style} when 'D' then cast({n} as string) when 'R' then if({n} between 1 and 100000, {roman(n)}, null) when 'r' then if({n} between 1 and 100000, lower({roman(n)}), null)"
        f" when 'A' then if({n} between 1 and 2600, {letters}, null) when 'a' then if({n} between 1 and 2600, lower({letters}), null) else '' end"
    )

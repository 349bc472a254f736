"""strftime formats as Java date patterns."""

from __future__ import annotations

# A Java pattern for each directive.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD",
    "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "z": "xx", "e": "d",
}


def java_pattern(fmt: str) -> str:
    """`%Y-%m-%d` becomes `yyyy-MM-dd`; letters outside directives are quoted; `%.f` is a point and six digits."""
    out, i = "", 0
    while i < len(fmt):
        c = fmt[i]
        if c != "%":
            out += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
            i += 1
        elif fmt.startswith("%.f", i):
            out, i = out + ".SSSSSS", i + 3
        else:
            d = fmt[i + 1 : i + 2]
            if d == "%":
                out += "%"
            elif d in DIRECTIVES:
                out += DIRECTIVES[d]
            else:
                raise ValueError(f"unknown directive %{d}")
            i += 2
    return out

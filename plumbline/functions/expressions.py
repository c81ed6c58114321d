"""Scalar expressions as SQL text, all built from Spark's own functions."""

from __future__ import annotations

# How the words that read as a number begin (nan, infinity).
WORD_STARTS = "'nan', 'inf'"


def is_filled(text: str) -> str:
    return f"({text} is not null and {text} <> '')"


def is_numeric_text(text: str) -> str:
    """Whether a filled text casts to double.

    The look at the first characters changes no answer. It spares ordinary
    prose a failed parse, which costs far more than the look.
    """
    # Blanks and control characters, digits, plus, minus and point.
    first = f"ascii({text})"
    starts = f"{first} <= 32 or {first} between 48 and 57 or {first} in (43, 45, 46)"
    promising = f"{starts} or lower(substring({text}, 1, 3)) in ({WORD_STARTS})"
    parsed = f"case when {promising} then try_cast({text} as double) end"
    return f"({is_filled(text)} and {parsed} is not null)"


def fences(multiplier: float) -> tuple[str, str]:
    """Lower and upper, over columns ``q1`` and ``q3``."""
    reach = f"{float(multiplier)}D * (q3 - q1)"
    return f"(q1 - {reach})", f"(q3 + {reach})"


def outside(x: str, multiplier: float) -> str:
    """Strictly beyond the fences. NaN sorts above every number, so it counts."""
    lower, upper = fences(multiplier)
    return f"({x} < {lower} or {x} > {upper})"


def root_scale(x: str) -> str:
    """An integer scale that never decreases as ``x`` grows.

    Eight square roots squeeze the magnitude of any finite double into
    0.05 to 16.1, close to logarithmic, so 65,536 steps per unit give about
    180 to the octave around one and at most some two million in all. A square
    root is correctly rounded, so unlike a logarithm it keeps the order of its
    inputs exactly. Infinity gets a step of its own at the end.
    """
    magnitude = f"abs({x})"
    for _ in range(8):
        magnitude = f"sqrt({magnitude})"
    step = f"floor(least({magnitude}, 20D) * 65536D)"
    return f"case when {x} < 0 then -{step} else {step} end"

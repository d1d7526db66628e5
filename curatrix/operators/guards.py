"""Guards over arguments: each returns its value, or raises ValueError that names it."""

from __future__ import annotations

from collections.abc import Collection


def positive(name: str, value: int, least: int = 1) -> int:
    """A whole number of ``least`` or more."""
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be a whole number of {least} or more")
    return value


def fraction(name: str, value: float, open_low: bool = True, open_high: bool = True) -> float:
    """A share between 0 and 1; the ends belong to it unless they are open."""
    if not (value > 0 if open_low else value >= 0) or not (value < 1 if open_high else value <= 1):
        raise ValueError(f"{name} must be a share between 0 and 1")
    return value


def shares(name: str, values: dict[str, float], tolerance: float = 1e-9) -> dict[str, float]:
    """Shares of 0 or more that sum to 1."""
    if not values or min(values.values()) < 0 or abs(sum(values.values()) - 1) > tolerance:
        raise ValueError(f"{name} must be shares that sum to 1")
    return values


def one_of(name: str, value, allowed: Collection):
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(str, sorted(allowed)))}")
    return value


def consistent(name: str, wanted: dict, given: dict) -> None:
    """Both have the same keys, and the same value for each."""
    differ = sorted(k for k in {*wanted, *given} if wanted.get(k) != given.get(k) or (k in wanted) != (k in given))
    if differ:
        raise ValueError(f"{name} differs in {', '.join(map(str, differ))}")

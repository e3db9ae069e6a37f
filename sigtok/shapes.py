"""Shapes of JSON values: a declaration of what a value must look like, and one walk that finds what differs.

A dict is an object with exactly its keys, a tuple a list of exactly its entries; the rest are below.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from sigtok.errors import SigtokError


@dataclass(frozen=True)
class Whole:
    """An integer, bounds included; true and false are none."""

    low: int
    high: int


@dataclass(frozen=True)
class Number:
    """An integer or a fraction."""


@dataclass(frozen=True)
class Text:
    """A text of at most so many bytes of UTF-8; lone surrogates have no such bytes."""

    most: int


@dataclass(frozen=True)
class Equal:
    """One text and no other."""

    value: str


@dataclass(frozen=True)
class Many:
    """A list of entries of one shape, bounds of its length included."""

    of: Any
    least: int
    most: int


def _bytes(value: str) -> float:
    try:
        return len(value.encode())
    except UnicodeEncodeError:
        return float("inf")


def faults(value: Any, shape: Any, where: str) -> Iterator[str]:
    """What keeps ``value`` from its shape, place by place, in the order of the declaration."""
    inner: list[tuple[Any, Any, str]] = []
    match shape:
        case dict():
            ok, want = isinstance(value, dict) and set(value) == set(shape), f"an object with exactly the keys {sorted(shape)}"
            inner = [(value[k], s, f"{where}.{k}") for k, s in shape.items()] if ok else []
        case tuple():
            ok, want = isinstance(value, list) and len(value) == len(shape), f"a list of {len(shape)} entries"
            inner = [(v, s, f"{where}[{k}]") for k, (v, s) in enumerate(zip(value, shape, strict=True))] if ok else []
        case Many(of, least, most):
            ok, want = isinstance(value, list) and least <= len(value) <= most, f"a list of {least} to {most} entries"
            inner = [(v, of, f"{where}[{k}]") for k, v in enumerate(value)] if ok else []
        case Whole(low, high):
            ok, want = type(value) is int and low <= value <= high, f"an integer from {low} to {high}"
        case Number():
            ok, want = type(value) in (int, float), "a number"
        case Text(most):
            ok, want = isinstance(value, str) and _bytes(value) <= most, f"a text of at most {most} bytes of UTF-8"
        case Equal(text):
            ok, want = value == text, f"{text!r}"
        case _:
            raise TypeError(f"{shape!r} is no shape")
    if not ok:
        yield f"{where} must be {want}"
    for v, s, place in inner:
        yield from faults(v, s, place)


def checked(value: Any, shape: Any, where: str) -> Any:
    """``value``, if it has its shape."""
    for fault in faults(value, shape, where):
        raise SigtokError(fault)
    return value

"""Spans of text as `kind:start:end`, in code points with an exclusive end."""

from __future__ import annotations

import hashlib


def ordered(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """Spans by start, then by the order of `kinds`; equal spans once."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(set(spans), key=lambda s: (s[1], rank.get(s[0], len(rank)), s[2], s[0]))


def joined(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    """`kind:start:end`, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans, kinds))


def digest(text: str) -> str:
    """SHA-256 of a string in lowercase hex."""
    return hashlib.sha256(text.encode()).hexdigest()

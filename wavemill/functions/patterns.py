"""Patterns of differences between channels, as text: which others each channel is taken against."""

from __future__ import annotations

import re

Partners = dict[int, list[int]]


def _channel(text: str) -> int:
    if not re.fullmatch(r"[ \t]*[0-9]{1,7}[ \t]*", text):
        raise ValueError(f"{text!r} is no number of a channel")
    return int(text)


def pairs(text: str) -> Partners:
    """The partner of each channel from `a-b,c-d,...`: a tree whose one root, the last channel, is no pair's first. The root's partner is the first channel that has it as partner."""
    out: Partners = {}
    for token in filter(None, text.split(",")):
        first, dash, other = token.partition("-")
        if not dash:
            raise ValueError(f"{token!r} is no pair")
        a, b = _channel(first), _channel(other)
        if a == b or a in out:
            raise ValueError(f"channel {a} is its own partner or has two")
        out[a] = [b]
    if not out:
        raise ValueError("no pairs")
    root = max(max(out), *(b for (b,) in out.values()))
    if set(out) != set(range(root)):
        raise ValueError("every channel but the last has one partner, and the last has none")
    for a in out:
        seen = {a}
        while a != root:
            (a,) = out[a]
            if a in seen:
                raise ValueError(f"channel {a} is in a circle")
            seen.add(a)
    return out | {root: [min(a for a, (b,) in out.items() if b == root)]}


def sets(text: str) -> Partners:
    """The partners of each channel from `a-b+c,d-e,...`: every channel has some, none twice, and not itself."""
    out: Partners = {}
    for token in filter(None, text.split(",")):
        first, dash, others = token.partition("-")
        if not dash:
            raise ValueError(f"{token!r} is no set")
        a, partners = _channel(first), [_channel(t) for t in others.split("+")]
        if a in out or a in partners or len(set(partners)) < len(partners):
            raise ValueError(f"channel {a} comes twice or is among its own partners")
        out[a] = partners
    if not out:
        raise ValueError("no sets")
    if set(out) != set(range(1 + max([*out, *(b for own in out.values() for b in own)]))):
        raise ValueError("every channel has partners")
    return out


def partners(text: str) -> Partners:
    """Either form: sets where a channel has several partners, else a tree of pairs. For `functions.arrays.referenced`."""
    return sets(text) if "+" in text else pairs(text)


def by_group(text: str) -> list[Partners | None]:
    """One pattern for each group, between colons; None for an empty one."""
    return [partners(part) if part.strip(" \t") else None for part in text.split(":")]

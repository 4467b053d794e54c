"""Sources of several characters as one pattern: a trie of them, so that each place is matched once and the longest source wins."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.masks import class_of

END = ""


def trie(sources: Iterable[str]) -> dict:
    """Nested dictionaries by character; END marks where a source ends."""
    root: dict = {}
    for s in sources:
        node = root
        for c in s:
            node = node.setdefault(c, {})
        node[END] = {}
    return root


def pattern(node: dict) -> str:
    """A regular expression of a trie's sources; of two that match at a place, the longer one."""
    leaves = [c for c, child in node.items() if c != END and set(child) == {END}]
    parts = [class_of(leaves)] if leaves else []
    parts += [class_of([c]) + pattern(child) for c, child in sorted(node.items()) if c != END and set(child) != {END}]
    if not parts:
        return ""
    # what a further character makes longer is tried before what ends here
    return "(?:" + "|".join(parts[::-1]) + ")" + ("?" if END in node else "")


def replaced(c: Column, table: dict[str, str]) -> Column:
    """The text with every source of a table (one or more characters) replaced by its target, from left to right, in one pass; targets are
    not looked at again."""
    if not all(table):
        raise ValueError("a source must have a character")
    if not table:
        return c
    # entries are parted by a code point that is never assigned; a target's place is its source's
    keys = sorted(table)
    found = F.map_from_arrays(F.split(F.lit("\uffff".join(keys)), "\uffff"), F.split(F.lit("\uffff".join(table[k] for k in keys)), "\uffff"))
    first = class_of(k[0] for k in keys)
    whole = pattern(trie(keys))
    parts = F.regexp_extract_all(c, F.lit(rf"{whole}|[^{first[1:]}+|[\s\S]"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^{first}"), F.coalesce(F.try_element_at(found, x), x)).otherwise(x)), "")


def plain(text: str, table: dict[str, str]) -> str:
    """The same by a scan, for one string."""
    longest = max(map(len, table), default=0)
    out, k = "", 0
    while k < len(text):
        n = next((n for n in range(min(longest, len(text) - k), 0, -1) if text[k : k + n] in table), 0)
        out += table[text[k : k + n]] if n else text[k]
        k += n or 1
    return out


def alternatives(sources: Iterable[str]) -> str:
    """The sources one after the other, the longest first."""
    return "|".join(map(re.escape, sorted(sources, key=lambda s: (-len(s), s))))

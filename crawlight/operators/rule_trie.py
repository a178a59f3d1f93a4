"""Robots rules of one site as a prefix trie, and paths decided by one descent each.

A rule's literal start, up to its first wildcard, is its place in the trie.  A
literal rule holds wherever the descent comes by; one with wildcards is a leaf
whose rest is tried there.  Levels are kept by depth, and only depths at which
rules begin are visited, so a descent takes as many steps as there are
different lengths of literal starts, however many rules a site has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

#: (specificity, allow, minus line): the greatest decides.
Rank = tuple[int, bool, int]


def _regex(pattern: str) -> re.Pattern:
    body = pattern[:-1] if pattern.endswith("$") else pattern
    return re.compile(".*".join(map(re.escape, body.split("*"))) + ("$" if pattern.endswith("$") else ""))


class RuleTrie:
    """The rules of one set of groups."""

    def __init__(self) -> None:
        self.levels: dict[int, dict[str, list[tuple[Rank, str, re.Pattern | None]]]] = {}
        self.depths: list[int] = []

    def add(self, pattern: str, specificity: int, is_allow: bool, line: int) -> None:
        literal = re.match(r"[^*]*?(?=\*|\$$|$)", pattern, re.DOTALL).group()
        plain = literal == pattern
        leaves = self.levels.setdefault(len(literal), {}).setdefault(literal, [])
        rank = (specificity, is_allow, -line)
        if plain:
            # of literal rules at one place only the best can decide
            old = next((k for k, x in enumerate(leaves) if x[2] is None), None)
            if old is None:
                leaves.append((rank, pattern, None))
            elif rank > leaves[old][0]:
                leaves[old] = (rank, pattern, None)
        else:
            leaves.append((rank, pattern, _regex(pattern)))

    def ready(self) -> RuleTrie:
        self.depths = sorted(self.levels)
        return self

    def best(self, path: str) -> tuple[Rank, str] | None:
        out = None
        for depth in self.depths:
            if depth > len(path):
                break
            for rank, pattern, rest in self.levels[depth].get(path[:depth], ()):
                if (out is None or rank > out[0]) and (rest is None or rest.match(path)):
                    out = (rank, pattern)
        return out


DECIDED = "site string, path string, bot string, is_allow boolean, pattern string, crawl_delay double"


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (site, salt, kind): agents (0), rules (1), then paths (2), which are answered as they come.

    Columns: site, salt, kind, bot, group_id, line, is_allow, pattern, specificity, crawl_delay, path, octets.
    One site's rules are held at a time.
    """
    at, groups, delays, rules, tries = None, {}, {}, {}, None
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for site, salt, kind, bot, group, line, allow, pattern, size, delay, path, octets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (site, salt):
                at, groups, delays, rules, tries = (site, salt), {}, {}, {}, None
            if kind == 0:
                groups.setdefault(bot, set()).update(() if group is None else (group,))
                delays[bot] = delay
            elif kind == 1:
                rules.setdefault(group, []).append((pattern, size, allow, line))
            else:
                if tries is None:
                    made: dict[frozenset, RuleTrie] = {}
                    for own in map(frozenset, groups.values()):
                        if own not in made:
                            made[own] = RuleTrie()
                            for g in own:
                                for rule in rules.get(g, ()):
                                    made[own].add(*rule)
                            made[own].ready()
                    tries = [(bot, made[frozenset(own)]) for bot, own in groups.items()]
                answers: dict[int, tuple | None] = {}
                for bot, trie in tries:
                    if id(trie) not in answers:
                        answers[id(trie)] = trie.best(octets)
                    found = answers[id(trie)]
                    for column, value in zip(out, (site, path, bot, found and found[0][1], found and found[1], delays[bot]), strict=True):
                        column.append(value)
        kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["site", "path", "bot", "is_allow", "pattern", "crawl_delay"])

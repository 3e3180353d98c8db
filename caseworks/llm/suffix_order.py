"""Suffix sorting by linear grouping.

Suffixes are grouped by their Lyndon prefix: groups start as first symbols and are taken in descending order; each
suffix of the group at hand extends its previous smaller suffix (the nearest one to the left in a lower group) by the
group's prefix, which moves that one up inside its own range. When all groups are final, the order inside each comes
from one ascending sweep: a placed suffix places those whose Lyndon prefix ends where it begins. No renaming, no
recursion.
"""

from __future__ import annotations


def suffix_order(symbols: list[int]) -> list[int]:
    """Starts of all suffixes in ascending order. Symbols are any integers; a shorter suffix precedes its extensions."""
    n = len(symbols)
    if not n:
        return []
    # a sentinel below every symbol ends the text
    low = min(symbols) - 1
    text = [*symbols, low]
    n += 1
    members: dict[int, list[int]] = {}
    for symbol in sorted(set(text)):
        members[symbol] = []
    for i, symbol in enumerate(text):
        members[symbol].append(i)
    groups: list[list[int]] = [[]] * n  # by the group's first place in the order
    last = [0] * n
    first = [0] * n  # of a group by its last place
    group = [0] * n
    at = 0
    for suffixes in members.values():
        groups[at], last[at], first[at + len(suffixes) - 1] = suffixes, at + len(suffixes) - 1, at
        for i in suffixes:
            group[i] = at
        at += len(suffixes)
    length = [1] * n  # of the Lyndon prefixes
    smaller = [-1] * n  # previous smaller suffix, once the group is done

    end = n - 1
    while end > 0:
        g = first[end]
        own = [i for i in groups[g] if group[i] == g] if len(groups[g]) != end - g + 1 else groups[g]
        size = length[own[0]]
        if len(own) == 1:  # as a rule; the general case below, for one child of one parent
            i = own[0]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                length[j] += size
                h = group[j]
                top = last[h]
                if top > h:
                    groups[top], last[top], first[top] = [j], top, top
                    last[h] = top - 1
                    first[top - 1] = h
                    group[j] = top
            end = g - 1
            continue
        # children per previous smaller suffix; both lists ascend
        parents: list[int] = []
        counts: list[int] = []
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                if parents and parents[-1] == j:
                    counts[-1] += 1
                else:
                    parents.append(j)
                    counts.append(1)
        if parents:
            by_count: dict[int, dict[int, list[int]]] = {}
            for j, c in zip(parents, counts, strict=True):
                by_count.setdefault(c, {}).setdefault(group[j], []).append(j)
            for c in sorted(by_count, reverse=True):
                for h, moved in by_count[c].items():
                    top = last[h]
                    start = top - len(moved) + 1
                    for j in moved:
                        length[j] += c * size
                    if start == h:  # the whole group grows
                        continue
                    groups[start], last[start], first[top] = moved, top, start
                    last[h] = start - 1
                    first[start - 1] = h
                    for j in moved:
                        group[j] = start
        end = g - 1

    ends_at: list[list[int] | None] = [None] * (n + 1)
    for i in range(n):
        k = i + length[i]
        if ends_at[k] is None:
            ends_at[k] = [i]
        else:
            ends_at[k].append(i)
    order = [0] * n
    free = list(range(n))  # next free place of a group, by its first place
    order[0] = n - 1
    for r in range(n):
        for i in ends_at[order[r]] or ():
            g = group[i]
            order[free[g]] = i
            free[g] += 1
    return order[1:]

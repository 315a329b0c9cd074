"""The interval tree of repeats: linear in the copies, and covering what brute force covers."""

import random

import numpy as np
import pytest

from girderframe.llm import suffix_dedup


def near_copies(count, seed=1):
    """Contexts of one passage that differ at both ends, as they come from near copies."""
    rng = random.Random(seed)
    core = "".join(rng.choice("abcdefgh") for _ in range(110))
    return [("".join(rng.choice("xyz") for _ in range(rng.randint(0, 20))) + core + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 20)))).encode() for _ in range(count)]


def test_rows_grow_with_the_copies_not_with_their_square():
    sizes = {}
    for count in (25, 50, 100):
        texts = near_copies(count)
        tree = suffix_dedup.interval_tree(texts, np.zeros(count, int), 100)
        suffixes = sum(len(t) - 99 for t in texts)
        assert len(tree.members) <= suffixes and len(tree.covered) <= suffixes and len(tree.length) < suffixes
        joined = suffix_dedup._joined([(t, s, n) for t, s, n in tree.covered])
        sizes[count] = len(joined)
        # At most one joined span for each context, and the first one is not covered.
        assert len(joined) <= count
    assert sizes[100] <= 2 * sizes[50] + 2 <= 4 * sizes[25] + 6


def test_groups_nest_and_members_stand_once():
    texts = near_copies(40)
    tree = suffix_dedup.interval_tree(texts, np.zeros(40, int), 100)
    assert len({(t, s) for t, s, _ in tree.members}) == len(tree.members)
    for k, parent in enumerate(tree.parent):
        assert parent == -1 or tree.length[parent] < tree.length[k]


@pytest.mark.parametrize("seed", range(8))
def test_covered_bytes_equal_brute_force(seed):
    """Texts over two letters, in several groups, with places that are not in the order of the texts."""
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 50))).encode() for _ in range(12)]
    group = np.array([k % 3 for k in range(12)])
    order = list(range(12))
    rng.shuffle(order)
    origin = [(order[k], rng.randint(0, 5)) for k in range(12)]
    least = 5
    tree = suffix_dedup.interval_tree(texts, group, least, origin)
    got = {(t, b) for t, s, n in tree.covered for b in range(s, s + n)}
    want = set()
    for g in range(3):
        mine = [k for k in range(12) if group[k] == g]
        first = {}
        for k in mine:
            for s in range(len(texts[k]) - least + 1):
                piece, place = texts[k][s : s + least], (origin[k][0], origin[k][1] + s)
                first[piece] = min(first.get(piece, place), place)
        for k in mine:
            for s in range(len(texts[k]) - least + 1):
                if (origin[k][0], origin[k][1] + s) != first[texts[k][s : s + least]]:
                    want |= {(k, b) for b in range(s, s + least)}
    assert got == want

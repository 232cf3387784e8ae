"""Recall of the decontamination search by item length, and texts that begin inside an item."""

import pickle
import random

import pytest

from quirework.llm import decontaminate

_rng = random.Random(7)
VOCABULARY = ["".join(_rng.choice("abcdefghijklmnop") for _ in range(_rng.randrange(2, 9))) for _ in range(5000)]


def _prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def _at(w, i, new, drop=1):
    return w[:i] + new + w[i + drop :]


def _characters(rng, w, rate):
    """Characters replaced, left out and added, spaces too."""
    out = []
    for c in " ".join(w):
        kind = rng.randrange(3) if rng.random() < rate else 3
        out.append(("" if kind == 1 else c) if kind else rng.choice("abcdefghijklmnop "))
        out.append(rng.choice("abcdefghijklmnop") if kind == 2 else "")
    return "".join(out).split()


EDITS = {
    "one replaced": lambda rng, w: _at(w, rng.randrange(len(w)), _prose(rng, 1)),
    "first replaced": lambda rng, w: _at(w, 0, _prose(rng, 1)),
    "first left out": lambda rng, w: w[1:],
    "one added": lambda rng, w: _at(w, rng.randrange(1, len(w)), _prose(rng, 1), 0),
    "one left out": lambda rng, w: _at(w, rng.randrange(len(w)), []),
    "2 % of characters": lambda rng, w: _characters(rng, w, 0.02),
    "6 % of characters": lambda rng, w: _characters(rng, w, 0.06),
    "10 % of characters": lambda rng, w: _characters(rng, w, 0.1),
    "15 % of characters": lambda rng, w: _characters(rng, w, 0.15),
    "19 % of characters": lambda rng, w: _characters(rng, w, 0.19),
    "10 % replaced": lambda rng, w: [rng.choice(VOCABULARY) if rng.random() < 0.1 else x for x in w],
}


@pytest.mark.parametrize("words", [5, 6, 8, 11, 12, 13, 16, 18, 24, 45, 59])
def test_recall_by_item_length(words):
    rng = random.Random(words)
    items = [_prose(rng, words) for _ in range(60)]
    s = decontaminate.Searcher([(i, " ".join(w)) for i, w in enumerate(items)])
    for name, edit in EDITS.items():
        texts = [" ".join(_prose(rng, 20) + edit(rng, w) + _prose(rng, 20)) for w in items]
        want = {i for i, t in enumerate(texts) if decontaminate.best_substring(s.texts[i], t)[0] <= 0.2 * len(s.texts[i]) + 1e-9}
        got = {d for d, k, *_ in s.search(texts) if d == k}
        assert len(want) > 25 and len(want & got) >= decontaminate.RECALL * len(want), (name, len(want & got), len(want))


def test_texts_that_begin_or_end_inside_an_item_whatever_their_neighbours():
    rng = random.Random(3)
    items = [_prose(rng, n) for n in (38, 30, 20)]
    s = decontaminate.Searcher([(i, " ".join(w)) for i, w in enumerate(items)])
    cut = {i: [" ".join(w[len(w) // 8 :] + _prose(rng, 30)), " ".join(_prose(rng, 30) + w[: -(len(w) // 8)])] for i, w in enumerate(items)}
    for i, texts in cut.items():
        for t in texts:
            assert decontaminate.best_substring(s.texts[i], t)[0] <= 0.2 * len(s.texts[i])
            alone = s.search([t])
            assert [k for _, k, *_ in alone] == [i]
            for before in ("", "one", " ".join(_prose(rng, 200)), " ".join(items[i])):
                assert [h[1:] for h in s.search([before, t, before]) if h[0] == 1] == [h[1:] for h in alone]


def test_short_items_are_found_as_whole_words():
    s = decontaminate.Searcher([(0, "Yes, no."), (1, "x"), (2, "tell me why"), (3, "日本語"), (4, "a b")])
    texts = ["well yes no!", "yes nobody", "x", "xx", "TELL me -- why", None, "私は日本語を話す", "", "ab", "they tell me", "a  b"]
    assert [(d, k, dist) for d, k, dist, *_ in s.search(texts)] == [(0, 0, 0), (2, 1, 0), (4, 2, 0), (6, 3, 0), (10, 4, 0)]
    [(_, _, _, _, a, b)] = s.search(["well, Yes - no!"])
    assert (a, b) == (6, 14)


def test_scripts_without_spaces():
    rng = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    items = ["".join(rng.choice(letters) for _ in range(n)) for n in (24, 60, 200) for _ in range(20)]
    s = decontaminate.Searcher(list(enumerate(items)))
    texts = ["".join(rng.choice(letters) for _ in range(50)) + "".join(rng.choice(letters) if rng.random() < 0.08 else c for c in t) + "。" for t in items]
    want = {i for i, t in enumerate(texts) if decontaminate.best_substring(items[i], t)[0] <= 0.2 * len(items[i])}
    got = {d for d, k, *_ in s.search(texts) if d == k}
    assert got <= want and len(got) >= decontaminate.RECALL * len(want) > 40


def test_what_is_sent_is_bounded():
    rng = random.Random(8)
    items, size = [], 0
    while size < 1 << 20:
        items.append((len(items), " ".join(_prose(rng, rng.randrange(5, 60)))))
        size += len(items[-1][1])
    assert len(pickle.dumps(decontaminate.Searcher(items))) < 50 << 20


def test_all_texts_as_in_brute_force():
    """Every pair within the threshold of a table of edited, cut, repeated and empty texts, whatever the batch."""
    rng = random.Random(9)
    items = [_prose(rng, rng.randrange(5, 30)) for _ in range(25)]
    s = decontaminate.Searcher([(i, " ".join(w)) for i, w in enumerate(items)])
    texts = [None, "", " \n"] + [" ".join(_prose(rng, rng.randrange(15)) + _characters(rng, w, rng.random() / 4) + _prose(rng, rng.randrange(15))) for w in items for _ in range(3)]
    want = {}
    for d, t in enumerate(texts):
        normal = " ".join(decontaminate.words_of(t or ""))
        for k, item in enumerate(s.texts):
            distance = decontaminate.best_substring(item, normal)[0]
            if distance <= 0.2 * len(item) + 1e-9:
                want[d, k] = distance
    got = {(d, k): distance for d, k, distance, *_ in s.search(texts)}
    assert set(got) <= set(want) and len(got) >= decontaminate.RECALL * len(want) > 30
    assert sum(got[p] == want[p] for p in got) >= 0.95 * len(got)
    again = {(d, k): distance for d in range(len(texts)) for _, k, distance, *_ in s.search([texts[d]])}
    assert again == got

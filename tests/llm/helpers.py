"""Small texts and brute-force versions."""

import itertools
import random

from tracewell.llm.words import words

WORDS = "let the point line circle centre meet turn mirror corner side through from about angle half draw put where a b c d e f g h i j k l m n o p q".split()


def sentence(rng, n=9):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def scene(rng, n=6):
    return " ".join(sentence(rng) for _ in range(n))


def edited(rng, text, share=0.06):
    ws = [rng.choice(WORDS) if rng.random() < share else w for w in text.split()]
    if rng.random() < 0.4:
        parts = " ".join(ws).split(". ")
        rng.shuffle(parts)
        return ". ".join(parts)
    return " ".join(ws)


def triple_set(text):
    w = words(text)
    return set(zip(w, w[1:], w[2:]))


def near(a, b):
    x, y = triple_set(a), triple_set(b)
    return bool(x & y) and 2 * len(x & y) >= len(x | y)


def corpus(seed=1, bases=30, copies=4):
    """[(id, text)] of scenes, edited copies, exact copies, and nulls, blanks and short texts."""
    rng = random.Random(seed)
    rows, n = [], 100
    for _ in range(bases):
        base = scene(rng, rng.randint(2, 7))
        for k in range(rng.randint(1, copies)):
            rows.append((n, base if k == 0 or rng.random() < 0.2 else edited(rng, base, rng.choice((0.02, 0.06, 0.12)))))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "  \t"), (n + 3, "two words"), (n + 4, "two words"), (n + 5, "!!! …")]
    return rows


def near_pairs(rows):
    return {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(rows, 2) if x and y and near(x, y)}


def groups(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {(top(x), x) for x in list(up)}

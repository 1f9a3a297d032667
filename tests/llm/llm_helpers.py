"""Helpers of these tests."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "a", "ing", "x1"]) for _ in range(n))


def by_id(df, *cols):
    """Rows as tuples in a fixed order; nulls first."""
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: [(x is not None, str(type(x)), x if x is not None else 0) for x in t])

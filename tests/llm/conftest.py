from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def words():
    """Invented words by number, the same in every run."""

    def make(seed: int, n: int) -> list[str]:
        state, out = seed * 7919 + 17, []
        for _ in range(n):
            state = (state * 1103515245 + 12345) % (1 << 31)
            out.append("".join("bcdfgklmnprstv"[(state >> s) % 14] + "aeiou"[(state >> (s + 3)) % 5] for s in (3, 9, 15)))
        return out

    return make

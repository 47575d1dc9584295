"""Invented words."""

import random


def words(seed, n):
    chosen = random.Random(seed)
    syllables = ["an", "ber", "cho", "du", "eli", "fo", "gra", "hin"]
    return ["".join(chosen.choice(syllables) for _ in range(chosen.randint(1, 4))) for _ in range(n)]

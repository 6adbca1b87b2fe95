"""Invented text."""


def words(rng, n, stem="abcdefgh"):
    return " ".join("".join(rng.choice(stem) for _ in range(rng.randint(2, 6))) for _ in range(n))

"""Invented text for the tests of this folder."""

SYLLABLES = "ba be bi do da du ka ke ki lo la lu mo ma mi no na ni po pa pi ro ra ri so sa si to ta ti".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, share):
    return " ".join(prose(rng, 1) if rng.random() < share else w for w in text.split())

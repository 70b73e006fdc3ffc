"""Invented prose for the tests of this folder."""

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if (x >> 16) % 5 else str((x >> 8) % 97)))
        if i % 9 == 8:
            out[-1] += "."
        if i % 27 == 26:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")

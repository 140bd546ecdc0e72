"""Texts shared by the tests of this folder."""

import random

WORDS = ("river stone garden window market paper silver morning bridge harbour letter candle forest "
         "mountain copper valley signal engine pocket ribbon summer shadow velvet thunder").split()


def prose(seed, n):
    """``n`` words of invented prose in sentences and lines."""
    draw = random.Random(seed)
    out = []
    for k in range(n):
        word = draw.choice(WORDS) + draw.choice(["", "s", "ed", "ing", "er", "ly"]) + draw.choice(WORDS)[:3]
        out.append(word + (". " if k % 9 == 8 else "\n" if k % 31 == 30 else " "))
    return "".join(out).strip()


AWKWARD = [None, "", "   \n\t ", "a", "word " * 3000, "é ü ß 日本 😀", "x\n\nx\n\nx", "<|endoftext|> a<|endoftext|>",
           "''' it's  we'll\r\n\x0b", "1" * 5000, "　", "# $ % & | < >", "The The The The The The"]

"""Made prose in two languages."""

import random

ENGLISH = "the house and garden were quiet that evening while a small dog slept under the old table near our door".split()
GERMAN = "der Hund schläft unter dem alten Tisch und das kleine Haus steht ruhig neben einer Straße mit vielen Bäumen".split()


def prose(words, many, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice(words) for _ in range(many)) + "."

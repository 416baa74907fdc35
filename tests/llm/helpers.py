"""Small document tables with every awkward case."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)).capitalize() + "."


def prose(rng: random.Random, sentences: int) -> str:
    return " ".join(sentence(rng, rng.randrange(3, 12)) for _ in range(sentences))


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, sequence_id string, component string"


def frame(spark, texts, sources=None, langs=None):
    """Documents with columns whose names clash with the operators' own."""
    rows = [
        (i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "s0"), len(t) if t is not None else None, "k", "q", "c")
        for i, t in (texts.items() if isinstance(texts, dict) else texts)
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


def awkward(rng: random.Random) -> dict[int, str | None]:
    return {900: None, 901: "", 902: " \n\t ", 903: "x", 904: prose(rng, 4000), 905: "ü" * 3000, 906: "!!! ...", 907: "<|endoftext|> a", 908: "a b c"}

"""Rows with the awkward cases that every operator has to take."""

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def awkward(seed=1, n=60):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "Delta,", "été", "straße.", "x1", "under", "the", "MIT", "license"]
    texts = [None, "", " \t\n", "one", "Ünï çödé", "|#|", "a\x1cb", "very long " * 4000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    rows = [
        (i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s0", "s1", "ß", "", None]), len(t or ""), "12", None)
        for i, t in enumerate(texts)
    ]
    return [*rows, rows[9], rows[9], rows[2], (None, texts[10], None, None, None, None, None), (None, None, None, None, None, None, None)]

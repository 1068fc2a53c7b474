"""Tables with everything that may be wrong with a table."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int = 80) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice("aeiou") * r.randint(0, 2)) + str(r.randint(0, 9)) * 0 for _ in range(n)) + "."


#: Columns that operators use themselves, as columns of the input.
EXTRA = "fp string, bucket string, kept string, component_id string, host string, path string, n_words string, `a b` string"


def odd_documents(spark, more=()):
    """Null columns, empty and blank texts, a very long one, repeated rows, one id with two texts, clashing names."""
    rows = [
        (1, prose(1), "en", "s0", 10), (1, prose(1), "en", "s0", 10), (2, prose(1), "de", "s0", 10), (3, "", "en", "s0", 0), (4, None, "en", "s0", None),
        (None, prose(2), None, None, None), (None, None, None, None, None), (5, " \n\t ", "en", None, 4), (6, prose(3, 30_000), "en", "s1", 9), (7, prose(4), None, "s1", 1),
        (7, prose(5), "en", "s1", 1), (8, "x", "en", "s1", 1), *more,
    ]
    full = [(*r, *["?"] * 8) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


def no_documents(spark):
    return odd_documents(spark).where("false")

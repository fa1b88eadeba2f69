import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()


def prose(n, start=0, step=7):
    """Text of n words without long repeats."""
    return " ".join(f"{WORDS[(start + i * step) % 16]}{start + i}" for i in range(n))


@pytest.fixture
def odd(spark):
    """Null, empty, repeated, signs only, very long, and columns whose names may clash."""
    long_text = "\n".join(prose(300, 1000 * k) for k in range(30))
    rows = [
        (1, "Plain words stand here. They end.", "en", "s1", 1, "x"),
        (1, "Plain words stand here. They end.", "en", "s1", 1, "x"),
        (2, None, None, None, None, None),
        (None, "No id here, but some words.", "en", "s2", 2, "y"),
        (3, "", "de", "s3", 3, "z"),
        (4, " \n\t ... !!! \r\n", None, "s4", 4, "w"),
        (5, long_text, "en", "s5", 5, "v"),
        (6, "Ünïcødé ß \U0001F600 İstanbul ΑΣ.\x1ca b", "de", None, 6, None),
    ]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, sequence_id string"
    )
    return spark.createDataFrame(rows, schema)

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("th", "er", "on", "qu", "sch", "ca", "lo", "mi", "ra", "ve") for b in ("a", "e", "ion", "or", "un", "ist", "et", "al")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty and long texts, copies, near copies and repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 30, 60, 200, 900, 4000)]
    near = [base[3].replace(" ", "  ", 3), " ".join(base[3].split()[:-3]), base[4] + " tail", base[2].upper()]
    shared = prose(rng, 90)
    texts = [*base, *near, base[3], base[3], "", None, "   \n\t", "12 !! 34", prose(rng, 40) + " " + shared, shared + " " + prose(rng, 50), "x" * 1500, "a\nb\na\n" * 90]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[1], None, None, None), (900, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).selectExpr("*", "1 as size", "'x' as label", "doc_id as node", "0 as shard").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

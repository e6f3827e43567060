import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(WORDS)[:3] for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Texts that every operator must take: null, empty, blank, repeated, near copies, very long, non-Latin, with a null id."""
    a, b = prose(1, 80), prose(2, 80)
    return [
        (1, a), (2, a), (2, a), (3, a.upper()), (4, a.replace(" ", "  ", 3)), (5, b), (6, b + " extra"), (7, None), (8, ""), (9, " \t\n "),
        (10, prose(3, 30_000)), (11, "x" * 50_000), (12, "短い文 です。 emoji 🤗 ok"), (13, "one"), (14, a + "\n" + b + "\n" + a), (None, b), (15, None),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The edge rows with extra columns whose names clash with those the operators use inside."""
    rows = [(i, t, "en", "s", 1, "c", 2.0, 3, "g") for i, t in edge_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id long, row string, score double, fp long, component_id string")


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
COPY = " ".join(f"shared{i}" for i in range(60))
ITEM = "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with nulls, empty and long texts, ties, repeated rows and near copies."""
    rows = [
        (1, COPY + "\nAn end of its own."), (2, COPY + "\nAnother end."), (3, "Before it. " + COPY), (4, COPY), (5, COPY),
        (5, COPY), (6, None), (7, ""), (8, " \n\t\n"), (9, LONG), (10, LONG + " more"), (11, "one"), (12, "One"),
        (13, "a b c"), (14, "Ünï ÉTÉ ünï 漢字 😀 text"), (None, "no id at all here"), (15, f"x {ITEM}, and so on"),
        (16, ITEM.lower().replace(" ", " - ")), (17, "x " * 300 + "alpha beta"), (18, "short item. Short Item"), (19, "same id"), (19, "other text"),
    ]
    rows += [(100 + i, f"  Repeated LINE \nown line {i} of {i * 7}\nrepeated line\x0b") for i in range(12)]
    near = [f"near{i}" for i in range(80)]
    for j in range(6):
        own = list(near)
        own[j * 11] = f"changed{j}"
        rows.append((200 + j, " ".join(own)))
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with further columns of names that operators use themselves."""
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, "x", 2.0, "y") for i, t in texts]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, _k int, _t string, score double, row string").repartition(5)


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame(
        [(1, ITEM), (2, "Short item"), (3, None), (4, ""), (5, "never seen words of an item"), (10, ITEM + " rho"), (2, "Short item"), (7, "!!")],
        "item_id long, text string")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)

import random

import pytest


@pytest.fixture(scope="session")
def mixed_rows():
    """Documents with shared passages, near copies, copies, odd texts and repeated rows."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage, base, rows = text(60), text(120), []
    for i in range(40):
        own = text(rnd.randrange(5, 150))
        if i % 4 == 0:
            at = rnd.randrange(len(own))
            own[at:at] = passage[rnd.randrange(5) :]
        if i % 5 == 0:
            own = list(base)
            for _ in range(rnd.randrange(0, 5)):
                own[rnd.randrange(len(own))] = "X" + rnd.choice(vocabulary)
        rows.append((1000 - 7 * i, " ".join(own)))
    rows += [
        (3000, rows[3][1]), (3001, rows[3][1]), (3, rows[4][1]),  # copies
        (rows[5][0], rows[5][1]), (rows[6][0], "another text under a known id"),  # repeated ids
        (4000, None), (4001, ""), (4002, " \t\n "), (None, rows[7][1]), (None, None),
        (4003, "one"), (4004, "One two three"), (4005, "one"),
        (4006, "\tTabs  and\n\nlines " + " ".join(passage) + "  end "),
        (4007, "ünï çödé " * 30), (4008, "Ünï çödé " * 30), (4009, "a" * 5000 + " b" * 20),
        (4010, " ".join(text(30_000))), (4011, " ".join(base[:80] + passage)),
    ]
    return rows


@pytest.fixture(scope="session")
def mixed(spark, mixed_rows):
    """The same as a table, with further columns that clash with names the operators use."""
    extra = "key long, grams array<long>, n long, spans string, words string, hits int, region int"
    rows = [(i, t, None, [1], 2, "x", None, 4, 5) for i, t in mixed_rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

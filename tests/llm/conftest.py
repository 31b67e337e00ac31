import random

import pytest

WORDS = {
    "en": "the of and that with have this from they will would there their what about which when make like time".split(),
    "de": "der die und das nicht von sie ist des sich mit dem dass er es ein ich auf so eine auch als an".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le".split(),
}
EXTRA = "id a b h k n p size guest row line site bucket score text_key source_key copies gone_at lang_pred".split()


def prose(r: random.Random, lang: str, n: int) -> str:
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeats, clashing extra columns."""
    r = random.Random(5)
    shared = prose(r, "en", 70)
    rows = [
        (1, prose(r, "en", 80) + " " + shared, "en", "s1"),
        (2, prose(r, "en", 60) + " " + shared, "en", "s2"),
        (3, None, "en", "s1"),
        (4, "", "de", "s1"),
        (5, "   \n\t ", "de", None),
        (6, prose(r, "de", 40), None, None),
        (7, "einzeln", "de", "s3"),
        (8, prose(r, "es", 30_000), "es", "s3"),
        (9, prose(r, "es", 90), "es", "s3"),
        (9, prose(r, "es", 95), "es", "s3"),
        (10, "same text in two rows of one id " * 8, "en", "s1"),
        (10, "same text in two rows of one id " * 8, "en", "s1"),
        (11, "same text in two rows of one id " * 8, "en", "s2"),
        (None, prose(r, "en", 30), "en", "s2"),
        (None, None, None, None),
    ]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    own = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], columns)
    return own.selectExpr("*", *[f"'x' AS {c}" for c in EXTRA]).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "keep boolean, start string, `end` int, node string, grp int, piece string, total int, rest int, item_id string, word string, kind string, n int, slot int, grams string, component int, gone_doc_id bigint, flagged_doc_id bigint"


def prose(rng, n):
    words = "alpha beta gamma delta river stone cloud winter summer green quick brown the and of to in is that for".split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "s", "ing"]) for _ in range(n)) + "."


@pytest.fixture
def make_docs(spark):
    def make(texts, clashing=False):
        """texts: strings (numbered from 0) or (doc_id, text)."""
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        docs = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA)
        if clashing:
            for field in CLASHING.split(", "):
                name, kind = field.replace("`", "").split()
                docs = docs.selectExpr("*", f"cast(null as {kind}) as `{name}`")
        return docs

    return make


@pytest.fixture
def odd_texts():
    """Nulls, empty and blank texts, repeated rows, ties, a null id, one long text, other scripts."""
    rng = random.Random(4)
    long = prose(rng, 60_000)
    return [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "two words"), (None, prose(rng, 30)), (5, long), (6, "ÀÉ ß 漢字 🙂 текст"), (7, prose(rng, 50)), (7, prose(rng, 51)), (8, "same text here now"), (8, "same text here now"), (9, "same text here now"), (None, None)]


def rows(df, *columns):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


@pytest.fixture
def collected():
    return rows

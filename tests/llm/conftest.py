import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


def text_of(seed: int, n: int, vocabulary: int = 900) -> str:
    """A repeatable text of n pseudo-words in lines of about ten."""
    import random
    r = random.Random(seed)
    w = [f"w{r.randrange(vocabulary)}x" for _ in range(n)]
    return "\n".join(" ".join(w[i:i + 10]) + "." for i in range(0, n, 10))

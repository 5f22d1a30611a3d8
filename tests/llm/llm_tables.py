"""Small tables with the cases every operator must stand."""
import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rep string, kept int, score string, bucket string"


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(n))


def edge_rows():
    """Null id, null text, empty, blank, one word, repeated rows, a very long text."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    rows = [(None, "a row without an id has text"), (None, "a row without an id has text"), (1, None), (2, ""), (3, " \t\n "), (4, "word"),
            (5, "the same row twice over and over"), (5, "the same row twice over and over"), (6, long), (7, "😀 naïve ﬁ Straße ÀÉ́"),
            (8, "1234 ... !!! ###"), (9, "x" * 5000)]
    return [(i, t, None, None, None, "r", 1, "s", "b") for i, t in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def docs(spark, texts, lang=None):
    """Documents 100, 101, ... of the given texts."""
    return frame(spark, [(100 + i, t, lang, "s", len(t or ""), "r", 1, "s", "b") for i, t in enumerate(texts)])


def rows(df):
    return [tuple(r) for r in df.collect()]

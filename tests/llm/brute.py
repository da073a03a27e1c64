"""Plain versions of what the operators compute, and small awkward tables."""

import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0D]+")

#: Nulls, empty and blank texts, ties, repeated rows, a very long text and columns whose names clash with results.
ROWS = [
    (0, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 10),
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "b", 4),
    (4, "one", "en", "b", 3),
    (5, "same text here with some words in it for all of them to see", "en", "c", 1),
    (6, "same text here with some words in it for all of them to see", "en", "c", 1),
    (6, "same text here with some words in it for all of them to see", "en", "c", 1),
    (None, "a row without an id but with some words", "en", None, 1),
    (7, "long " * 30_000 + "end", "en", "a", 150_003),
    (8, "line one two three\nline one two three\nline one two three\nline one two three", "en", "d", 5),
    (9, "É ünïcode\x0b\x0cwörds   stay together 東京 and 😀 emoji too, mail me at a.b@c.de or 10.1.2.3 or +1 (559) 555-3817", "fr", "d", 7),
    (10, "mail a.b@c.de, card 4539 1488 0343 6467 and 1.2.3.4.5.6.7.8", "en", "d", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, tmp_path, rows=None, extra=True):
    """A folder with documents as one table; with columns named like results of the queries."""
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    if extra:
        for c in ("size", "shard", "slot", "kept", "score", "fingerprint", "component_id", "target", "taken", "bucket", "n", "h", "words", "sequence_id", "piece", "before"):
            df = df.selectExpr("*", f"'x' AS {c}")
    df.coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def words(text):
    return WORD.findall(text or "")


def repeated_words(ws, k=5):
    seen = Counter(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    hit = set()
    for i in range(len(ws) - k + 1):
        if seen[tuple(ws[i:i + k])] > 1:
            hit.update(range(i, i + k))
    return len(hit)


def water_fill(sizes, weights, share=1.5, most=2.0):
    """Targets by repeated resharing."""
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = share * sum(sizes.values()), set(sizes)
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        give = {s: left * weights[s] / w for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += give[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target

"""Rows for the tests of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for columns of their own.
CLASHING = ("size", "key", "id", "fp", "sig", "shard", "slot", "rank", "label", "idx", "target", "ids", "spans", "kept")


def words(text):
    return WORD.findall(text or "")


def edge_rows():
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(k % 97) for k in range(30_000))
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", None, 4),
        (4, long, "en", "b", len(long)),
        (5, "x" * 50_000, None, "b", 50_000),
        (6, "one two three four", "de", "a", 18),
        (6, "one two three four", "de", "a", 18),
        (7, "one two three four", "de", "c", 18),
        (None, "a row without an id, but with enough words to count as a text", "en", "c", 60),
        (8, "Write to ann@mail.example.com or +1 (415) 555-2671, card 4111 1111 1111 1111, host 10.0.0.1.", None, None, 90),
        (9, "Ünïcode wörds and 漢字 and emoji 😀 in a text of several words here", "de", "z", 60),
    ]
    return rows

"""Small corpora with the awkward cases, and plain versions of what operators compute."""

import random
import re

BLANK = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def words(text):
    return BLANK.findall(lowered(text))


def corpus(n=60, seed=4):
    """Documents with copies, near copies, nulls, empty and long texts, and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 120))).capitalize() + ".\nSecond line, " + rng.choice(vocabulary)
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["b", "a", "ä", None]), len(text)))
    rows += [(100, rows[3][1], "en", "a", 1), (101, rows[3][1] + " x", "en", "a", 1), (102, None, None, None, None), (103, "", "en", "a", 0), (104, " \t\n", "de", "b", 3), (105, "one two", "en", "b", 7), (None, "text without an id here", "en", "a", 5)]
    rows += [(106, " ".join(rng.choice(vocabulary) for _ in range(30000)), "en", "b", 9), rows[7], rows[7]]
    return rows


def frame(spark, rows=None, schema=SCHEMA):
    return spark.createDataFrame(corpus() if rows is None else rows, schema)


def components(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]

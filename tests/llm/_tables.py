"""Small tables with the cases that every operator has to stand."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def words(r, n, letters="abcdefghijk"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))


def documents(seed=1):
    """Rows (doc_id, text, lang, source, n_chars, score): plain texts, copies, near copies, shared passages, nulls, empty
    and very long texts, repeated rows, and a column whose name an operator also uses."""
    r = random.Random(seed)
    texts = [words(r, r.randint(5, 120)) for _ in range(40)]
    texts += texts[:4]
    for t in texts[4:8]:
        parts = t.split()
        parts[len(parts) // 2] = "changed"
        texts.append(" ".join(parts))
    passage = words(r, 20)
    texts += [words(r, 30) + " " + passage + "\n" + words(r, 10) for _ in range(5)]
    texts += [None, "", "   \n ", "one", "Two words", "é" * 120, "same " * 400, words(r, 30_000), "a" * 5000]
    rows = [(i, t, ["en", "de", None][i % 3], [f"s{i % 4}", None][i % 9 == 0], len(t or ""), 0.5) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], "en", "s1", 3, None), (1000, texts[6].upper(), None, None, None, None)]
    r.shuffle(rows)
    return rows


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS)

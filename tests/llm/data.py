"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, runs int, fp string, size double"


def words(r, n):
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(n))


def odd_documents(spark, n=40, seed=3):
    r = random.Random(seed)
    passage = words(r, 50)
    rows = []
    for i in range(n):
        text = words(r, r.choice([1, 2, 5, 30, 80])) + (". " if r.random() < 0.5 else "\n") + words(r, r.choice([3, 25]))
        if i % 6 == 0:
            text = f"{text} {passage} {words(r, 4)}"
        rows.append([i, text])
    rows += [[n, rows[3][1]], [n + 1, rows[3][1]], [n + 2, rows[4][1] + " x"], [n + 3, None], [n + 4, ""], [n + 5, " \n\t "], [None, rows[5][1]], [None, "alone here"], [n + 6, "é ü ñ 漢字 " * 30], [n + 7, words(r, 9000)]]
    rows += [[n + 8, "a b " * 60], [2, rows[2][1]], [2, "another text under an id that repeats " + words(r, 30)], [n + 9, rows[0][1].upper()]]
    table = [(i, t, ["en", None][k % 2], [None, "s1", "s2", "hot", "hot", "hot"][k % 6], None if t is None else len(t), k, "clash", 1.0) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(table, DOCS)


def plain(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]

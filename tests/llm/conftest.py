import random

import pytest


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with null and empty texts, repeats, near copies, a hot text, long texts and columns whose names clash."""
    rng = random.Random(7)
    words = [f"w{n}" for n in range(400)] + ["Straße", "naïve", "日本語", "ｗ"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows: list[tuple] = [(0, None), (1, ""), (2, "   \t\n"), (3, "one"), (4, "one two three"), (None, text(30)), (None, None)]
    base = text(120)
    for k in range(12):
        w = base.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((10 + k, " ".join(w)))
    rows += [(30 + k, "the hot text " + base[:300]) for k in range(20)]
    passage = text(60)
    rows += [(60 + k, text(rng.randrange(5, 90)) + " " + passage + " " + text(20)) for k in range(15)]
    rows += [(90, text(6000)), (91, "ab" * 900), (92, "a\x00b " * 300), (93, text(3))]
    rows += [(10, base), (60, rows[39][1])]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", [1]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n int, cls string, spans array<int>").repartition(5)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.filter("false")


def brute(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]

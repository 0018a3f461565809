import math
from collections import Counter

from sparkobs.llm import urls
from sparkobs.llm.queries import URL_RULES


def scores(decided, given):
    """Ratios by exact counts of every context and character."""
    seen = [[Counter() for _ in range(urls.ORDER + 1)] for _ in range(2)]
    follows = [[Counter() for _ in range(urls.ORDER + 1)] for _ in range(2)]
    cells = lambda u: ((o, t[i - o : i], t[i : i + 1]) for t in [b"\x02" * urls.ORDER + u.encode() + b"\x03"] for i in range(urls.ORDER, len(t)) for o in range(urls.ORDER + 1))
    for u, accepted in decided:
        for o, context, char in cells(u):
            seen[accepted][o][context] += 1
            follows[accepted][o][context, char] += 1

    def bits(u, m):
        total, p = 0.0, 0.0
        for o, context, char in cells(u):
            p = (follows[m][o][context, char] + urls.STRENGTH * (p if o else 1 / urls.ALPHABET)) / (seen[m][o][context] + urls.STRENGTH)
            total += math.log2(p) if o == urls.ORDER else 0
        return total

    return [(bits(u, 1) - bits(u, 0)) / (len(u.encode()) + 1) for u in given]


def test_scores_by_exact_counts(spark):
    good, bad = [f"http://site{i * 7919}.org/fr/über-{i * 104729:x}" for i in range(900)], [f"http://spam{i * 6007}.net/{i * 15485863:x}" for i in range(900)]
    loose = ["http://other.info/fr/77", "http://q.info/zzz", "é", "http://site1.info/spam" * 50]
    rows = good + bad + loose + loose + good[:50]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").repartition(5)
    got = {r.page_id: r.score for r in urls.judge(df, URL_RULES).collect()}
    want = scores([(u, 1) for u in good + good[:50]] + [(u, 0) for u in bad], rows)
    assert max(abs(got[i] - x) for i, x in enumerate(want)) < 1e-6

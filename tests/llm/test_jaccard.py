import random
import re

from faceoff.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, size=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, percent=80):
    sets = [(k, grams(t)) for k, t in rows]
    root = {k: k for k, _ in rows}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((k, len(s), find(k)) for k, s in sets)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_odd_documents(odd, odd_rows):
    assert got(jaccard.jaccard_components(odd)) == brute([r[:2] for r in odd_rows])


def test_groups_of_near_copies(spark):
    rng = random.Random(5)
    rows = []
    for group in range(6):
        base = [f"g{group}w{rng.randrange(300)}" if rng.random() < .8 else f"c{rng.randrange(20)}" for _ in range(rng.randrange(6, 160))]
        for _ in range(60 if group == 0 else 12):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"m{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w[rng.randrange(3):])))
    rows += [(len(rows) + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(100)) + " one passage that many texts share " * 3) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert got(jaccard.jaccard_components(docs)) == want
    assert len({r[2] for r in want}) < len(rows) - 30


def test_rows_without_key_and_one_key_of_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(None, a), (5, a), (7, a), (7, b), (9, b)], "doc_id long, text string")
    assert sorted(map(str, got_rows(docs))) == sorted(map(str, [(None, 26, None), (5, 26, 5), (7, 26, 5), (7, 26, 5), (9, 26, 5)]))


def got_rows(docs):
    return [tuple(r) for r in jaccard.jaccard_components(docs).collect()]


def test_empty(none):
    assert jaccard.jaccard_components(none).count() == 0

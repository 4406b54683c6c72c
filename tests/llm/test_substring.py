import hashlib
import random
import re

from pyspark.sql import functions as F

from faceoff.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=20):
    texts = [(k, WORD.findall(t or "")) for k, t in rows]
    first = {}
    for k, w in texts:
        for i in range(len(w) - size + 1):
            key, place = tuple(w[i:i + size]), (k, i)
            first[key] = min(first.get(key, place), place)
    out = []
    for k, w in texts:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < (k, i):
                gone |= set(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_odd_documents(odd, odd_rows):
    assert got(substring.digest(odd)) == brute([r[:2] for r in odd_rows])


def test_shared_passages_and_seams(spark):
    rng = random.Random(11)
    passages = [[f"p{rng.randrange(50)}" for _ in range(rng.randrange(15, 60))] for _ in range(8)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 5)
            w += [f"u{rng.randrange(10**5)}" for _ in range(rng.randrange(0, 25))] + p[a:a + rng.randrange(5, 60)]
        rows.append((i, " ".join(w)))
    rows += [(100, "x " * 100), (101, "a b " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert got(substring.digest(docs)) == want
    cut = substring.remove_duplicates(docs.withColumn("k", F.lit(1)).withColumn("_t", F.lit("z")))
    assert cut.columns == ["doc_id", "text", "k", "_t"]
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    before = dict(rows)
    for k, _, n, sha in want:
        assert texts[k] == before[k] if n == 0 else hashlib.sha256(texts[k].encode()).hexdigest() == sha


def test_factors_cover_what_is_removed(spark):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b} end")], "doc_id long, text string")
    factors = sorted(tuple(r) for r in substring.duplicate_factors(docs).collect())
    assert factors == [(3, 0, 40, 1, 0), (3, 40, 40, 2, 0)]


def test_null_keys_and_repeated_rows(spark):
    t = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(None, t), (None, t), (4, t), (4, t), (4, "other " + t)], "doc_id long, text string")
    got_rows = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring.digest(docs).collect())
    assert got_rows == [("4", 30, 0), ("4", 30, 0), ("4", 31, 30), ("None", 30, 30), ("None", 30, 30)]


def test_a_row_without_key_repeats_itself(spark):
    t = " ".join(f"t{i}" for i in range(25))
    rows = [(5, f"{t} {t}"), (None, " ".join(f"u{i}" for i in range(25)) + " " + " ".join(f"u{i}" for i in range(25))),
            (None, "x " + " ".join(f"u{i}" for i in range(25)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring.digest(docs).collect())
    assert got == [("5", 50, 25), ("None", 26, 0), ("None", 50, 25)]
    factors = sorted((str(r["doc_id"]), r["start"], r["length"], r["ref_key"], r["ref_start"]) for r in substring.duplicate_factors(docs).collect())
    assert factors == [("5", 25, 25, 5, 0), ("None", 25, 25, None, 0)]


def test_empty(none):
    assert substring.digest(none).count() == 0 and substring.remove_duplicates(none).count() == 0

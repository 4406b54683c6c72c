import corpus_pipeline as P
import public_tokenizers
from test_jaccard import brute as near
from test_quality import plain as rules
from test_secrets import plain as patterns
from test_substring import brute as passages
from tokenizers import Tokenizer

from faceoff.llm.registry import table
from faceoff.llm.scratch import Scratch

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_every_stage_against_brute_force(spark):
    scratch, docs, outs = Scratch(spark, "test"), table(spark, FOLDER, "documents"), []
    before = columns = None
    for name, stage in P.STAGES:
        before = rows(docs)
        columns = columns or docs.columns
        docs = scratch.keep(stage(spark, docs, FOLDER))
        outs.append((name, before, docs))
        assert name == "best_fit_packing" or docs.columns == columns
    text = lambda d: [(k, r["text"]) for k, r in d.items()]

    _, before, out = outs[0]
    kept = rows(out)
    assert all(before[k] == r for k, r in kept.items()) and not any(rules(r["text"])[-1] for r in kept.values())
    labels = {r["doc_id"]: r["quality"] for r in table(spark, FOLDER, "labels").collect()}
    clean = [k for k, r in before.items() if labels.get(k) == 1 and not rules(r["text"])[-1]]
    assert sum(k in kept for k in clean) >= .99 * len(clean) and not any(labels.get(k) == 0 for k in kept)

    _, before, out = outs[1]
    assert sorted(rows(out)) == sorted({c for _, _, c in near(text(before))})

    _, before, out = outs[2]
    after = rows(out)
    for k, n, gone, sha in passages(text(before)):
        import hashlib
        assert after[k]["text"] == before[k]["text"] if not gone else hashlib.sha256(after[k]["text"].encode()).hexdigest() == sha
        assert after[k]["n_chars"] == len(after[k]["text"]) and n >= gone

    _, before, out = outs[3]
    after = rows(out)
    assert sorted(after) == sorted(before) and not any(patterns(r["text"]) for r in after.values())
    assert sum(r["text"] != before[k]["text"] for k, r in after.items()) >= sum(bool(patterns(r["text"])) for r in before.values())

    _, before, out = outs[4]
    library, by, own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}, {}
    for r in out.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        own[r["doc_id"]] = own.get(r["doc_id"], 0) + r["length"]
    assert own == {k: len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for k, r in before.items()}
    for cells in by.values():
        at = 0
        for offset, length in sorted(cells):
            assert offset == at
            at += length
        assert at <= 4096
    assert P.run(spark, FOLDER).count() == out.count()


def test_nulls_and_empty_tables(odd, none, spark):
    for docs in (odd, none):
        for name, stage in P.STAGES:
            out = stage(spark, docs, FOLDER)
            assert name == "best_fit_packing" or out.columns == docs.columns
            out.collect()

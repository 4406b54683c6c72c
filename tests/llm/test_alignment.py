import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faceoff.llm import alignment
from faceoff.llm import text as T

BYTE, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
HARD = ["don't 'sx  x's", "a b c 　d\u0085e \xa0f", "<|endoftext|>x<|endoftext|> <s> y </s>", "▁a", "x ▁", "tab\t\ttwo\n\n three   four ", " ", "  ", "",
        "日本語 текст 🙂🙂 qzx7#@!", "a\x00b", "<0x41>", "1234.5,6;7", "ends ", "\n a", "ﬁ ½ Å é", "​ ⁠y", "!!!!!!!!!!!!!!!!! ........", "\r\n x"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


BYTES = byte_of()


def grouped(text, libraries):
    """Groups of (A ids, B ids), by sets of ends."""
    if not text:
        return []
    a, b = libraries
    e = a.encode(" " + text, add_special_tokens=False)
    at = [bytes(BYTES[c] for c in t) for t in e.tokens]
    ids = b.encode(text)
    bt = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
    if b"".join(at) != (" " + text).encode() or b"".join(bt) != (" " + text).encode():
        return []
    ae, be = np.cumsum([len(t) for t in at]).tolist(), np.cumsum([len(t) for t in bt]).tolist()
    out, i, j = [], 0, 0
    rank_a, rank_b = ({end: n for n, end in enumerate(x, 1)} for x in (ae, be))
    for end in sorted(rank_a.keys() & rank_b.keys()):
        p, q = rank_a[end], rank_b[end]
        out.append((e.ids[i:p], ids[j:q]))
        i, j = p, q
    return out


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute(rows, libraries):
    every = [(k, grouped(t, libraries)) for k, t in rows]
    count = {}
    for _, groups in every:
        for pair in {(x, y) for a, b in groups for x in a for y in b}:
            count[pair] = count.get(pair, 0) + 1
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for k, groups in every:
        links = [(x, y) for a, b in groups for x in a for y in b]
        out.append((k, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[p] == most[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(written(groups).encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def counted(df):
    got = alignment.link_counts(df, BYTE, PIECE)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab' .,!\n\t  é▁strev7", max_size=40), st.sampled_from(HARD)), max_size=5))
def test_groups_equal_sets_of_ends(libraries, texts):
    code = alignment.coder(BYTE, PIECE)
    for block in T.blocks(pa.array(texts, pa.string())):
        want = [written(grouped(texts[i], libraries)) for i in range(block.lo, block.hi)]
        assert alignment.Aligned(block, code).digests() == [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in want]


def test_gallop_equals_binary_search():
    rng = np.random.default_rng(1)
    long = np.unique(rng.integers(0, 5000, 1500))
    short = np.unique(rng.integers(0, long[-1] + 1, 300))
    want = np.searchsorted(long, short)
    for back in (0, 1, 700):
        assert (alignment.gallop(short, long, np.maximum(want - rng.integers(0, back + 1, len(short)), 0)) == want).all()


def test_odd_rows(odd, odd_rows, libraries):
    assert counted(odd) == brute([r[:2] for r in odd_rows], libraries)


def test_many_chunks(spark, monkeypatch, libraries):
    rows = [(i, t) for i, t in enumerate(HARD * 3)] + [(None, "a null key"), (3, "a repeated key"), (7, None)]
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "ASKED", 2)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, t string, part int, chunk int").repartition(7)
    assert counted(df) == brute(rows, libraries)


def test_long_groups_are_paired_by_distinct_ids(monkeypatch):
    own = alignment.Aligned.__new__(alignment.Aligned)
    rng = np.random.default_rng(2)
    own.a, own.b = rng.integers(0, 30, 200), rng.integers(0, 20, 150)
    own.first_a, own.first_b, own.first_group = np.array([0, 120, 200]), np.array([0, 100, 150]), np.array([0, 2, 3])
    own.stop_a, own.stop_b = np.array([110, 120, 200]), np.array([90, 100, 150])
    own.n_a, own.n_b = np.diff(own.stop_a, prepend=0), np.diff(own.stop_b, prepend=0)
    plain = alignment._distinct(list(own.links()))
    monkeypatch.setattr(alignment, "LONG_GROUP", 10**9)
    monkeypatch.setattr(alignment, "PAIRS", 1000)
    other = alignment._distinct(list(own.links()))
    assert all((x == y).all() for x, y in zip(plain, other, strict=True)) and plain[1].sum() == 110 * 90 + 10 * 10 + 80 * 50


def test_align_lists_groups(odd, odd_rows, libraries, none):
    got = {r["doc_id"]: r for r in alignment.align(odd, BYTE, PIECE).collect()}
    for k, t, *_ in odd_rows[:20]:
        r, i, j, groups = got[k], 0, 0, []
        for p, q in zip(r["a_stops"], r["b_stops"], strict=True):
            groups.append((r["a_ids"][i:p], r["b_ids"][j:q]))
            i, j = p, q
        assert groups == grouped(t, libraries)
    assert counted(none) == [] and alignment.align(none, BYTE, PIECE).count() == 0

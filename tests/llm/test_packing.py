import zlib
from collections import defaultdict

import numpy as np
import pytest

from oscilla.llm import packing, wordbpe


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(wordbpe.tokenizer_path())


def test_words_give_the_ids_of_whole_texts(tokenizer, spark, data):
    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    texts += ["", " ", "It's 12.5%... e.g., 3.\x1c4 \xa0x y İI ÀÉ. €. á Á,", "<|endoftext|> ok", "'s.", "x" * 5000, "naïve\u0085z", "abc'd x_ a-b- it's' thonea$$$ two### don't'. 5%%% (q) ...a. é$$ 'S.", "'S 'Re 'LL. don't. K", "a,b., c.. ,, ."]
    enc = wordbpe.WordEncoder(wordbpe.tokenizer_path(), room=5000)
    got = enc.encode([t.encode() for t in texts])
    for t, g in zip(texts, got):
        assert tokenizer.encode(t, add_special_tokens=False).ids == g.tolist(), t[:80]


def test_special_tokens_and_odd_characters(tokenizer):
    """Both added tokens inside, at the ends of and next to words, in either case, and characters that the split or the lower case treat apart."""
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "'s", "'S", "don't", "É", "e\u0301", "ß", "ÀÉ", "ÿ", "µ", "ª", "×", "÷", "\xa0", "\u2003", "\x00", "\x1c", "\x7f", "1", "२", "Ⅷ", "a", "Zz", ".", "..", "`", "~", "{", "漢字", "🙂", "İ", "ı", "ﬁ", "\u0300", " ", "\n", "  ", "²", "½", "Ǆ", "Straße", "'re", "'LL"]
    rng = np.random.default_rng(5)
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 12))) for _ in range(20000)]
    for t, e, g in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False), wordbpe.WordEncoder(wordbpe.tokenizer_path(), room=3000).encode([t.encode() for t in texts]), strict=True):
        assert e.ids == g.tolist(), t
    ends = wordbpe.WordEncoder(wordbpe.tokenizer_path()).encode([b"<|endoftext|>", b"a<|startoftext|>b"])
    assert ends[0].tolist() == [49407] and 49406 in ends[1].tolist()


def test_combinations():
    got = packing.combinations_filling(6, 3)
    assert sorted(got) == sorted([(5, 1), (4, 2), (3, 3), (4, 1, 1), (3, 2, 1), (2, 2, 2)])


def test_nnls_against_known_solution():
    rng = np.random.default_rng(3)
    a = rng.random((20, 8))
    x = np.array([0, 1.5, 0, 2, 0, 0, 3, 0.25])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-8)
    y = packing.nnls(a, -np.ones(20))
    assert not y.any()


def test_plan_uses_no_more_than_there_is():
    rng = np.random.default_rng(4)
    for _ in range(20):
        have = {u: int(n) for u, n in enumerate(rng.integers(0, 200, 32)) if u}
        used = defaultdict(int)
        for combo, n in packing.plan(have, 32, 4):
            assert sum(combo) == 32 and n > 0
            for u in combo:
                used[u] += n
        assert all(used[u] <= have.get(u, 0) for u in used)
    assert packing.plan({}, 32, 4) == []


def check(docs, pieces, tokenizer, width):
    """Every id once, in order, gapless sequences of full width or a power of two."""
    ids = defaultdict(list)
    for d, t in docs:
        ids[d].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert by_doc.keys() == ids.keys()
    for d, own in ids.items():
        assert sum(p.length for p in by_doc[d]) == sum(map(len, own))
        if len(own) == 1:
            at = 0
            for p in sorted(by_doc[d], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(own[0])
                assert p.ids_crc32 == zlib.crc32(np.array(own[0][at : at + p.length], "<u4").tobytes())
                at += p.length
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == width or (at < width and at & (at - 1) == 0), at


ROWS = [(1, "a b c"), (2, None), (3, ""), (None, "x y"), (4, "same text"), (4, "same text"), (5, "Lorem ipsum, " * 9000), (6, "word " * 4095), (7, "one<|endoftext|>two"), *((i, "tok " * (i * 37 % 4000)) for i in range(10, 300))]


@pytest.mark.parametrize("unit", [128, 512])
def test_pieces(spark, tokenizer, unit):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    check(ROWS, packing.pack_documents(docs, unit=unit).collect(), tokenizer, 4096)


def test_whole_table_and_empty_table(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    pieces = packing.pack_documents(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], pieces, tokenizer, 4096)
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_ids_of_pieces_and_other_columns(spark, tokenizer):
    docs = spark.createDataFrame([(i, "w x y " * (i * 300), i, "u") for i in range(12)], "doc_id long, text string, uid long, bucket string")
    rows = packing.pack_documents(docs, with_ids=True).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], rows, tokenizer, 4096)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)

"""Encoding against the tokenizers library, packing against its limits."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from catalens.llm import bpe, packing, tokenizing
from llm_rows import odd_texts


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, Key string")


def test_bpe_round_trip(spark, tokenizer, exact):
    rows = odd_texts(3)
    small = bpe.Chunking(bits=7, least=32, most=2048)
    got = bpe.encode_documents(_docs(spark, rows).repartition(3), tokenizer, chunking=small).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in rows:
        ids = exact.encode(text or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(exact.decode(ids, skip_special_tokens=False))))
    assert sorted((str(a), b, c, d) for a, b, c, d in got) == sorted(want)


def test_bpe_of_no_rows(spark, tokenizer):
    assert bpe.encode_documents(_docs(spark, []).filter("false"), tokenizer).count() == 0


def test_joins_are_repaired(tokenizer, exact):
    coder = tokenizing.encoder(tokenizer)
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "c", " ", "  ", "\n", "'s", "1", "é", "!", " ", "<|endoftext|>"]) for _ in range(40))
        cut = sorted(rng.sample(range(1, len(text)), 4))
        parts = [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)])]
        joined = bpe.join_parts([bpe.encode_part(p, coder.encode, "<u2") for p in parts], coder.encode, "<u2")
        assert joined.tolist() == exact.encode(text, add_special_tokens=False).ids


def test_cuts_follow_the_content():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    text, c = " ".join(words), bpe.Chunking(bits=6, least=16, most=500)
    chunks = lambda t: {t[a:b] for a, b in zip([0, *bpe.cuts(t, c)], bpe.cuts(t, c))}
    assert bpe.cuts(text, c)[-1] == len(text) and bpe.cuts("", c) == []
    shared = chunks(text) & chunks("other beginning " + text)
    assert len(shared) > 0.9 * len(chunks(text))


def test_common_characters_agree(tokenizer, exact):
    coder = tokenizing.encoder(tokenizer)
    for code in [*range(0x530), *range(0x2010, 0x2028)]:
        c = chr(code)
        for text in (f"a{c}b", f"1{c}2", f" {c} ", f"{c}{c}!", f"'{c}", f"{c}  {c}"):
            assert coder.encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids, code


def test_pieces(spark, tokenizer, exact):
    rows = odd_texts(4)
    got = packing.pack_documents(_docs(spark, rows), tokenizer, rows_per_group=5).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    total = 0
    for i, text in rows:
        ids = exact.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        if [r[0] for r in rows].count(i) == 1:
            at = 0
            for start, length, sum_, n in sorted(pieces[i]):
                assert (start, n, sum_) == (at, len(ids), crc(ids[at : at + length]))
                at += length
            assert at == len(ids)
    assert sum(r.length for r in got) == total
    again = packing.pack_documents(_docs(spark, rows).repartition(5), tokenizer, rows_per_group=5).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_packing_of_no_rows(spark, tokenizer):
    assert packing.pack_documents(_docs(spark, []).filter("false"), tokenizer).count() == 0


def test_all_limits_hold():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 500, 3000)
    loss = np.minimum(rng.integers(0, 500, 3000), tokens)
    limits = packing.Limits(tokens=1000, segments=6, loss=600)
    placed = packing.place(tokens, loss, limits)
    assert sorted(i for held in placed for i in held) == list(range(3000))
    for held in placed:
        assert len(held) <= 6 and tokens[held].sum() <= 1000 and loss[held].sum() <= 600
    least = max(tokens.sum() / 1000, loss.sum() / 600, 3000 / 6)
    assert len(placed) < 1.1 * least  # a lower bound that may be out of reach


def test_cut_sequences_need_no_padding():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1024, 500)
    seen, sizes = defaultdict(int), defaultdict(int)
    for p in packing.place_cut(lengths, packing.Limits()):
        assert p.offset == sizes[p.bin] and p.start == seen[p.item]
        seen[p.item] += p.length
        sizes[p.bin] += p.length
    assert [seen[i] for i in range(500)] == lengths.tolist()
    assert all(n <= 1024 and n & (n - 1) == 0 for n in sizes.values())

"""Cross-tokenizer alignment against a plain reading of its definition."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrace.llm import align
from terrace.llm.queries import op11_token_alignment, vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a  b ", "\n", "a\r\n b\t\tc \n d", "<|endoftext|> and <s> </s>", "é ﬁ ① 漢字かな ไทย 🙂🙂  x  y", "under▁score", "\x1c a \x00b\x85 c", "can't  'll n’t", "ab" * 4000, "  indented\n    more", "🙂" * 500, "﻿x", "a" * 70 + " " * 40 + "b", "−1,234.50 €", "é ́ x"]


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B), align.Aligner(A, B)


def plainly(text, tok, sp, aligner):
    """Groups as lists of ids, by the sets of offsets where tokens end."""
    if not text:
        return []
    a, b, raw = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text), (" " + text).encode()
    spelt_a = [aligner.a_bytes[i] for i in a]
    spelt_b = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(spelt_a) != raw or b"".join(spelt_b) != raw:
        return []

    def ends(spelt):
        at, out = 0, []
        for x in spelt:
            at += len(x)
            out.append(at)
        return out

    end_a, end_b = ends(spelt_a), ends(spelt_b)
    out, i, j = [], 0, 0
    for cut in sorted(set(end_a) & set(end_b)):
        n, m = end_a.index(cut) + 1, end_b.index(cut) + 1
        out.append((a[i:n], b[j:m]))
        i, j = n, m
    return out


def said(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def texts(seed=3, n=150):
    r = random.Random(seed)
    bits = ["the", "Über", "naïve", " ", "  ", "\n", "\n\n", "\t", "…", "it's", "12345", "αβγ", "漢字", "🙂", " ", "　", "\r\n", "a.b,c", "(x)", "'", "<|endoftext|>", "ﬁ", "\x0b", "\x1f", "ß", "_", "-" * 9, "=" * 30]
    return ["".join(r.choice(bits) + (" " if r.random() < 0.5 else "") for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_groups_of_odd_texts(models):
    tok, sp, aligner = models
    for text in ODD + texts():
        want = plainly(text, tok, sp, aligner)
        n_a, n_b, n_groups, n_links, groups, codes, times = aligner.align(text)
        links = Counter((x, y) for a, b in want for x in a for y in b)
        assert groups.decode() == said(want), text
        assert (n_a, n_b, n_groups, n_links) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want), sum(links.values()))
        assert {(c >> align.B_BITS, c & (1 << align.B_BITS) - 1): t for c, t in zip(codes.tolist(), times.tolist())} == links


def test_large_groups_are_counted_by_distinct_ids(models, monkeypatch):
    tok, sp, _ = models
    monkeypatch.setattr(align, "LISTED", 1)
    aligner = align.Aligner(A, B)
    for text in ODD:
        want = Counter((x, y) for a, b in plainly(text, tok, sp, aligner) for x in a for y in b)
        codes, times = aligner.align(text)[5:]
        assert {(c >> align.B_BITS, c & (1 << align.B_BITS) - 1): t for c, t in zip(codes.tolist(), times.tolist())} == want


def expected(rows, models):
    groups = [plainly(t, *models) for _, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    held = Counter(p for c in links for p in c)
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (i, _), g, c in zip(rows, groups, links):
        text = said(g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


key = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("sent", [align.BROADCAST_ROWS, 40])
def test_counts_over_the_corpus(spark, models, sent):
    """Null and repeated ids, null texts, repeated rows and a column with a clashing name; with few and with many pairs."""
    rows = [(None if n % 9 == 0 else n // 2, t) for n, t in enumerate(ODD[:11] + texts(5, 40) + [None, None])] + [(7, "it's a copy"), (7, "it's a copy")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, codes string").repartition(3)
    got = align.scored(df, A, B, sent=sent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(rows, models), key=key)


def test_empty_table(spark):
    assert align.scored(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_query(spark, sf_dir, models):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text")).collect()]
    assert sorted(map(tuple, op11_token_alignment(spark, sf_dir).collect())) == sorted(expected(rows, models))

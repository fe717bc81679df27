"""Operator 12 against a plain alignment of whole texts by both libraries."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import alignment
from lodestone.llm.pieces import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = byte_letters()

    def tokens(text):
        left = a.encode(" " + text, add_special_tokens=False).ids if text else []
        right = b.encode(text) if text else []
        x = [bytes(letters[c] for c in a.id_to_token(i)) for i in left]
        y = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in right]
        whole = (" " + text).encode() if text else None
        return list(zip(left, map(len, x))), list(zip(right, map(len, y))), bool(text) and b"".join(x) == whole == b"".join(y)

    return tokens


def groups(a, b):
    """The tokens of both sides, cut where both end."""
    out, i, j, x, y = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            out[-1][0].append(a[i][0])
            x, i = x + a[i][1], i + 1
        else:
            out[-1][1].append(b[j][0])
            y, j = y + b[j][1], j + 1
        if x == y and (i < len(a) or j < len(b)):
            out.append(([], []))
    return out


def plain(rows, tokens):
    cut = []
    for doc_id, text in rows:
        a, b, good = tokens(text)
        cut.append((doc_id, groups(a, b) if good else []))
    held = Counter(p for _, gs in cut for p in {(i, j) for a, b in gs for i in a for j in b})
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for doc_id, gs in cut:
        links = [(i, j) for a, b in gs for i in a for j in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((doc_id, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


TEXTS = [
    None, "", " ", "  two  spaces ", "\n", "a\nb", " a \n b\n\nc", "tab\there \t x", "don't, stop. It's 1,234.5% of $9.99!!! a.b,c", "▁under", "<s>[INST] <|endoftext|> </s><unk><0x41>", " no break 　 wide",
    "日本語の文章です。 改行なし", "🙂🙃 emoji‍ ﻿bom", "x" * 3000, "1234567890" * 40, "é é ﬁ ①", "\x1c odd \x85 \x00 nul", "%%% ### &&&*** a%%% b### ", "Straße, naïve. ÇA! ŒUVRE;x", "#tag ,x .y :z", "under_score,x a_,b", "aaa " * 500, "the the the the, the", "²,½. ৪,x", "ok <|endoftext|>,",
]


def test_equals_plain_alignment(spark, libraries):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(8, TEXTS[8]), (None, "the row"), (100, " ".join(t for t in TEXTS if t and "▁" not in t))]
    for chars in (500, alignment.BLOCK_CHARS):
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, part string, block int").repartition(3)
        assert sorted((tuple(r) for r in alignment.align(df, A, B, chars).collect()), key=str) == plain(rows, libraries)


def test_tables(spark, libraries, odd, none):
    rows = [tuple(r)[:2] for r in odd.collect()]
    assert sorted((tuple(r) for r in alignment.align(odd, A, B).collect()), key=str) == plain(rows, libraries)
    assert alignment.align(none, A, B).collect() == []


def test_relational_core_on_whole_texts(spark, libraries):
    rows = []
    for i, t in enumerate(TEXTS):
        a, b, good = libraries(t)
        if good:
            rows.append((i, [x for x, _ in a], [n for _, n in a], [x for x, _ in b], [n for _, n in b]))
    out = alignment.aligned(spark.createDataFrame(rows, "doc long, a array<int>, a_len array<int>, b array<int>, b_len array<int>"), ["doc"]).collect()
    for doc, a, n, b, m in rows:
        own = sorted((r for r in out if r["doc"] == doc), key=lambda r: r["end"])
        got = [([r["a"] for r in own if r["grp"] == g and r["a"] is not None], [r["b"] for r in own if r["grp"] == g and r["b"] is not None]) for g in sorted({r["grp"] for r in own})]
        assert got == groups(list(zip(a, n)), list(zip(b, m)))


def test_parts_encode_as_the_whole_text(libraries):
    both = alignment.Tokenizers(A, B)
    for text in filter(None, TEXTS):
        parts = alignment.parts_of_text(text, both.parts)
        assert "".join(parts) == " " + text
        a, b = both.encode(parts)
        left, right, _ = libraries(text)
        assert [int(x) for p in a for x in p] == [i for i, _ in left] and [x for p in b for x in p] == [i for i, _ in right]

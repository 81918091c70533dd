"""Alignment of two tokenizers against its definition, with the libraries alone, on the tables and on odd inputs."""

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skein.llm import alignment
from skein.llm.common import table
from skein.llm.packing import _byte_letters
from tests.llm.test_operators import ODD, docs_of

A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
MORE = [(9100, "<|endoftext|> and </s> are <unk> text"), (9101, "▁ is a blank here"), (9102, " two  blanks, \ttabs\n\nand lines "), (9103, "naïve 日本語 текст 🙂🙂 été x"), (9104, "a\x00b ok"), (9105, "don't we'll 123,456.789"), (9106, "line one\nline two\r\nthree"), (9107, "é x")]


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {c: k for k, c in _byte_letters().items()}
    names = {k: t for t, k in a.get_vocab().items()}

    def tokens(text):
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        own = [(k, bytes(letters[c] for c in names[k])) for k in ids]
        other = []
        for k in b.encode(text):
            piece = b.id_to_piece(k)
            other.append((k, bytes([int(piece[3:5], 16)]) if b.is_byte(k) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (own, other) if b"".join(x for _, x in own) == whole == b"".join(x for _, x in other) else ([], [])

    return tokens


def spans(tokens):
    out, at = [], 0
    for k, x in tokens:
        out.append((at, at + len(x), k))
        at += len(x)
    return out


def brute(docs, tokens):
    facts, count = [], collections.Counter()
    for doc, text in docs:
        a, b = map(spans, tokens(text))
        links, j = [], 0
        for s, e, x in a:
            while j and b[j - 1][1] > s:
                j -= 1
            while j < len(b) and b[j][0] < e:
                if b[j][1] > s:
                    links.append((x, b[j][2]))
                j += 1
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, i, j = [], 0, 0
        for c in cuts:
            own, other = [], []
            while i < len(a) and a[i][1] <= c:
                own.append(str(a[i][2]))
                i += 1
            while j < len(b) and b[j][1] <= c:
                other.append(str(b[j][2]))
                j += 1
            groups.append(",".join(own) + "|" + ",".join(other))
        count.update(set(links))
        facts.append((doc, len(a), len(b), groups, links))
    best = collections.Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    rows = [(d, na, nb, len(g), len(ls), sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for d, na, nb, g, ls in facts]
    return rows, facts, count


@pytest.mark.parametrize("pack_bytes", ["30000", "6291456"])
def test_whole_tables_and_odd_rows(spark, sf, libraries, pack_bytes):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()] + ODD + MORE
    spark.conf.set("spark.skein.chunk.bytes", pack_bytes)
    try:
        got = alignment.op13_alignment(docs_of(spark, docs)).collect()
    finally:
        spark.conf.unset("spark.skein.chunk.bytes")
    rows, _, _ = brute(docs, libraries)
    assert collections.Counter(map(tuple, got)) == collections.Counter(rows)
    assert any(r[1] == 0 and r[0] == 9101 for r in rows)


def test_groups_and_counts(spark, libraries):
    docs = MORE + [(1, None), (2, ""), (3, "the same words the same words"), (3, "the same words the same words"), (None, "no id")]
    _, facts, count = brute(docs, libraries)
    groups = {(r.doc_id, ";".join(f"{','.join(map(str, g.a))}|{','.join(map(str, g.b))}" for g in r.groups)) for r in alignment.align(docs_of(spark, docs), A, B).collect()}
    assert groups == {(d, ";".join(g)) for d, _, _, g, _ in facts}
    text = {d: (" " + t).encode() for d, t in docs if t}
    for r in alignment.align(docs_of(spark, docs), A, B).collect():
        assert [g.start for g in r.groups] == [0, *(g.end for g in r.groups)][: len(r.groups)] and (not r.groups or r.groups[-1].end == len(text[r.doc_id]))
    assert {(r.a, r.b): r.documents for r in alignment.link_counts(docs_of(spark, docs), A, B).collect()} == count


def test_empty_table(spark):
    assert alignment.op13_alignment(docs_of(spark, [])).collect() == []

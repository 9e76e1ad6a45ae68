"""Alignment of tokenizers against whole texts taken token by token."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from rostrum.llm import token_spans

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "\n", "  \n ", "a", " a ", "a\n", "a\n\n", "a\n\nb", "a \n b", "a  b", "a\n  b", "\n\na", "x\ty \t z",
       "hé①llo  w\nörld 🙂x", "a▁b", "<|endoftext|> <s>x</s> <unk>", "it's we'LL\n's", "a  b", "\x00 y", "a\r\nb \r\n",
       "ﬁ ² Å ①②③", "🙂🙂\n🙂 ñ", " \n \n x", "1234 5,678.90", "a\x1c b", "x" * 3000, "①" * 500, " " * 400 + "x", "日本語 テキスト\n中文"]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def one(text, tokenizers):
    """``(tokens of A, tokens of B, links, groups)`` of a whole text, by decoded bytes only."""
    if not text:
        return [], [], [], []
    a, b = tokenizers
    plain = token_spans.byte_level_bytes()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(plain[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = []
    for i in ids_b:
        piece = b.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], [], [], []
    at_a, at_b = ([i for i, t in zip(ids, parts) for _ in t] for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)))
    n_a, n_b = ([k for k, t in enumerate(parts) for _ in t] for parts in (bytes_a, bytes_b))
    links = [(at_a[k], at_b[k]) for k in range(len(whole))
             if k == 0 or (n_a[k], n_b[k]) != (n_a[k - 1], n_b[k - 1])]
    ends_a, ends_b = np.cumsum([len(t) for t in bytes_a]), np.cumsum([len(t) for t in bytes_b])
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
        p, q = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
        groups.append(",".join(map(str, ids_a[i:p])) + "|" + ",".join(map(str, ids_b[j:q])))
        i, j = p, q
    return ids_a, ids_b, links, groups


def brute(texts, tokenizers):
    each = [one(t, tokenizers) for t in texts]
    counts = Counter(p for *_, links, _ in each for p in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links),
             sum(counts[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
            for a, b, links, groups in each]


def rows(df, order="doc_id"):
    return [tuple(r)[1:] for r in df.orderBy(order).collect()]


def test_units_align_like_whole_texts(tokenizers):
    rng = random.Random(6)
    tool = token_spans.Aligner(A, B)
    assert tool.parts
    bits = ["a", " ", " ", "\n", "é", "①", "the", "ing", "'s", "\t", "9", ".", "🙂", "▁", "\r", "x y", " ", "<s>"]
    texts = ODD + ["".join(rng.choices(bits[:12] if k % 3 else bits, k=rng.choice([3, 12, 60])))
                   for k in range(2500)]
    for _ in range(2):  # the second time all units are known
        numbers, digests, keys, times, per_row = tool.align(texts)
        ends = np.cumsum(per_row)
        for k, text in enumerate(texts):
            a, b, links, groups = one(text, tokenizers)
            assert numbers[k].tolist() == [len(a), len(b), len(groups), len(links)], text
            assert digests[k] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
            part = slice(ends[k] - per_row[k], ends[k])
            assert dict(zip(keys[part].tolist(), times[part].tolist())) == Counter(
                x * tool.n_b + y for x, y in links)


def test_whole_texts_where_units_cannot_be_shown(tokenizers):
    tool = token_spans.Aligner(A, B)
    tool.parts = False
    numbers, *_ = tool.align(ODD)
    assert [tuple(n) for n in numbers.tolist()] == [
        (len(a), len(b), len(g), len(k)) for a, b, k, g in (one(t, tokenizers) for t in ODD)]


@pytest.mark.parametrize("pair_bytes", [64 << 20, 0])
def test_odd_rows(spark, tokenizers, pair_bytes):
    texts = [None, *ODD, "one two", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(
        {"row": F.lit("x"), "pair": F.lit(1), "Pairs": F.lit(2), "b": F.lit(3)})
    got = rows(token_spans.aligned(df, A, B, pair_bytes=pair_bytes))
    assert got == brute(texts, tokenizers)
    nameless = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert token_spans.aligned(nameless, A, B).where("doc_id is null").count() == len(texts)
    assert token_spans.aligned(df.limit(0), A, B).count() == 0
    assert rows(token_spans.aligned(df.where("doc_id = 0"), A, B)) == [(0, 0, 0, 0, 0, 0, "")]


def test_query(spark, tokenizers):
    docs = duckdb.execute("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()
    got = rows(entry.queries()["op13_token_spans"](spark, "/root/testdata/sf0.001"))
    assert got == brute([t for t, in docs], tokenizers)


def test_a_task_holds_little_beside_what_it_knows():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh.", k=5)) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=2000)) for _ in range(300)]  # 3.6 MB
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(300)), pa.array(range(300)), pa.array(texts)], names=["row", "doc_id", "text"])
    run = token_spans._aligned(A, B)
    assert sum(b.num_rows for b in run(iter([batch]))) == 300
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for _ in run(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 40e6


def test_new_units_are_aligned_a_bounded_number_at_a_time(monkeypatch):
    tool, most = token_spans.Aligner(A, B), []
    align = tool._align
    monkeypatch.setattr(tool, "_align", lambda units, *how: (most.append(len(units)), align(units, *how)))
    tool.align(["  ".join(f"x{k}" for k in range(5000))])
    assert sum(most) >= 5000 and max(most) <= token_spans.UNITS


def test_letters_and_line_feeds(tokenizers):
    tool = token_spans.Aligner(A, B)
    assert tool.letters
    texts = ["ß ǅ ʯ Ѐҁ Ҋԣ 一龥 가힣 ぁゖ ァヺ ×÷ aⅣ", "a\nb é\n\n가x x가.", "ﬀ ª º ʰ", "Ωμέγα שלום عربي ไทย"]
    numbers, digests, *_ = tool.align(texts)
    for k, text in enumerate(texts):
        a, b, links, groups = one(text, tokenizers)
        assert numbers[k].tolist() == [len(a), len(b), len(groups), len(links)], text
        assert digests[k] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
    assert token_spans._split([1, 7, 7], [7], 1) is None and token_spans._split([1, 7], [7, 8], 1) is None
    tool._lines_b = tool._alone_b  # as where a line feed is no token
    tool.forget()
    assert (tool.align(texts)[0] == numbers).all()

"""Results against brute force, exact round trips and held-out accuracy on small tables."""

import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
from rostrum.llm import hash_index, jaccard_join, line_dedup, mixing, token_counts, transport_stream
from rostrum.llm.tokenizing import WordTokens

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return duckdb.execute(f"select * from '{SMALL}/documents.parquet' order by doc_id").df()


def run(spark, name, folder=SMALL):
    return entry.queries()[name](spark, folder).toPandas()


def near_copies(spark):
    """A chain and a tight group, spread over blocks when these are small."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        words[(7 * i) % 60] = f"x{i}"
        rows.append((i, " ".join(words)))
    for i in range(6):
        rows.append((100 + i, " ".join(f"c{j}" for j in range(i * 5, i * 5 + 60))))
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_jaccard(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links, root = defaultdict(int), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("block", [512, 7])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", block)
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", block)
    df = near_copies(spark)
    want = brute_jaccard(df.collect())
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard_join.jaccard_classes(df).collect()}
    assert got == want


def test_jaccard_query(spark, docs):
    want = brute_jaccard(zip(docs.doc_id, docs.text))
    got = run(spark, "op1_ngram_jaccard_join")
    assert {r.doc_id: (r.class_id, r.links) for r in got.itertuples()} == want


def brute_lines(rows):
    first = {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            line = re.sub(r"\s+", " ", line).strip().lower()
            if line:
                first.setdefault(line, (i, k))
    buckets = defaultdict(list)
    for line, at in first.items():
        w = tuple(line.split(" "))
        if len(w) >= 4:
            buckets[w].append((at, -1))
            for j in range(len(w)):
                buckets[w[:j] + w[j + 1:]].append((at, j))
    gone = {a for m in buckets.values() for a, i in m for b, j in m
            if b < a and (i == j or -1 in (i, j))}
    kept = defaultdict(list)
    for at in first.values():
        if at not in gone:
            kept[at[0]].append(at[1])
    return {i: ",".join(map(str, sorted(k))) for i, k in kept.items()}


def test_lines(spark, docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join(words[:rng.choice([8, 15, 16, 17])])) for i in range(5)]
    for i in range(5, 120):
        w = rows[rng.randrange(i)][1].split()
        k = rng.randrange(len(w))
        w[k:k + rng.choice([0, 1])] = rng.choice([[], ["z"], [w[k]], ["y", "q"]])
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kept for r in line_dedup.line_report(df).collect() if r.kept}
    assert got == brute_lines(rows)
    want = brute_lines(zip(docs.doc_id, docs.text))
    query = run(spark, "op8_line_dedup")
    assert {r.doc_id: r.kept for r in query.itertuples() if r.kept} == want


def test_fit_is_the_best_sum():
    rng = np.random.default_rng(1)
    assert np.array([8, 20, 27, 47]) @ mixing.fit(
        np.array([8, 20, 27, 47]), np.array([2, 1, 2, 4]), 37) == 36
    for _ in range(1500):
        lengths = np.unique(rng.integers(1, 60, rng.integers(1, 6)))
        counts = rng.integers(1, 6, len(lengths))
        budget = int(rng.integers(0, lengths @ counts + 2))
        taken = mixing.fit(lengths, counts, budget)
        sums = {0}
        for length, count in zip(lengths.tolist(), counts.tolist()):
            sums = {s + length * n for s in sums for n in range(count + 1)}
        assert (taken >= 0).all() and (taken <= counts).all()
        assert lengths @ taken == max(s for s in sums if s <= budget)


def test_fit_of_many():
    lengths, counts = np.array([999, 1000]), np.array([1, 1_000_000])
    taken = mixing.fit(lengths, counts, 500_500)
    assert lengths @ taken == 500_000
    lengths = np.arange(1, 4000)
    taken = mixing.fit(lengths, np.full(3999, 1_000_000), 7_000_000_000_001)
    assert lengths @ taken == 7_000_000_000_001


def test_targets():
    got = mixing.targets({"a": 100, "b": 10, None: 50, "c": 40})
    assert sum(got.values()) == pytest.approx(300) and all(
        got[s] <= 2 * n + 1e-9 for s, n in {"a": 100, "b": 10, None: 50, "c": 40}.items())


def test_mixing_query(spark, docs):
    rows = run(spark, "op5_mixing").merge(docs[["doc_id", "source", "text"]], on="doc_id")
    assert (rows["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in rows.text]).all()
    for _, part in rows.groupby("source", dropna=False):
        assert part.target.iloc[0] - part.taken.sum() <= part["size"].max()
        assert part.taken.sum() <= part.target.iloc[0] + 1 and (part.taken <= 2 * part["size"]).all()


def test_packing_query(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
           for i, x in zip(docs.doc_id, docs.text)}
    rows = run(spark, "op4_packing")
    for doc, pieces in rows.sort_values("start").groupby("doc_id"):
        assert (pieces.start == pieces.length.cumsum() - pieces.length).all()
        assert pieces.length.sum() == len(ids[doc]) == pieces.doc_tokens.iloc[0]
        for p in pieces.itertuples():
            assert zlib.crc32(ids[doc][p.start:p.start + p.length].tobytes()) == p.ids_crc32
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.offset == rows.groupby("sequence_id").length.cumsum() - rows.length).all()
    fill = rows.groupby("sequence_id").length.sum()
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill)


def test_word_tokens():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["", "  ", " \n\n a", "Don't we'LL it's. A.B, x.,y ,, .", "ÀÉ. Straße, ǅ İx Σας ﬁ é. ́a b\tc",
             "<|endoftext|> x<|startoftext|>.", "ñ" * 1000, "a" * 500 + ".", "ÿ þ ß. Ø,"]
    flat, counts = WordTokens(path).encode(pa.array(texts))
    whole = Tokenizer.from_file(path)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and flat.tolist() == sum(want, [])


def test_spliced_counts():
    counter = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert counter.parts_at_spaces
    rng = random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice("ab c  d\nñ①x ") for _ in range(rng.choice([50, 900, 3000])))
        text = rng.choice([text, "x" * 700 + text, " " * 300 + text, text + "①" * 200])
        want = len(counter.model.encode(text))
        assert counter.spliced(text, rng.choice([20, 64, 300]), rng.choice([4, 16])) == want


def test_streams():
    rng = random.Random(3)
    for n in [*range(0, 400), 16_384, 16_385, 50_000, 200_001]:
        data = rng.randbytes(n)
        found = transport_stream.read_stream(transport_stream.to_stream(data))
        assert found.payload == data and not found.losses
        assert found.stamps == [3600 * i for i in range(len(found.stamps))]
        assert found.access == list(range(0, len(found.stamps), 4))
    stored = transport_stream.to_stream(rng.randbytes(100_000))
    assert len(stored) % 188 == 0
    lost = transport_stream.read_stream(stored[:188 * 40] + stored[188 * 41:])
    assert lost.losses and len(lost.stamps) == 6
    twice = transport_stream.read_stream(stored[:188 * 40] + stored[188 * 39:])
    assert not twice.losses and len(twice.payload) == 100_000
    assert transport_stream.read_stream(b"x" * 1000).payload == b""


def recall(rows, got, k=20):
    """The share of each query's ``k`` best that was found, and the ranks' form."""
    x = np.stack(rows.embedding).astype(float)
    shares, place = [], {v: i for i, v in enumerate(rows.vec_id)}
    for q, part in got.groupby("query_id"):
        i = place[q]
        score = x @ x[i]
        score[i] = -np.inf
        best = rows.vec_id.to_numpy()[np.lexsort((rows.vec_id, -score))[:k]]
        shares.append(len(set(best) & set(part.vec_id)) / k)
        assert sorted(part["rank"]) == list(range(1, k + 1))
    assert len(shares) == sum(rows.vec_id % 20 == 0)
    return np.mean(shares)


def test_recall(spark):
    rows = duckdb.execute(f"select * from '{MORE}/embeddings.parquet' order by vec_id").df()
    assert recall(rows, run(spark, "op2_hash_index", MORE)) >= 0.9


@pytest.mark.parametrize("spread", [0.0, 0.7])
def test_recall_over_shards(spark, spread):
    """Lengths equal or log-normal; shards of 2,000 codes, of which 256 are within reach."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(8_000, 32))
    x *= (np.exp(spread * rng.normal(size=8_000)) / np.sqrt((x * x).sum(axis=1)))[:, None]
    rows = pd.DataFrame({"vec_id": np.arange(8_000), "embedding": list(x.astype("f4").tolist())})
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hash_index.nearest(df, shard_rows=2_000, query_rows=150).toPandas()
    rows["embedding"] = [np.array(v, "f4") for v in rows.embedding]
    assert recall(rows, got) >= 0.9


def test_held_out(spark):
    langs = run(spark, "op3_language_id", MORE).merge(
        duckdb.execute(f"select doc_id, lang from '{MORE}/documents.parquet'").df(), on="doc_id")
    held = langs[langs.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    toxic = run(spark, "op7_toxicity", MORE).merge(
        duckdb.execute(f"select doc_id, toxic from '{MORE}/labels.parquet'").df(), on="doc_id")
    held = toxic[toxic.held_out]
    order = held.score.rank()
    bad = held.toxic == 1
    area = (order[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert area > 0.9


class Counted(dict):
    """Counts how often its keys are looked up."""
    met = 0

    def __contains__(self, key):
        self.met += 1
        return super().__contains__(key)

    def __getitem__(self, key):
        self.met += 1
        return super().__getitem__(key)

    def get(self, *key):
        self.met += 1
        return super().get(*key)


def test_known_words_are_looked_up_once():
    tool = WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    texts = pa.array(["Éa b, b\nc. ñ##", None, "c. 12 b,"])
    flat, counts = tool.encode(texts)
    tool.codes = Counted(tool.codes)
    again, same = tool.encode(texts)
    assert flat.tolist() == again.tolist() and counts.tolist() == same.tolist()
    assert tool.codes.met == len({"Éa", "b,", "b", "c.", "ñ##", "", "12"})

"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rostrum.llm import (
    hash_index, jaccard_join, language_id, line_dedup, mixing, packing, preference_chat,
    token_counts, toxicity, transport_stream,
)
from rostrum.session import stage

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "key long, size string, line_no int, _row int, words int")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))


def table(spark, rows):
    return spark.createDataFrame(
        [(i, t, lang, s, None if t is None else len(t), 1, "x", 2, 3, 4) for i, t, lang, s in rows],
        SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    same = "one two three four five six seven eight nine ten"
    return table(spark, [
        (1, same, "en", "a"), (2, same, None, None), (2, same, None, None), (3, None, "en", "a"),
        (4, "", None, "b"), (5, " \n\n ", "en", "b"), (6, LONG, "en", "b"), (7, "hi", "de", None),
        (None, same, "en", "a"), (8, None, None, None), (9, "…!?\t<|endoftext|> É", "fr", "c"),
    ])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (6, None, 1), (None, 1, 1), (7, 0, None), (99, 0, 1)],
        "doc_id long, quality int, toxic int")


def by_id(rows):
    return sorted(rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))


def test_jaccard(spark, odd):
    rows = by_id(jaccard_join.jaccard_classes(odd))
    assert [(r.doc_id, r.class_id, r.links) for r in rows] == [
        (None, None, 0), (1, 1, 2), (2, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0), (5, 5, 0),
        (6, 6, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0)]
    kept = jaccard_join.one_of_each_class(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9]


def test_lines(spark, odd):
    rows = by_id(line_dedup.line_report(odd))
    assert [(r.doc_id, r.n_lines, r.n_kept, r.kept) for r in rows] == [
        (None, 1, 0, ""), (1, 1, 1, "0"), (2, 1, 0, ""), (2, 1, 0, ""), (3, 0, 0, ""), (4, 0, 0, ""),
        (5, 0, 0, ""), (6, 1, 1, "0"), (7, 1, 1, "0"), (8, 0, 0, ""), (9, 1, 1, "0")]
    whole = line_dedup.without_repeated_lines(odd)
    assert whole.columns == [*odd.columns, "lines_left", "lines_lost"]
    texts = {r.doc_id: (r.text, r.lines_left, r.lines_lost) for r in whole.collect()}
    assert texts[2] == ("", 0, 1) and texts[3] == (None, 0, 0) and texts[5] == (" \n\n ", 0, 0)
    assert texts[None][1:] == (1, 0) and texts[6] == (LONG, 1, 0)


def test_packing(spark, odd):
    rows = packing.packed(odd, WORDS).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 1
    assert sum(r.length for r in rows if r.doc_id == 2) == 2 * 11
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 2048


def test_mixing(spark, odd):
    rows = by_id(mixing.mixed(odd))
    assert [r.size for r in rows] == [10, 10, 10, 10, 0, 0, 0, 30_000, 1, 0, 3]
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    targets = {r.target for r in rows}
    assert sum(targets) <= 1.5 * sum(r.size for r in rows) + 1e-6
    again = by_id(mixing.mixed(odd.repartition(7)))
    assert [(r.doc_id, r.taken) for r in again] == [(r.doc_id, r.taken) for r in rows]
    taken = mixing.taken_documents(odd)
    assert taken.columns == odd.columns and taken.count() == sum(r.times for r in rows)


def test_scores(spark, odd, labels):
    rows = by_id(toxicity.scored(odd, labels))
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.without_toxic(odd, labels).columns == odd.columns
    unlabelled = toxicity.scored(odd, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in unlabelled} == {(0.0, 0)}


def test_languages(spark, odd):
    rows = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predicted(odd).collect()}
    assert len(rows) == 10
    assert all(rows[i] == ("und", 0.0) for i in (3, 4, 5, 8))
    assert rows[7][0] in {"en", "de", "fr"}
    nothing = language_id.predicted(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_streams_and_counts(spark, odd):
    rows = by_id(transport_stream.digests(
        transport_stream.read_back(transport_stream.streams(odd))))
    assert [r.payload_bytes % 64 for r in rows] == [0] * 11 and min(r.payload_bytes for r in rows) == 64
    assert len({(r.payload_sha256, r.media_sha256) for r in rows if r.n_bytes == 0}) == 1
    counts = by_id(token_counts.token_counts(odd, PIECES))
    assert [r.n_tokens for r in counts if r.n_bytes == 0] == [0, 0, 0]
    assert counts[7].over_limit and counts[7].n_bytes == len(LONG)


def test_empty_tables(spark, odd, labels):
    none = odd.limit(0)
    for result in (
        jaccard_join.jaccard_classes(none), line_dedup.line_report(none), packing.packed(none, WORDS),
        mixing.mixed(none), toxicity.scored(none, labels), language_id.predicted(none),
        token_counts.token_counts(none, PIECES),
        transport_stream.digests(transport_stream.read_back(transport_stream.streams(none))),
    ):
        assert result.count() == 0


def test_vectors(spark):
    rows = [(20 * i if i < 3 else 20 * i + 1, [float(i % 5 == k) + 0.01 * (k + 1) for k in range(4)])
            for i in range(60)]
    bad = [(2000, None), (2020, [0.0] * 4), (2040, [1.0, None, 0.0, 0.0]), (None, [1.0] * 4),
           (2060, [float("nan")] * 4), (2080, [float("inf"), 0.0, 0.0, 0.0]), (2100, []), (2120, [1.0])]
    df = spark.createDataFrame([*rows, *rows[:3], *bad], "vec_id long, embedding array<float>")
    df = df.withColumn("entry", F.lit(1)).withColumn("shard", F.lit("x"))
    got = hash_index.nearest(df).orderBy("query_id", "rank").collect()
    assert len(got) == 3 * 20 and {r.query_id for r in got} == {0, 20, 40}
    for r in (r for r in got if r["rank"] > 1):
        before = next(x for x in got if x.query_id == r.query_id and x["rank"] == r["rank"] - 1)
        assert (before.score, -before.vec_id) > (r.score, -r.vec_id)
    assert hash_index.nearest(df.limit(0)).count() == 0
    few = hash_index.nearest(df.where("vec_id < 41")).collect()
    assert len(few) == 3 * 2


def test_chats(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "good <|im_end|>"), (0, 1, "assistant", "good <|im_end|>"),
            (1, 0, "user", "x"), (1, 1, "assistant", None), (2, None, None, None), (2, 1, "assistant", "a"),
            (3, 0, "assistant", "a"), (4, 0, "user", "alone"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = preference_chat.forked_pairs(preference_chat.conversations(
        df.withColumns({"last": F.lit(1), "said": F.lit("x"), "n": F.lit(2)})))
    out = {r.conv_id: r for r in preference_chat.formatted(pairs).collect()}
    assert set(out) == {0, 1, 2, 3}
    assert out[0].prompt == "<|im_start|>user\nq<|im_end|>\n" and out[0].prefix_turns == 1
    for r in out.values():
        for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            assert [text[s.begin:s.end][-10:] for s in spans] == ["<|im_end|>"] * len(spans)
    assert out[0].chosen[out[0].chosen_spans[0].begin:out[0].chosen_spans[0].end] == \
        "good < |im_end|><|im_end|>"
    assert (out[3].prefix_turns, out[3].chosen, out[3].prompt) == (
        1, "", "<|im_start|>assistant\na<|im_end|>\n")
    assert preference_chat.formatted(
        preference_chat.forked_pairs(preference_chat.conversations(df.limit(0)))).count() == 0


def test_pipeline_on_odd_rows(spark, odd, labels, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, str(tmp_path)), name)
        assert docs.columns == odd.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0

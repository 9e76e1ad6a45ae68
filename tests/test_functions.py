"""Column expressions at their edges."""

import datetime as dt
import json
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rostrum.functions import jsontext, names, text, vectors
from rostrum.limits import CHUNK_WORDS
from rostrum.operators import chunks, intake


def test_format_names(column):
    got = column(["Mov, MP4", None, "", " webm\t"], "string", names.format_names)
    assert got == [["mov", "mp4"], [], [], ["webm"]]


def test_file_stem(column):
    given_names = ["a.webm", ".webm", "dir/b.tar.gz", "noext", "dir/c.mp3/", "..", "end.", "/x/.hid.den"]
    want = ["a", ".webm", "b.tar", "noext", "c", "..", "end", ".hid"]
    assert column(given_names, "string", names.file_stem) == want


def test_object_id_uses_utc_millis(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:07.179999' AS ts")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = rows.select(names.object_id(F.lit("job"), F.col("ts"), F.lit("x.y.webm"))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == "job_1704067207179_x.y"


def test_iso_is_the_same_in_every_zone(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (1, timestamp_ntz'2024-03-10 02:30:00.0459'), (2, timestamp_ntz'1969-12-31 23:59:59.9') AS (i, ts)"
    )
    for zone in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [r[0] for r in rows.orderBy("i").select(names.iso_utc(F.col("ts"))).collect()]
        assert got == ["2024-03-10T02:30:00.045Z", "1969-12-31T23:59:59.900Z"]


def test_client_job(column):
    assert column(["j", "", None], "string", intake.client_job) == ["j", "default", "default"]


def test_chunk_name(spark):
    rows = spark.createDataFrame(
        [("chunk_a_b_3_1704067207179.webm",), ("chunk_a_3.webm",), ("recording-2024-01-01T00:00:07.179Z.webm",)],
        "name string",
    )
    parts = names.chunk_name_parts(F.col("name"))
    got = rows.select(
        *[c.alias(n) for n, c in parts.items()], names.recording_name_time(F.col("name")).alias("at")
    ).collect()
    moment = dt.datetime(2024, 1, 1, 0, 0, 7, 179000)
    assert tuple(got[0]) == ("a_b", 3, moment, None)
    assert tuple(got[1]) == (None, None, None, None)
    assert tuple(got[2]) == (None, None, None, moment)


def test_json_quote(column):
    values = ['say "hi"', "back\\slash", "two\nlines", "äöü ☃", "a/b", "[x]", ""]
    got = column(values, "string", jsontext.json_quote)
    assert [json.loads(v) for v in got] == values
    assert got[3] == '"äöü ☃"' and got[4] == '"a/b"'


def test_strict_chunks(column):
    item = '{"summary":"s","refined_text":"- t"}'
    cases = {
        f"[{item}]": 1,
        f"```json\n[{item},\n{item}]\n```": 2,
        "[]": 0,
        f"[{item}] and [2]": None,
        f"[{item}] ]": None,
        f"[{item}],[{item}]": None,
        f"[{item}],": 1,
        f"[{item},]": None,
        f'[{item}],"w":[1]': None,
        "nothing": None,
        '[{"other":1}]': 1,
    }
    got = column(list(cases), "string", jsontext.strict_chunks)
    assert [None if v is None else len(v) for v in got] == list(cases.values())
    assert column(['[{"other":1}]'], "string", jsontext.strict_chunks)[0][0].summary is None


def test_blank(column):
    assert column([None, "", "  ", "\t\n", "\v", " a "], "string", text.is_blank) == [True] * 5 + [False]


def test_refine_line(column):
    cases = {
        "Um, so we, uh, agree.": "so we, agree.",
        "You know, I like, um, pizza": "I pizza",
        "umbrella likely ahead": "umbrella likely ahead",
        "I agree, you know.": "I agree,.",
        "um um  um": "",
        "you should know": "you should know",
        "Wait um! Now": "Wait! Now",
        "  many \t spaces ": "many spaces",
    }
    assert column(list(cases), "string", text.refine_line) == list(cases.values())


def test_refine_lines_drops_marks_and_blanks(column):
    got = column(["a\n\n[music]\n (laughs) \num\nb [x] c"], "string", text.refine_lines)
    assert got == [["a", "b [x] c"]]


def words(n, word="w"):
    return " ".join([word] * n)


def pack(column, lines, limit=CHUNK_WORDS):
    return column([lines], "array<string>", lambda x: text.pack_chunks(x, limit))[0]


def test_pack_long_lines(column):
    assert [c.words for c in pack(column, [words(140)])] == [140]
    assert [c.words for c in pack(column, [words(141)])] == [140, 1]
    assert [c.words for c in pack(column, [words(300)])] == [140, 140, 20]
    assert [c.words for c in pack(column, [words(100), words(40), words(1)])] == [140, 1]
    assert pack(column, []) == []
    assert pack(column, ["a b", "c"])[0].text == "- a b\n- c\n"


def test_pack_matches_brute_force(column):
    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.integers(1, 23), max_size=12))
    def check(sizes):
        limit, chunks, used = 7, [], 0
        for n in sizes:
            for at in range(0, n, limit):
                size = min(limit, n - at)
                if chunks and used + size <= limit:
                    chunks[-1].append(size)
                    used += size
                else:
                    chunks.append([size])
                    used = size
        got = pack(column, [words(n) for n in sizes], limit)
        assert [c.words for c in got] == [sum(c) for c in chunks]
        assert [c.text for c in got] == ["".join(f"- {words(n)}\n" for n in c) for c in chunks]

    check()


def test_first_sentence(column):
    cases = {
        "- Yes. No.\n": "Yes.",
        "- no end\n- here! Then\n": "no end here!",
        "- v1.2 is out. Done\n": "v1.2 is out.",
        "- nothing ends\n": "nothing ends",
    }
    assert column(list(cases), "string", text.first_sentence) == list(cases.values())


def test_chunk_fault(spark):
    rows = [
        ("s", "- a\n", None), (None, "- a\n", "missing_summary"), ("s", None, "missing_text"),
        ("s", f"- {words(141)}\n", "too_many_words"), ("s", f"- {words(140)}", None),
        ("s", "a\n", "line_prefix"), ("s", "- a\nb", "line_prefix"), ("s", "", "line_prefix"),
        ("s", "- ok\n- Speaker A: hi\n", "speaker_label"), ("s", "- at 10: hi\n", "speaker_label"),
        ("s", "- 10: hi\n", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, t string, want string")
    got = df.select("i", text.chunk_fault(F.col("s"), F.col("t")).alias("got"), "want").orderBy("i").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_hashed_features(column):
    import hashlib
    from collections import Counter

    sentence = "Größe, größe! the THE the 42 été"
    counts = Counter(
        int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 768
        for t in ["größe", "größe", "the", "the", "the", "été"]
    )
    got = column([sentence, "", "42 !"], "string", vectors.hashed_features)
    assert [(f.bucket, f.tf) for f in got[0]] == sorted(counts.items())
    assert got[1:] == [[], []]


def test_dense_is_unit(column):
    got = column(["the the cat", "12"], "string", lambda x: vectors.dense(vectors.hashed_features(x)))
    assert len(got[0]) == 768 and abs(sum(v * v for v in got[0]) - 1) < 1e-6
    assert got[1] == []


def test_cosine_without_direction(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<float>, b array<float>")
    got = [r[0] for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] is None and abs(got[1] - 1) < 1e-9


def test_doubled_pointers_give_the_same_chunks(spark):
    pick = random.Random(3)

    def lines(n):
        out = []
        while n > 0:
            words = min(n, pick.choice([1, 3, 9, 20, 60, 139, 140, 141, 300]))
            out.append(" ".join(f"w{pick.randrange(99)}" for _ in range(words)))
            n -= words
        return "\n".join(out)

    texts = [None, "", "\n \n", "a", " ".join("x" * 281), lines(20_000), lines(25_003), "\n".join("a" * 30_000),
             "\n".join(["b " * 70] * 9), lines(140), lines(20_000), "[noise]\n" + lines(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for limit in (140, 7, 1):
        short = docs if limit == 140 else docs.where("length(text) < 3000")
        want = sorted(map(tuple, chunks.chunked(short, ["doc_id"], limit=limit).collect()))
        got = sorted(map(tuple, chunks.chunked_long(short, ["doc_id"], limit=limit).collect()))
        assert got == want and len({r[0] for r in got}) >= 5


def test_doubled_pointers_on_arrays(column):
    lines = [None, [], ["a b c", "d"], ["a b", "c d", "e f"]]
    got = column(lines, "array<string>", lambda x: text.pack_by_pointers(x, 4))
    assert got[0] is None and got[1] == []
    assert [(c.text, c.words) for c in got[2]] == [("- a b c\n- d\n", 4)]
    assert [(c.text, c.words) for c in got[3]] == [("- a b\n- c d\n", 4), ("- e f\n", 2)]

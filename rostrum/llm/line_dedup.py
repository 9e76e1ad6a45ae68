"""Line deduplication by deletion neighbourhoods, in DataFrame functions only.

Lines are compared after lower-casing and folding white space; blank lines are
never touched. A line goes when an equal line comes earlier (by ``doc_id``, then
line number), or when an earlier line of at least ``MIN_WORDS`` words is within
one word edit of it (a word put in, left out or replaced).

1. Equal lines meet by a 128-bit hash; the earliest stands for all.
2. Of two lines one edit apart, an equal number of words at the front or at the
   back is the same (one edit can't hit both). Only lines that share such an end
   with another line can have a neighbour, and go on.
3. These emit their deletion neighbourhood: the line itself and the line without
   each of its words, as hashed keys made from running sums over the words, so a
   line of n words costs n rows and not n squared. Equal keys meet in a grouping:
   the same word left out of both is a replacement, one line equal to the other
   with a word left out is an insertion. A bucket keeps its earliest line only,
   so a bucket of any size makes no pairs.
4. The edit distance to that earliest line is verified on the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rostrum.llm.common import id_and_text
from rostrum.session import stage

MIN_WORDS = 4  # of shorter lines, only equal ones are the same
_BITS = (1 << 40) - 1  # a sum over millions of words stays far below 64 bits


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def folded(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def has_words(line: Column) -> Column:
    """Whether a line has anything but white space, so that ``folded`` isn't empty."""
    return line.rlike(r"\S")


def _word_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _ends() -> Column:
    """Hashes of the first and the last ``p`` words, ``p`` the greatest power of two
    up to half the words; lines where that has just doubled give both, but for lines
    of ``MIN_WORDS``, which no shorter line is compared with."""
    def pair(p: str) -> list[Column]:
        return [F.expr(f"xxhash64('front', {p}, substring_index(line, ' ', {p}))"),
                F.expr(f"xxhash64('back', {p}, substring_index(line, ' ', -{p}))")]

    return (
        F.when(F.col("words") < MIN_WORDS, F.array().cast("array<bigint>"))
        .when((F.col("words") == 2 * F.col("p")) & (F.col("words") > MIN_WORDS),
              F.array(*pair("p"), *pair("cast(p / 2 as int)")))
        .otherwise(F.array(*pair("p")))
    )


def first_lines(known: DataFrame) -> DataFrame:
    """Each different line once: ``doc_id, line_no`` of the earliest, and its ends."""
    lines = (
        known.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
        .where(has_words(F.col("line"))).withColumn("line", folded(F.col("line")))
        .withColumn("words", _word_count(F.col("line")))
        .withColumn("p", F.expr("cast(pow(2, floor(log2(greatest(words, 2) / 2))) as int)"))
    )
    return (
        lines.select("doc_id", "line_no", F.xxhash64(F.lit(1), "line").alias("h1"),
                     F.xxhash64(F.lit(2), "line").alias("h2"), _ends().alias("ends"))
        .groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.first("ends").alias("ends"))
        .select("at.doc_id", "at.line_no", "ends")
    )


def _candidates(known: DataFrame, firsts: DataFrame) -> DataFrame:
    """``doc_id, line_no, line`` of the lines that share an end with another line."""
    ends = firsts.select("doc_id", "line_no", F.explode("ends").alias("end"))
    shared = ends.groupBy("end").agg(F.count("*").alias("_n")).where("_n > 1")
    chosen = (
        ends.join(shared, "end").select("doc_id", "line_no").distinct()
        .groupBy("doc_id").agg(F.collect_list("line_no").alias("_chosen"))
    )
    return (
        known.join(chosen, "doc_id")
        .withColumn("_lines", lines_of(F.col("text")))
        .select("doc_id", F.explode("_chosen").alias("line_no"), "_lines")
        .select("doc_id", "line_no", folded(F.get("_lines", F.col("line_no"))).alias("line"))
        .groupBy("doc_id", "line_no").agg(F.min("line").alias("line"))
    )


def deletion_keys(lines: DataFrame) -> DataFrame:
    """``key, word_no, doc_id, line_no``: the line itself (``word_no`` -1) and the
    line without each of its words."""
    words = (
        lines.repartition("doc_id", "line_no")
        .select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("i", "word"))
    )
    for s in (1, 2):  # a word's hash at its place, and at the place before
        words = words.withColumns({
            f"a{s}": F.xxhash64(F.lit(s), "word", "i").bitwiseAND(F.lit(_BITS)),
            f"b{s}": F.xxhash64(F.lit(s), "word", F.col("i") - 1).bitwiseAND(F.lit(_BITS))})
    whole = Window.partitionBy("doc_id", "line_no")
    so_far = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = words.withColumns(
        {f"run_{c}": F.sum(c).over(so_far) for c in ("a1", "a2", "b1", "b2")}
    ).withColumns({"n": F.count("*").over(whole)} | {
        f"all_{c}": F.sum(c).over(whole) for c in ("b1", "b2")})

    def key(words: Column, *sums: Column) -> Column:
        return F.xxhash64(words, *sums)

    left_out = F.struct(F.col("i").alias("word_no"), key(F.col("n") - 1, *[
        F.col(f"run_a{s}") - F.col(f"a{s}") + F.col(f"all_b{s}") - F.col(f"run_b{s}")
        for s in (1, 2)]).alias("key"))
    itself = F.struct(F.lit(-1).alias("word_no"), key(
        F.col("n"), F.col("run_a1"), F.col("run_a2")).alias("key"))
    last = F.col("i") == F.col("n") - 1
    return summed.select("doc_id", "line_no", F.explode(
        F.when(last, F.array(left_out, itself)).otherwise(F.array(left_out))).alias("v")
    ).select("v.key", "v.word_no", "doc_id", "line_no")


def within_one_word(a: Column, b: Column) -> Column:
    """Whether at most one word edit leads from one list of words to the other."""
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), \
        F.when(F.size(a) >= F.size(b), b).otherwise(a)
    differs = F.zip_with(long, short, lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differs, True).cast("int")  # 1-based, 0: none
    rest = F.lit(1 << 30)
    return (
        F.when(F.size(long) == F.size(short), F.size(F.filter(differs, lambda d: d)) <= 1)
        .when(F.size(long) == F.size(short) + 1,
              F.slice(long, at + 1, rest) == F.slice(short, F.greatest(at, F.lit(1)), rest))
        .otherwise(False)
    )


def near_earlier(known: DataFrame, firsts: DataFrame) -> DataFrame:
    """``doc_id, line_no`` of first lines that have an earlier line within one word edit."""
    lines = stage(_candidates(known, firsts), "lines")
    keys = deletion_keys(lines).withColumn("at", F.struct("doc_id", "line_no"))
    buckets = (
        keys.groupBy("key", "word_no").agg(F.min("at").alias("at"), F.count("*").alias("n"))
        .groupBy("key").agg(
            F.collect_list(F.when((F.col("word_no") >= 0) & (F.col("n") > 1),
                                  F.struct("word_no", "at"))).alias("replaced"),
            F.min(F.when(F.col("word_no") < 0, F.col("at"))).alias("shorter"),
            F.min(F.when(F.col("word_no") >= 0, F.col("at"))).alias("longer"))
        .where("size(replaced) > 0 or (shorter is not null and longer is not null)")
    )
    earlier = F.when(F.col("word_no") < 0, F.col("longer")).otherwise(F.least(
        F.col("shorter"),
        F.get(F.filter("replaced", lambda r: r["word_no"] == F.col("word_no")), F.lit(0))["at"]))
    hits = (
        keys.join(buckets, "key").withColumn("earlier", earlier).where("earlier < at")
        .groupBy("doc_id", "line_no").agg(F.min("earlier").alias("earlier"))
    )
    other = lines.select(F.struct("doc_id", "line_no").alias("earlier"),
                         F.col("line").alias("_other"))
    return (
        hits.join(lines, ["doc_id", "line_no"]).join(other, "earlier")
        .where(within_one_word(F.split("line", " "), F.split("_other", " ")))
        .select("doc_id", "line_no")
    )


def kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, kept``: numbers, from 0, of the lines with words that stay.

    Documents of which none stays have no row, as have null and blank texts and
    rows without ``doc_id``. Rows of one ``doc_id`` are taken as copies of one
    document: a line that stays in one of them stays in all.
    """
    known = id_and_text(docs, doc_id, text).where("doc_id is not null")
    firsts = stage(first_lines(known), "first_lines")
    gone = near_earlier(known, firsts)
    return (
        firsts.select("doc_id", "line_no").join(gone, ["doc_id", "line_no"], "left_anti")
        .groupBy("doc_id").agg(F.array_sort(F.collect_list("line_no")).alias("kept"))
    )


def _blank_lines(lines: Column) -> Column:
    return F.filter(
        F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)),
        lambda i: ~has_words(F.get(lines, i)))


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its lines with words, how many stay, and the
    numbers of those that stay, as text. Null texts have no lines."""
    own = id_and_text(docs, doc_id, text)
    lines = lines_of(F.col("text"))
    counted = own.select("doc_id", F.coalesce(
        F.size(F.filter(lines, has_words)), F.lit(0)).alias("n_lines"))
    return counted.join(kept_lines(docs, doc_id, text), "doc_id", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("kept"), F.lit(0)).alias("n_kept"),
        F.coalesce(F.concat_ws(",", F.col("kept").cast("array<string>")), F.lit("")).alias("kept"))


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                           left: str = "lines_left", lost: str = "lines_lost") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``left`` and ``lost``:
    how many lines with words remain and went. Blank lines stay. A text that loses nothing is
    unchanged; null texts and rows without ``doc_id`` are returned as they are."""
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(doc_id).cast("bigint").alias("_id"), F.col(text).cast("string").alias("_text"))
    kept = kept_lines(docs, doc_id, text).withColumnRenamed("doc_id", "_id")
    joined = whole.join(kept, "_id", "left").withColumn(
        "kept", F.coalesce("kept", F.array().cast("array<int>")))
    lines = lines_of(F.col("_text"))
    stay = F.array_sort(F.array_union("kept", _blank_lines(lines)))
    total = F.coalesce(F.size(F.filter(lines, has_words)), F.lit(0))
    remain = F.when(F.col("_id").isNull(), total).otherwise(F.least(F.size("kept"), total))
    new = F.when(F.col("_text").isNull() | (remain >= total), F.col("_text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return joined.select(
        *[new.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns],
        remain.alias(left), (total - remain).alias(lost))

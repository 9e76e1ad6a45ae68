"""Transcript text: refine, chunk, summarise, check."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rostrum.functions.binding import let
from rostrum.limits import CHUNK_WORDS, FILLERS

_SINGLE = [w for w in FILLERS if " " not in w]
_DOUBLE = [tuple(w.split(" ")) for w in FILLERS if " " in w]
# Lines without such a word are left alone; most lines are.
_STARTS = "|".join(_SINGLE + [first for first, _ in _DOUBLE])
MAY_HOLD_FILLER = rf"(?i) (?:{_STARTS})[ ,.;!?]"
# A line that is only a stage mark, such as [music] or (laughs).
STAGE_MARK = r"^[\[(][^\])]*[\])]$"
FIRST_SENTENCE = r"(?s)^\s*(.*?[.!?])(?:\s|$)"
# "Speaker A: " after the line prefix.
SPEAKER_LABEL = r"(?m)^- \p{L}[\p{L}\p{N} ]{0,30}: "


def is_blank(text: Column) -> Column:
    """Null, empty, or nothing but whitespace of any kind."""
    return ~F.coalesce(text.rlike(r"\S"), F.lit(False))


def _without_fillers(line: Column) -> Column:
    """Drop filler words; a sentence end on one of them moves to the word before."""

    def drop(words: Column) -> Column:
        bare = lambda w: F.lower(F.regexp_replace(w, r"[,.;!?]+$", ""))

        def keep(w: Column, i: Column) -> Column:
            filler = bare(w).isin(_SINGLE)
            for first, second in _DOUBLE:
                after = F.coalesce(bare(F.get(words, i + 1)), F.lit(""))
                before = F.coalesce(F.lower(F.get(words, i - 1)), F.lit(""))
                filler = (
                    filler
                    | ((F.lower(w) == first) & (after == second))
                    | ((bare(w) == second) & (before == first))
                )
            return F.when(filler, F.regexp_extract(w, r"[.;!?]$", 0)).otherwise(w)

        return F.array_join(F.filter(F.transform(words, keep), lambda w: w != ""), " ")

    return let(F.split(line, " "), drop)


def refine_line(line: Column) -> Column:
    """One line without fillers and extra spaces."""
    squeezed = F.trim(F.regexp_replace(line, r"\s+", " "))
    return let(
        squeezed,
        lambda x: F.when(
            F.concat(F.lit(" "), x, F.lit(" ")).rlike(MAY_HOLD_FILLER),
            F.trim(F.regexp_replace(_without_fillers(x), r" +([.,;!?])", "$1")),
        ).otherwise(x),
    )


def refine_lines(text: Column) -> Column:
    """Dialogue lines of a transcript, refined, in order."""
    lines = F.transform(F.split(text, "\n"), refine_line)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(STAGE_MARK))


def _pieces(lines: Column, limit: int) -> Column:
    """Lines with any above ``limit`` words cut into pieces of ``limit`` words."""

    def cut(line: Column) -> Column:
        return let(
            F.split(line, " "),
            lambda words: F.transform(
                F.sequence(F.lit(0), F.floor((F.size(words) - 1) / limit).cast("int")),
                lambda i: F.struct(
                    F.array_join(F.slice(words, i * limit + 1, limit), " ").alias("line"),
                    F.least(F.lit(limit), F.size(words) - i * limit).alias("words"),
                ),
            ),
        )

    return F.flatten(F.transform(lines, cut))


def pack_chunks(lines: Column, limit: int = CHUNK_WORDS) -> Column:
    """Greedy chunks of at most ``limit`` words: ``array<struct<text, words>>``.

    Every line starts with ``- `` and ends with a newline. The walk carries the
    closed chunks and one open chunk, so the list is copied once per chunk and
    not once per line.
    """
    closed_type = "array<struct<text:string,words:int>>"
    start = F.struct(
        F.array().cast(closed_type).alias("closed"),
        F.lit("").alias("text"),
        F.lit(0).alias("words"),
    )

    def close(acc: Column) -> Column:
        return F.concat(
            acc["closed"],
            F.array(F.struct(acc["text"].alias("text"), acc["words"].alias("words"))),
        )

    def step(acc: Column, piece: Column) -> Column:
        line = F.concat(F.lit("- "), piece["line"], F.lit("\n"))
        fits = (acc["words"] == 0) | (acc["words"] + piece["words"] <= limit)
        return F.when(
            fits,
            F.struct(
                acc["closed"].alias("closed"),
                F.concat(acc["text"], line).alias("text"),
                (acc["words"] + piece["words"]).alias("words"),
            ),
        ).otherwise(
            F.struct(
                close(acc).alias("closed"),
                line.alias("text"),
                piece["words"].alias("words"),
            )
        )

    return F.aggregate(
        _pieces(lines, limit),
        start,
        step,
        lambda acc: F.when(acc["words"] == 0, acc["closed"]).otherwise(close(acc)),
    )


def pack_by_pointers(lines: Column, limit: int = CHUNK_WORDS) -> Column:
    """What ``pack_chunks`` gives, for texts of any length without copying what is packed.

    Every word is labelled with its line, which gives where each line starts in words, and
    where a chunk that starts with a line ends: at the line that holds the word ``limit``
    further on. Those jumps are followed by doubling: with the first 2^k borders and the
    jumps over 2^k chunks known, one step gives twice as many of both. Lines are joined once,
    when all borders are known. Null lines give null, no lines no chunks.
    """
    integers = lambda column: column.cast("array<int>")

    def borders(owner: Column, starts: Column) -> Column:
        """First lines of the chunks, and the number of lines behind them."""
        n_words, n_lines = F.size(owner), F.size(starts)
        jumps = F.concat(
            F.transform(starts, lambda s: F.coalesce(F.get(owner, s + limit), n_lines)), F.array(n_lines))
        # Two chunks in a row hold more than ``limit`` words.
        rounds = F.ceil(F.log2(2 * n_words / limit + 2)).cast("int")
        known = F.aggregate(
            F.sequence(F.lit(1), rounds),
            F.struct(integers(F.array(F.lit(0))).alias("first"), integers(jumps).alias("jumps")),
            lambda acc, _: F.struct(
                F.concat(acc["first"], F.transform(acc["first"], lambda i: F.get(acc["jumps"], i))).alias("first"),
                F.transform(acc["jumps"], lambda j: F.get(acc["jumps"], j)).alias("jumps")),
            lambda acc: acc["first"])
        return F.concat(F.filter(known, lambda i: i < n_lines), F.array(n_lines))

    def cut(pieces: Column, owner: Column, starts: Column, firsts: Column) -> Column:
        def chunk(k: Column) -> Column:
            first, after = F.get(firsts, k), F.get(firsts, k + 1)
            mine = F.slice(pieces, first + 1, after - first)
            return F.struct(
                F.array_join(F.transform(mine, lambda p: F.concat(F.lit("- "), p["line"], F.lit("\n"))), "").alias("text"),
                (F.coalesce(F.get(starts, after), F.size(owner)) - F.get(starts, first)).alias("words"))

        return F.transform(F.sequence(F.lit(0), F.size(firsts) - 2), chunk)

    def packed(pieces: Column) -> Column:
        owners = F.flatten(F.transform(pieces, lambda p, i: F.array_repeat(i, p["words"])))
        return let(owners, lambda owner: let(
            F.filter(F.sequence(F.lit(0), F.size(owner) - 1),
                     lambda k: (k == 0) | (F.get(owner, k) != F.get(owner, k - 1))),
            lambda starts: let(
                borders(owner, starts), lambda firsts: cut(pieces, owner, starts, firsts))))

    none = F.array().cast("array<struct<text:string,words:int>>")
    return let(_pieces(lines, limit), lambda pieces: F.when(F.size(pieces) == 0, none).otherwise(packed(pieces)))


def first_sentence(chunk: Column) -> Column:
    """One-sentence summary of a chunk: its first sentence, else all of it."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(chunk, r"(?m)^- ", ""), r"\s+", " "))
    sentence = F.regexp_extract(flat, FIRST_SENTENCE, 1)
    return F.when(sentence != "", sentence).otherwise(flat)


def word_count(chunk: Column) -> Column:
    """Words of a chunk, without the line prefix."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(chunk, r"(?m)^- ", ""), r"\s+", " "))
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, " ")))


def chunk_fault(summary: Column, chunk: Column, limit: int = CHUNK_WORDS) -> Column:
    """First broken rule of the chunk contract, or null."""
    return (
        F.when(summary.isNull(), "missing_summary")
        .when(chunk.isNull(), "missing_text")
        .when(word_count(chunk) > limit, "too_many_words")
        .when(
            (chunk == "")
            | F.exists(F.split(chunk, "\n"), lambda x: (x != "") & ~x.startswith("- ")),
            "line_prefix",
        )
        .when(chunk.rlike(SPEAKER_LABEL), "speaker_label")
    )

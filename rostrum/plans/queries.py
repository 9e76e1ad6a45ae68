"""One query per capability, bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.functions.names import (
    chunk_name_parts, format_names, object_id, recording_name_time,
)
from rostrum.functions.text import is_blank
from rostrum.functions.vectors import dense, feature_norm, hashed_features
from rostrum.limits import CHAT_HITS, HISTORY_PAGE, TRANSCRIPT_HITS, VECTOR_WIDTH
from rostrum.operators import (
    attempts, chats, chunks, frames, intake, lifecycle, postings, pruned, quality, retrieval,
    segments, transcript, vector_table,
)
from rostrum.plans import fixtures as fx, flows
from rostrum.session import scratch_path
from rostrum.sources import zones
from rostrum.sources.by_job import read_by_job, write_by_job

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DENSE_WIDTH = 64
PRUNED_BLOCK = 32
ZONE_ROWS = 500
PAUSE_SECONDS = 1800


def query(fn: Query) -> Query:
    """Register under the function's name; a trailing ``_`` avoids a clash and is dropped."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


# ---- uploads and messages


@query
def audio_manifest(spark, folder):
    return fx.manifest(fx.events(spark, folder)).drop("failed")


@query
def audio_validation(spark, folder):
    validated = intake.validate_uploads(fx.uploads(fx.events(spark, folder)))
    return validated.select("event_id", "reject_reason")


@query
def dead_letter(spark, folder):
    validated = intake.validate_uploads(fx.uploads(fx.events(spark, folder)))
    dead = intake.dead_letters(validated, F.col("failed"))
    return dead.groupBy("reject_reason").agg(F.count("*").alias("n"))


@query
def retry_dead_letter(spark, folder):
    """Failed slices come back together with a redelivery of all accepted uploads."""
    validated = intake.validate_uploads(fx.uploads(fx.events(spark, folder)))
    dead = intake.dead_letters(validated, F.col("failed")).where(
        F.col("reject_reason") == "transcription_failed"
    )
    fresh = intake.accepted(validated)
    done = fresh.where(~F.col("failed"))
    return intake.retry(dead, fresh, done, "event_id").select("event_id")


@query
def format_names_(spark, folder):
    parsed = format_names(fx.format_text())
    return fx.events(spark, folder).select(
        "event_id", F.array_join(parsed, "|").alias("formats"),
        F.size(parsed).cast("bigint").alias("n_formats"),
    )


@query
def object_id_(spark, folder):
    return fx.events(spark, folder).select(
        "event_id",
        object_id(F.col("user_id").cast("string"), F.col("ts"), fx.file_name()).alias("file_id"),
    )


@query
def chunk_name_parse(spark, folder):
    named = fx.events(spark, folder).select("event_id", fx.file_name().alias("name"))
    parts = chunk_name_parts(F.col("name"))
    return named.select(
        "event_id", *[c.alias(n) for n, c in parts.items()],
        recording_name_time(F.col("name")).alias("recorded_at"),
    )


@query
def build_job_message(spark, folder):
    return fx.message_fields(fx.events(spark, folder)).select(
        "event_id", intake.job_message().alias("message")
    )


@query
def decode_job_message(spark, folder):
    """Round trip; errors are cut short and views arrive without metadata."""
    bare = F.to_json(F.struct(F.col("job_id").alias("jobId"), F.col("file_id").alias("fileId")))
    whole = intake.job_message()
    value = (
        F.when(F.col("event_type") == "error", F.substring(whole, 1, 40))
        .when(F.col("event_type") == "view", bare)
        .otherwise(whole)
    )
    sent = fx.message_fields(fx.events(spark, folder)).select(
        "event_id", fx.props_key().alias("k"), value.alias("value")
    )
    return intake.decode_messages(sent).select(
        "event_id", "k", "decoded", "job_id", "file_id",
        F.col("metadata.originalFileName").alias("file_name"),
        F.col("metadata.size").alias("size_bytes"),
        F.array_join("metadata.formatNames", "|").alias("formats"),
        F.col("metadata.uploadTimestamp").alias("uploaded"),
    )


@query
def prompt_validation(spark, folder):
    asked = fx.turns(spark, folder).where(F.col("role") == "user")
    prompt = F.when(F.col("turn") % 4 == 2, "").when(F.col("turn") % 6 == 3, None).otherwise(F.col("text"))
    return asked.select(
        "conv_id", "turn",
        (intake.is_present(prompt) & intake.is_present(F.col("conv_id").cast("string"))).alias("valid"),
    )


@query
def nonblank_text(spark, folder):
    """Blank and spoken lines of the raw documents, per language."""
    lines = fx.documents(spark, folder).select("lang", F.explode(F.split("text", "\n")).alias("line"))
    blank = is_blank(F.col("line"))
    return lines.groupBy("lang").agg(
        F.count_if(~blank).alias("n_spoken"), F.count_if(blank).alias("n_blank")
    )


@query
def constraint_report(spark, folder):
    status = (
        F.when(F.col("event_type") == "signup", "in-progress")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("completed")
    )
    rows = fx.events(spark, folder).select(F.col("user_id").alias("job_id"), status.alias("status"))
    asked = chats.create_chats(
        fx.turns(spark, folder).where(F.col("role") == "user")
        .withColumn("text", F.when(F.col("turn") % 4 == 2, "").otherwise(F.col("text"))),
        ["conv_id", "turn"], "text",
    ).withColumnRenamed("conv_id", "job_id")
    return quality.constraint_report(rows, asked)


# ---- meetings


@query
def meetings(spark, folder):
    return lifecycle.meetings(fx.meeting_events(fx.events(spark, folder)))


@query
def meeting_status(spark, folder):
    """Status of the meeting each recorded slice belongs to."""
    ev = fx.events(spark, folder)
    rows = lifecycle.meetings(fx.meeting_events(ev))
    return lifecycle.with_status(fx.manifest(ev).select("event_id", "job_id"), rows).select(
        "event_id", "job_id", "status"
    )


@query
def meeting_status_skewed(spark, folder):
    """The same with every third event in one meeting, too many meetings to broadcast."""
    ev = fx.events(spark, folder).withColumn(
        "user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))
    rows = lifecycle.meetings(fx.meeting_events(ev))
    jobs = fx.manifest(ev).select("event_id", "job_id")
    return lifecycle.with_status(jobs, rows, broadcast_bytes=0).select("event_id", "job_id", "status")


@query
def drop_completed(spark, folder):
    ev = fx.events(spark, folder)
    rows = lifecycle.meetings(fx.meeting_events(ev))
    return lifecycle.drop_completed(fx.slices(ev), rows).select("event_id", "job_id")


def _late(spark, folder, grace):
    ev = fx.events(spark, folder)
    stops = lifecycle.stop_times(fx.meeting_events(ev))
    return lifecycle.drop_late(fx.slices(ev), stops, grace).select("event_id", "job_id")


@query
def late_drop(spark, folder):
    return _late(spark, folder, "0 seconds")


@query
def late_drop_grace(spark, folder):
    return _late(spark, folder, "6 hours")


@query
def chunk_number(spark, folder):
    rows = fx.manifest(fx.events(spark, folder)).select("event_id", "job_id", "ts")
    return transcript.number_chunks(rows, "job_id", ["ts", "event_id"]).select(
        "event_id", "job_id", "chunk_no"
    )


@query
def job_progress(spark, folder):
    rows = fx.manifest(fx.events(spark, folder)).withColumn("done", ~F.col("failed"))
    return transcript.job_progress(rows, "job_id")


@query
def tumbling_10m(spark, folder):
    rows = fx.slices(fx.events(spark, folder))
    return segments.tumbling_counts(rows, "job_id")


@query
def pause_segments(spark, folder):
    rows = fx.events(spark, folder).select(F.col("user_id").alias("job_id"), "ts")
    return segments.pause_segments(rows, "job_id", PAUSE_SECONDS)


# ---- transcripts


@query
def transcript_append(spark, folder):
    said = fx.spoken(fx.turns(spark, folder))
    return transcript.append_fragments(said, "conv_id", ["turn"]).select(
        "conv_id", "chunk_no", "text"
    )


@query
def full_transcript(spark, folder):
    tn = fx.turns(spark, folder)
    return transcript.full_transcripts(tn, fx.spoken(tn), "conv_id", ["turn"])


@query
def one_transcript(spark, folder):
    """The text of the first conversation, out of a table laid out by meeting."""
    said = fx.spoken(fx.turns(spark, folder))
    path = scratch_path(spark, "transcripts")
    write_by_job(transcript.append_fragments(said, "conv_id", ["turn"]), path, "conv_id")
    wanted = said.agg(F.min("conv_id")).first()[0]
    return transcript.transcript_of(read_by_job(spark, path, "conv_id", wanted), "conv_id", wanted)


# ---- chat


@query
def chat_pairs(spark, folder):
    return chats.chat_pairs(fx.turns(spark, folder), "conv_id", "turn")


def _answers(tn: DataFrame) -> DataFrame:
    """Answers addressed to the chat created one turn earlier."""
    return tn.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )


@query
def chat_answer_update(spark, folder):
    tn = fx.turns(spark, folder)
    created = chats.create_chats(tn.where(F.col("role") == "user"), ["conv_id", "turn"], "text")
    return chats.answer_chats(created, _answers(tn), ["conv_id", "turn"])


@query
def chat_update_errors(spark, folder):
    """Answers to a chat that was never created: every third message failed to be saved."""
    tn = fx.turns(spark, folder)
    created = chats.create_chats(
        tn.where((F.col("role") == "user") & (F.length("text") % 3 != 0)), ["conv_id", "turn"], "text"
    )
    return chats.answers_without_chat(created, _answers(tn), ["conv_id", "turn"]).select("conv_id", "turn")


@query
def chat_history_page(spark, folder):
    """Page of every conversation before a cursor, its last message."""
    rows = chat_pairs(spark, folder)
    cursor = rows.groupBy("conv_id").agg(F.max("turn").alias("before_id"))
    return chats.history_pages(rows, "conv_id", "turn", "turn", HISTORY_PAGE, cursor)


@query
def one_history_page(spark, folder):
    """The page before the last message of the longest conversation, from a laid-out table."""
    rows = chat_pairs(spark, folder)
    asked = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last")).orderBy(
        F.desc("n"), "conv_id").first()
    path = scratch_path(spark, "zoned")
    zones.write_zoned(rows, path, "conv_id", "turn", "all", rows_per_file=ZONE_ROWS)
    if asked is None:
        return rows.limit(0)
    return zones.history_page(spark, path, rows.schema, "conv_id", asked.conv_id, "turn", HISTORY_PAGE, asked.last)


@query
def chat_history_all(spark, folder):
    return chats.history_pages(chat_pairs(spark, folder), "conv_id", "turn", "turn", HISTORY_PAGE)


@query
def chat_vectors(spark, folder):
    """Points of the answered pairs; a turn stands for a minute."""
    pairs = chat_pairs(spark, folder).withColumn(
        "ts", F.timestamp_add("MINUTE", F.col("turn"), F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    )
    points = vector_table.chat_points(chats.chat_vectors(pairs), "conv_id", "turn", "ts")
    return points.select(
        "id", "job_id", "chat_id", "timestamp",
        F.md5(chats.combined_text(F.col("user_chat"), F.col("ai_chat"))).alias("text_md5"),
        F.size("vector").cast("bigint").alias("n_buckets"),
        F.round(feature_norm(F.col("vector")), 6).alias("norm"),
    )


@query
def chat_vector_orphans(spark, folder):
    pairs = chat_pairs(spark, folder)
    stored = chats.chat_vectors(pairs).select("conv_id", "turn")
    # Vectors outlive the chats whose message length is a multiple of eleven.
    kept = pairs.where(F.length("user_chat") % 11 != 0)
    return chats.vector_orphans(kept, stored, ["conv_id", "turn"])


# ---- text


@query
def refine_text(spark, folder):
    return chunks.refined(fx.spread_documents(spark, folder)).select(
        "doc_id", F.size("lines").cast("bigint").alias("n_lines"),
        F.md5(F.array_join("lines", "\n")).alias("lines_md5"),
    )


@query
def chunk_text(spark, folder):
    return chunks.chunked(fx.spread_documents(spark, folder), ["doc_id"]).select(
        "doc_id", "chunk_idx", "words", F.md5("text").alias("text_md5")
    )


@query
def chunk_long(spark, folder):
    """The chunks of ``chunk_text``, their borders found by doubled pointers."""
    return chunks.chunked_long(fx.spread_documents(spark, folder), ["doc_id"]).select(
        "doc_id", "chunk_idx", "words", F.md5("text").alias("text_md5")
    )


@query
def chunk_summary(spark, folder):
    rows = chunks.summarised(chunks.chunked(fx.spread_documents(spark, folder), ["doc_id"]))
    return rows.select("doc_id", "chunk_idx", "summary")


@query
def chunk_contract(spark, folder):
    """Produced chunks, and whole documents offered as one chunk each (index -1)."""
    docs = fx.spread_documents(spark, folder)
    made = chunks.summarised(chunks.chunked(docs, ["doc_id"])).select(
        "doc_id", "chunk_idx", "summary", "text"
    )
    whole = docs.select(
        "doc_id", F.lit(-1).cast("bigint").alias("chunk_idx"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("summary"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("- "), F.col("text")))
        .when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"),
    )
    return chunks.checked(made.unionByName(whole)).select("doc_id", "chunk_idx", "reject_reason")


@query
def chunk_profile(spark, folder):
    return chunks.chunk_profile(fx.spread_documents(spark, folder))


@query
def job_counts(spark, folder):
    return chunks.job_counts(fx.spread_documents(spark, folder), "source")


# ---- vectors


@query
def vector_contract(spark, folder):
    """Stored vectors with defects by id: empty, cut short, all zero."""
    stored = spark.read.parquet(f"{folder}/embeddings.parquet")
    vector = (
        F.when(F.col("vec_id") % 17 == 3, F.array().cast("array<float>"))
        .when(F.col("vec_id") % 17 == 5, F.slice("embedding", 1, DENSE_WIDTH - 1))
        .when(F.col("vec_id") % 17 == 7, F.transform("embedding", lambda x: (x * 0).cast("float")))
        .when(F.col("vec_id") % 17 == 9, None)
        .otherwise(F.col("embedding"))
    )
    return vector_table.contract_report(
        stored.select(F.col("label").cast("bigint").alias("job_id"), vector.alias("vector")),
        "job_id", "vector", DENSE_WIDTH,
    )


def _delivered(spark: SparkSession, folder: str, numbers) -> DataFrame:
    """Points of every document's chunks, once per number that ``numbers`` gives for its id;
    each number is a minute later than the one before."""
    docs = fx.spread_documents(spark, folder)
    docs = docs.where(F.coalesce(F.size(numbers(F.col("doc_id"))), F.lit(0)) > 0)  # others aren't cut
    rows = chunks.summarised(chunks.chunked(docs, ["doc_id", "source"]))
    delivered = rows.withColumn("seq", F.explode(numbers(F.col("doc_id")))).select(
        F.col("source").alias("job_id"), F.col("doc_id").alias("source_id"), "chunk_idx",
        "text", "summary",
        F.concat(F.lit("rec-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("seq").cast("string"),
                 F.lit(".webm")).alias("original_file_name"),
        F.timestamp_add("SECOND", F.col("doc_id") + F.col("seq") * 60,
                        F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("ts"),
        "seq",
    )
    return vector_table.transcript_points(delivered)


def _point_texts(points: DataFrame) -> DataFrame:
    return points.select(
        "id", "job_id", "filename", "upload_timestamp", F.md5("text").alias("text_md5"), "summary"
    )


@query
def vector_upsert(spark, folder):
    """Chunks of every document delivered twice, the second time for odd documents only
    with a later time; one point per chunk remains."""
    numbers = lambda doc: F.when(doc % 2 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return _point_texts(vector_table.latest_points(_delivered(spark, folder, numbers)))


@query
def merge_points(spark, folder):
    """Three deliveries merged one after the other into the buckets they touch: all
    documents, every third one later, and last those of odd number from in between."""
    path = scratch_path(spark, "merged")
    for number, step in ((0, 1), (2, 3), (1, 2)):
        chosen = lambda doc: F.when(doc % step == step - 1, F.array(F.lit(number)))
        vector_table.merge_points(_delivered(spark, folder, chosen), path)
    return _point_texts(vector_table.merged_points(spark, path))


@query
def recording_points(spark, folder):
    """Documents as the slices of their source's meeting, from event to stored point."""
    tables = flows.recordings_to_tables(fx.recordings(fx.spread_documents(spark, folder)))
    return point_report(tables.points)


def point_report(points: DataFrame) -> DataFrame:
    return points.select(
        "id", "job_id", "filename", "upload_timestamp", F.md5("text").alias("text_md5"),
        "summary", F.size("vector").cast("bigint").alias("n_buckets"),
    )


@query
def hash_embedding(spark, folder):
    rows = chunks.features(fx.spread_turns(spark, folder))
    return chunks.feature_rows(rows, ["conv_id", "turn"]).withColumn("weight", F.round("weight", 6))


@query
def dense_embedding(spark, folder):
    """The non-zero items of every turn's dense vector, and its width."""
    rows = vector_table.embed(
        fx.spread_turns(spark, folder), "text", fn=lambda text: dense(hashed_features(text))
    )
    return (
        rows.select("conv_id", "turn", F.size("vector").cast("bigint").alias("width"),
                    F.posexplode("vector").alias("bucket", "weight"))
        .where(F.col("weight") != 0)
        .select("conv_id", "turn", F.col("bucket").cast("bigint").alias("bucket"), "width",
                F.round(F.col("weight").cast("double"), 6).alias("weight"))
    )


@query
def stored_points(spark, folder):
    """Documents cut, embedded, written by meeting without empty vectors, and read back."""
    cut = chunks.summarised(chunks.chunked(fx.spread_documents(spark, folder), ["doc_id", "source"]))
    points = vector_table.embed(vector_table.transcript_points(cut.select(
        F.col("source").alias("job_id"), F.col("doc_id").alias("source_id"), "chunk_idx", "text", "summary",
        F.lit("rec.webm").alias("original_file_name"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"), F.col("doc_id").alias("seq"),
    )), "text")
    path = scratch_path(spark, "points")
    vector_table.write_points(vector_table.usable(points), path)
    stored = read_by_job(spark, path, "job_id")
    latest = vector_table.latest_points(
        vector_table.measured(stored, "vector", VECTOR_WIDTH), told_by=stored.columns)
    return vector_table.measured_report(latest, "job_id", VECTOR_WIDTH)


# ---- retrieval


@query
def one_search(spark, folder):
    """The first vector asks its own meeting, out of a table laid out by meeting."""
    stored = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("label").cast("bigint").alias("job_id"), "vec_id", F.col("embedding").alias("vector")
    )
    path = scratch_path(spark, "vectors")
    write_by_job(stored, path, "job_id")
    asked = stored.orderBy("vec_id").first()
    job, vector = (asked.job_id, asked.vector) if asked else (None, [])
    return retrieval.search(
        read_by_job(spark, path, "job_id", job), TRANSCRIPT_HITS, job="job_id", job_value=job,
        prompt=F.array(*map(F.lit, vector)).cast("array<double>"), candidate_id="vec_id",
    )


@query
def topk_chunks(spark, folder):
    """Every vector asks for the most similar others of its meeting."""
    stored = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("label").cast("bigint").alias("job_id"), "vec_id", F.col("embedding").alias("vector")
    )
    return retrieval.top_similar(
        stored, stored, TRANSCRIPT_HITS, job="job_id", prompt_id="vec_id",
        candidate_id="vec_id", exclude_self=True, size=DENSE_WIDTH,
    ).select("job_id", "prompt_id", F.col("candidate_id").alias("vec_id"), "rank", "score")


@query
def topk_pruned(spark, folder):
    """The same with blocks small enough for the given meetings to have several, of which
    those too far away are skipped."""
    stored = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("label").cast("bigint").alias("job_id"), "vec_id", F.col("embedding").alias("vector")
    )
    return pruned.top_pruned(
        stored, stored, TRANSCRIPT_HITS, job="job_id", prompt_id="vec_id", candidate_id="vec_id",
        exclude_self=True, size=DENSE_WIDTH, block_rows=PRUNED_BLOCK,
    ).select("job_id", "prompt_id", F.col("candidate_id").alias("vec_id"), "rank", "score")


def _prompt_vectors(tn: DataFrame) -> DataFrame:
    return chunks.features(fx.prompts(tn), "question")


def _snippet_hits(tn: DataFrame, before: bool = True) -> DataFrame:
    """Fragments said before the prompt, or in all of its meeting, most similar first."""
    said = chunks.features(fx.spoken(tn))
    return retrieval.top_similar(
        _prompt_vectors(tn), said, TRANSCRIPT_HITS, job="conv_id", prompt_id="prompt_turn",
        candidate_id="turn", prompt_order="prompt_turn" if before else None,
        candidate_order="turn" if before else None,
    ).withColumnsRenamed({"prompt_id": "prompt_turn", "candidate_id": "turn"})


def _chat_hits(tn: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exchanges asked before the prompt, most similar first."""
    return retrieval.top_similar(
        _prompt_vectors(tn), chats.chat_vectors(pairs), CHAT_HITS, job="conv_id",
        prompt_id="prompt_turn", candidate_id="turn",
        prompt_order="prompt_turn", candidate_order="turn",
    ).withColumnsRenamed({"prompt_id": "prompt_turn", "candidate_id": "turn"})


@query
def text_topk(spark, folder):
    return _snippet_hits(fx.spread_turns(spark, folder))


@query
def text_topk_all(spark, folder):
    return _snippet_hits(fx.spread_turns(spark, folder), before=False)


@query
def text_topk_index(spark, folder):
    """The same by posting lists per meeting and bucket, read only as far as they can matter."""
    tn = fx.spread_turns(spark, folder)
    said = chunks.features(fx.spoken(tn))
    return postings.top_by_index(
        _prompt_vectors(tn), said, postings.posting_lists(said, "conv_id", "turn"),
        TRANSCRIPT_HITS, job="conv_id", prompt_id="prompt_turn", candidate_id="turn",
    ).withColumnsRenamed({"prompt_id": "prompt_turn", "candidate_id": "turn"})


@query
def topk_chats(spark, folder):
    tn = fx.spread_turns(spark, folder)
    return _chat_hits(tn, chats.chat_pairs(tn, "conv_id", "turn"))


@query
def rag_context(spark, folder):
    """The text each prompt would be answered from."""
    tn = fx.spread_turns(spark, folder)
    return flows.prompt_contexts(
        fx.prompts(tn), fx.spoken(tn), chats.chat_pairs(tn, "conv_id", "turn"),
        job="conv_id", prompt_id="prompt_turn", question="question",
        snippet_id="turn", chat_id="turn",
    )


# ---- attempts and frames


@query
def clean_resolution(spark, folder):
    tried = fx.clean_attempts(fx.spread_turns(spark, folder))
    return attempts.resolve_cleaning(tried, ["conv_id", "turn"]).select(
        "conv_id", "turn", "attempt", "outcome",
        F.coalesce(F.size("chunks").cast("bigint"), F.lit(0)).alias("n_chunks"),
    )


@query
def clean_chunks(spark, folder):
    tried = fx.clean_attempts(fx.spread_turns(spark, folder))
    resolved = attempts.resolve_cleaning(tried, ["conv_id", "turn"])
    return attempts.cleaned_chunks(resolved, ["conv_id", "turn"])


@query
def cleaned_points(spark, folder):
    """Points of the cleaner's chunks that keep the contract; a turn stands for a minute."""
    tn = fx.spread_turns(spark, folder)
    recordings = tn.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("job_id"), F.col("turn").alias("event_id"), "text",
        F.timestamp_add("MINUTE", F.col("turn"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("ts"),
        F.concat(F.lit("rec-"), F.col("turn").cast("string"), F.lit(".webm")).alias("file_name"),
    )
    responses = fx.clean_attempts(tn).withColumnsRenamed({"conv_id": "job_id", "turn": "event_id"})
    return point_report(flows.store_cleaned(responses, recordings).points)


@query
def unembedded_transcripts(spark, folder):
    """Fragments stored as text whose cleaning failed, so that no vector exists."""
    tn = fx.spread_turns(spark, folder)
    keys = ["conv_id", "turn"]
    stored = tn.where(F.col("role") == "assistant").select(*keys)
    embedded = attempts.cleaned_chunks(
        attempts.resolve_cleaning(fx.clean_attempts(tn), keys), keys
    ).where(F.size(hashed_features(F.col("refined_text"))) > 0).select(*keys).distinct()
    return stored.join(embedded, keys, "left_anti")


@query
def answer_resolution(spark, folder):
    tried = fx.answer_attempts(fx.turns(spark, folder))
    return attempts.resolve_answers(tried, ["conv_id", "turn"])


@query
def stream_reassembly(spark, folder):
    log = fx.frames(fx.spread_turns(spark, folder))
    return frames.rebuild_answers(log, ["conv_id", "turn"])

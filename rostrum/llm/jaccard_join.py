"""Near-duplicate join on word 5-grams, candidates pruned by a posterior.

1. Texts with equal words collapse into one *text* (its least ``doc_id`` stands
   for it). 128 MinHashes of one byte each are taken per text.
2. Texts that agree in four successive bytes (32 bands) are candidates. A pair of
   Jaccard 0.8 is missed with probability ``(1 - 0.8**4)**32 < 5e-8``.
3. Each candidate is first compared with the least text of its band bucket; those
   that fail are compared with the rest of the bucket, in blocks. Bytes are
   compared 16 at a time, and a pair is dropped as soon as the posterior
   probability that its Jaccard reaches the threshold falls below ``tolerance``
   (uniform prior). Buckets give spanning edges, never their pairs.
4. The components of what is left are compared exactly, block by block, on their
   whole shingle sets. A block gives the number of links of each of its texts
   and spanning edges of the exact links; pairs are counted where they are made.

So a group of many near copies costs rows in proportion to its texts times its
blocks of ``BLOCK_TEXTS``, and no task ever holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rostrum.llm import shingles as sh
from rostrum.llm.common import batch_of, group_starts, groups_in_order, id_and_text, released
from rostrum.llm.components import components
from rostrum.session import stage

THRESHOLD = 0.8
TOLERANCE = 1e-6
STEP = 16  # bytes compared before the posterior is looked at again
BAND = 4
BLOCK_TEXTS = 512
BLOCK_SHINGLES = 400_000
BUCKET_BLOCK = 1024
_CELLS = 1 << 23


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each multiple of ``STEP`` compared bytes, the matches below which the
    posterior of ``J >= threshold`` is under ``tolerance``."""
    j = (np.arange(20_000) + 0.5) / 20_000
    p = j + (1 - j) / 256
    out = []
    for n in range(STEP, sh.HASHES + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        reach = weight[:, j >= threshold].sum(axis=1) / weight.sum(axis=1)
        out.append(int(np.argmax(reach >= tolerance)))
    return out


def surviving(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray,
              least: list[int]) -> np.ndarray:
    """Which pairs ``(left[i], right[j])`` are never dropped."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for step, need in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (left[i[alive], part] == right[j[alive], part]).sum(axis=1)
        kept = matches >= need
        alive, matches = alive[kept], matches[kept]
        if not len(alive):
            break
    out = np.zeros(len(i), bool)
    out[alive] = True
    return out


_SKETCH = pa.schema([("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                     ("words", pa.int64()), ("sig", pa.binary())])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            words, counts = sh.word_hashes(batch.column("text"))
            values, number = sh.shingles(words, counts)
            sigs = sh.signatures(values, number)
            f1, f2 = sh.fingerprints(words, counts)
            full = counts > 0
            rows = iter(sigs)
            yield batch_of(
                _SKETCH, batch.column("doc_id"), f1.view(np.int64), f2.view(np.int64), counts,
                [next(rows).tobytes() if x else None for x in full])


def _signature(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, sh.HASHES)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("text_id", pa.int64())])
    for batch in batches:
        if batch.num_rows:
            keys = _signature(batch.column("sig")).view(np.uint32).astype(np.int64)
            keys = keys + (np.arange(keys.shape[1], dtype=np.int64) << 32)
            ids = np.repeat(batch.column("text_id").to_numpy(), keys.shape[1])
            yield batch_of(schema, keys.ravel(), ids)


def _star_check(least: list[int]):
    schema = pa.schema([("text_id", pa.int64()), ("leader", pa.int64()), ("ok", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.arange(batch.num_rows)
                ok = surviving(_signature(batch.column("sig")),
                               _signature(batch.column("leader_sig")), at, at, least)
                yield batch_of(schema, batch.column("text_id"), batch.column("leader"), ok)
    return run


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of the given ones."""
    parent: dict[int, int] = {}
    out = []

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _bucket_check(least: list[int]):
    """Failed members of a bucket against its other members, two blocks at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_in_order(batches, ["key", "x", "y"]):
            starts = [*group_starts(table, ["key", "x", "y"]), table.num_rows]
            ids, sig = table.column("text_id").to_numpy(), _signature(table.column("sig"))
            failed = table.column("failed").to_numpy()
            block, x, y = (table.column(c).to_numpy() for c in ("block", "x", "y"))
            edges = []
            for s, e in zip(starts, starts[1:]):
                if x[s] == y[s]:
                    sides = [(np.flatnonzero(failed[s:e]), np.arange(e - s))]
                else:
                    one = np.flatnonzero(block[s:e] == x[s])
                    two = np.flatnonzero(block[s:e] == y[s])
                    sides = [(one[failed[s + one]], two), (two[failed[s + two]], one)]
                for u, rest in sides:
                    for part in np.array_split(u, len(u) * len(rest) // _CELLS * 16 + 1):
                        i, j = np.repeat(part, len(rest)), np.tile(rest, len(part))
                        i, j = i[i != j], j[i != j]
                        ok = surviving(sig[s:e], sig[s:e], i, j, least)
                        edges += _forest(ids[s:e][i[ok]], ids[s:e][j[ok]])
            if edges:
                yield batch_of(schema, *zip(*edges))
    return run


def _exact_links(threshold: float):
    """Links within a pair of blocks: per text their number, and spanning edges."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_in_order(batches, ["root", "x", "y"]):
            starts = [*group_starts(table, ["root", "x", "y"]), table.num_rows]
            ids, copies = table.column("text_id").to_numpy(), table.column("copies").to_numpy()
            block, x, y = (table.column(c).to_numpy() for c in ("block", "x", "y"))
            texts = table.column("text").combine_chunks()
            texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
            a, b, links = [], [], []
            for s, e in zip(starts, starts[1:]):
                owner, value, size = _sets(texts.slice(s, e - s))
                if x[s] == y[s]:
                    one = two = np.arange(e - s)
                else:
                    one = np.flatnonzero(block[s:e] == x[s])
                    two = np.flatnonzero(block[s:e] == y[s])
                both = _intersections(owner, value, one, two, e - s)
                # |A n B| >= t |A u B|, in whole numbers up to the float's own error
                total = size[one][:, None] + size[two][None, :] - both
                linked = (both > 0) & (both >= threshold * total - 1e-9)
                linked &= one[:, None] != two[None, :]
                n = copies[s:e]
                count = np.zeros(e - s, np.int64)
                count[one] += linked @ n[two]
                if x[s] != y[s]:
                    count[two] += n[one] @ linked
                full = np.flatnonzero(count)
                a += ids[s:e][full].tolist()
                b += [None] * len(full)
                links += count[full].tolist()
                i, j = np.nonzero(linked)
                for p, q in _forest(ids[s:e][one[i]], ids[s:e][two[j]]):
                    a.append(p), b.append(q), links.append(0)
            if a:
                yield batch_of(schema, a, b, links)
    return run


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, shingle)`` of every member of every set, and the set sizes."""
    words, counts = sh.word_hashes(texts)
    values, number = sh.shingles(words, counts)
    owner = np.repeat(np.arange(len(counts)), number)
    order = np.lexsort((owner, values))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    owner, values = owner[new], values[new]
    return owner, values, np.bincount(owner, minlength=len(counts))


def _intersections(owner: np.ndarray, value: np.ndarray, one: np.ndarray, two: np.ndarray,
                   texts: int) -> np.ndarray:
    """Common shingles of each pair, by products of 0/1 matrices over shingles
    (``value`` is sorted) that at least two of the texts have."""
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[shared], column[shared]
    out = np.zeros((len(one), len(two)))
    width = max(1, _CELLS // max(1, texts))
    while len(column):
        stop = int(np.searchsorted(column, column[0] + width))
        _, local = np.unique(column[:stop], return_inverse=True)
        cells = np.zeros((texts, int(local.max()) + 1), np.float32)
        cells[owner[:stop], local] = 1
        out += cells[one] @ cells[two].T
        owner, column = owner[stop:], column[stop:]
    return out


def _blocked(rows: DataFrame, blocks, salt: str) -> DataFrame:
    """Each row once for every pair of blocks ``(x, y)``, ``x <= y``, that its own is in."""
    return (
        rows.withColumn("_n", blocks)
        .withColumn("block", F.pmod(F.xxhash64(salt, F.lit(7)), "_n"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
        .withColumn("x", F.least("block", "_other")).withColumn("y", F.greatest("block", "_other"))
        .drop("_n", "_other")
    )


def jaccard_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, links``.

    ``links`` is the number of other rows whose word 5-gram sets have a Jaccard
    similarity of ``threshold`` or more, equal texts included; ``class_id`` the
    least ``doc_id`` reached over links. Null, empty and blank texts have no
    words, so no links, and are each their own class. Rows repeated whole count
    as copies; should rows of one ``doc_id`` differ, their links are added.
    A row without ``doc_id`` takes no part: null class, no links. Other columns
    are ignored.
    """
    least = least_matches(threshold, tolerance)
    own = id_and_text(docs, doc_id, text)
    known = own.where("doc_id is not null")
    sketch = stage(known.mapInArrow(released(_sketches), _ddl(_SKETCH)), "sketches")
    texts = stage(
        sketch.where("sig is not null").groupBy("f1", "f2")
        .agg(F.min("doc_id").alias("text_id"), F.count("*").alias("copies"),
             F.first("words").alias("words"), F.first("sig").alias("sig")), "texts")
    candidates = _candidate_roots(texts, least)
    counted = stage(_verified(known, texts, candidates, threshold), "links")
    roots = components(counted.where("b is not null"))
    links = counted.groupBy(F.col("a").alias("text_id")).agg(F.sum("links").alias("links"))
    found = (
        texts.select("f1", "f2", "text_id", "copies")
        .join(links, "text_id", "left")
        .join(roots.withColumnRenamed("node", "text_id"), "text_id", "left")
        .select("f1", "f2", F.coalesce("root", "text_id").alias("class_id"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    with_words = (
        sketch.where("sig is not null").select("doc_id", "f1", "f2").join(found, ["f1", "f2"])
        .select("doc_id", "class_id", "links")
    )
    none = F.lit(0).cast("bigint")
    alone = sketch.where("sig is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), none.alias("links"))
    unknown = own.where("doc_id is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), none.alias("links"))
    return with_words.unionByName(alone).unionByName(unknown)


def _candidate_roots(texts: DataFrame, least: list[int]) -> DataFrame:
    """``node, root`` of the components that pruning leaves."""
    sig = texts.select("text_id", "sig")
    bands = sig.mapInArrow(released(_bands), "key long, text_id long")
    leaders = bands.groupBy("key").agg(
        F.min("text_id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = stage(bands.join(leaders, "key").where("text_id != leader"), "buckets")
    stars = stage(
        members.select("text_id", "leader").distinct()
        .join(sig, "text_id")
        .join(sig.toDF("leader", "leader_sig"), "leader")
        .mapInArrow(released(_star_check(least)), "text_id long, leader long, ok boolean"), "stars")
    failed = members.join(stars.where("not ok"), ["text_id", "leader"]).where("n > 2")
    keys = failed.groupBy("key").agg(F.count("*").alias("fails"))
    rest = (
        members.join(keys, "key")
        .join(stars.select("text_id", "leader", (~F.col("ok")).alias("failed")),
              ["text_id", "leader"])
        .select("key", "text_id", "n", "failed").join(sig, "text_id")
    )
    pairs = (
        _blocked(rest, F.ceil(F.col("n") / BUCKET_BLOCK).cast("bigint"), "text_id").drop("n")
        .repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        .mapInArrow(released(_bucket_check(least)), "a long, b long")
    )
    ok = stars.where("ok").select(F.col("text_id").alias("a"), F.col("leader").alias("b"))
    return components(ok.union(pairs))


def _verified(known: DataFrame, texts: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Exact links of the candidate components, as ``_exact_links`` gives them."""
    nodes = roots.withColumnRenamed("node", "text_id").join(
        texts.groupBy("text_id").agg(F.max("copies").alias("copies"),
                                     F.max("words").alias("words")), "text_id")
    sizes = nodes.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("words") / BLOCK_SHINGLES),
    ).cast("bigint").alias("blocks"))
    chosen = nodes.join(sizes, "root").select("text_id", "root", "copies", "blocks")
    whole = (
        known.withColumnRenamed("doc_id", "text_id").join(chosen, "text_id")
        .groupBy("text_id").agg(*[F.min(c).alias(c) for c in ("root", "copies", "blocks", "text")])
    )
    return (
        _blocked(whole, F.col("blocks"), "text_id")
        .select("root", "x", "y", "block", "text_id", "copies", "text")
        .repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
        .mapInArrow(released(_exact_links(threshold)), "a long, b long, links long")
    )


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean",
             pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the first document of every class; all columns stay.

    Rows without ``doc_id`` stay. Of rows repeated whole one stays; should rows
    of one ``doc_id`` differ, the one of the least text stays.
    """
    kept = jaccard_classes(docs, doc_id, text).where("doc_id = class_id").select(
        F.col("doc_id").alias("_keep")).distinct()
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(doc_id).cast("bigint").alias("_keep"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    one = whole.join(kept, "_keep").groupBy("_keep").agg(F.min_by("_row", "_text").alias("_row"))
    return one.select("_row.*").unionByName(whole.where("_keep is null").select("_row.*"))

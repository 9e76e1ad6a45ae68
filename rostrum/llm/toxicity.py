"""Toxicity scores: gradient-boosted trees over dense features, calibrated.

The lexicon is counted over two thirds of the labelled training rows, dealt by a hash
of the id: words, and word beginnings of ``STEM`` letters, that are much more frequent in
toxic texts. Every text gets the features named in ``FEATURES``. Trees (Spark ML) are
fitted on these rows of a sample of at most ``FIT_ROWS`` labelled rows, chosen by hash,
and calibrated by isotonic regression on its rows of the last third, which neither the
lexicon nor the trees have seen.

Only a key and the text of a row enter Python, and only the key and the features leave
it, in portions of bounded bytes; so very long texts and wide rows cost no more memory
than others. A score depends on the text alone: equal texts, equal scores.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from rostrum.llm.common import id_and_text, released, unused_name
from rostrum.llm.toxic_features import STEM, keyed_features
from rostrum.operators.lookup import lookup
from rostrum.session import stage

FIT_ROWS = 40_000
SLICE_BITS, PARTS = 12, 8  # slices of the hash; partitions the trees are fitted on
FOLDS = 5  # rows whose crc32 of the id is 0 modulo this are never learned from
LEXICON = 2_000
MIN_TEXTS = 4  # toxic texts that a lexicon entry must occur in
TREES, DEPTH = 20, 3
_TRIM = r"^[^\p{L}\p{N}@$]+|[^\p{L}\p{N}@$]+$"


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _tokens(line: Column) -> Column:
    """Words of a text in lower case without marks around them, each once, and stems."""
    words = F.array_distinct(F.filter(
        F.transform(F.split(F.lower(line), r"\s+"), lambda w: F.regexp_replace(w, _TRIM, "")),
        lambda w: w != ""))
    stems = F.array_distinct(F.transform(
        F.filter(words, lambda w: F.length(w) > STEM),
        lambda w: F.concat(F.lit("^"), F.substring(w, 1, STEM))))
    return F.concat(words, stems)


def lexicon(labelled: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Entry -> log odds, from ``text, label``; the ``size`` most telling entries.

    Counted over all rows; what comes to the driver is bounded by ``size``.
    """
    seen = labelled.select("label", F.explode(_tokens(F.coalesce("text", F.lit("")))).alias("entry"))
    # Each entry is reduced on the map side, so a word all texts have is no hot key.
    counts = seen.groupBy("entry").agg(
        F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    totals = labelled.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("bad"),
                          F.count("*").alias("n")).first()
    bad, good = totals["bad"], totals["n"] - totals["bad"]
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    best = (
        counts.where(F.col("bad") >= MIN_TEXTS).withColumn("odds", odds).where("odds > 2")
        .orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "entry").limit(size).collect()
    )
    return {r["entry"]: float(r["odds"]) for r in best}


def described(docs: DataFrame, entries: dict[str, float]) -> DataFrame:
    """``docs`` with the vector ``features`` in place of ``text``."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    rows = docs.select(*[c for c in docs.columns if c != "text"], "text").mapInArrow(
        released(keyed_features(entries)), ", ".join([*kept, "features array<double>"]))
    return rows.withColumn("features", array_to_vector("features"))


def labelled_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id",
                  text: str = "text", label: str = "toxic") -> DataFrame:
    """``doc_id, text, label`` of the labelled documents that may be learned from.

    One row per document: a document labelled twice counts as toxic if a label says so.
    The labels meet the documents first: as long as the labelled ids can be broadcast, only
    labelled texts are shuffled.
    """
    known = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                          F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    known = known.where("doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.max("label").alias("label"))
    texts = id_and_text(docs, doc_id, text).where("doc_id is not null")
    return lookup(texts, known, ["doc_id"], "text", "inner").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("label").alias("label"))


def fit_sample(train: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The ``fit_rows`` rows of ``train`` whose ids have the least hashes.

    Counts per slice of the hash give the last slice needed, so one task orders
    ``fit_rows`` ids and those of a slice, without texts; the texts stay where they are.
    """
    ids = train.select("doc_id", F.xxhash64("doc_id", F.lit(11)).alias("at"))
    part = F.shiftright("at", 64 - SLICE_BITS)
    counts = ids.groupBy(part.alias("slice")).count().collect()  # 2 ** SLICE_BITS at most
    if sum(r["count"] for r in counts) <= fit_rows:
        return train
    taken = 0
    for last, count in sorted((r["slice"], r["count"]) for r in counts):
        taken += count
        if taken >= fit_rows:
            break
    chosen = ids.where(part <= last).orderBy("at", "doc_id").limit(fit_rows).select("doc_id")
    return train.join(F.broadcast(chosen), "doc_id")


class Model:
    """What is learned from labelled rows; ``scores`` applies it to texts."""

    def __init__(self, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id",
                 text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> None:
        train = stage(labelled_rows(docs, labels, doc_id, text, label), "labelled").withColumn(
            "part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)))
        fits = (F.col("part") > 0).alias("fits")
        seen = {(r["label"], r["fits"]): r["count"]
                for r in train.groupBy("label", fits).count().collect()}
        self.trees = None
        self.share = float(any(one == 1 for one, _ in seen))
        if len({one for one, _ in seen}) < 2:
            return
        # A third calibrates, unless that leaves too few of a class on either side.
        apart = len(seen) == 4
        self.entries = lexicon(train.where("part > 0") if apart else train)
        # Dealt by id, so that the trees don't depend on files.
        rows = stage(described(fit_sample(train, fit_rows), self.entries).repartition(
            PARTS, "doc_id").sortWithinPartitions("doc_id"), "described")
        fitted, others = (rows.where("part > 0"), rows.where("part = 0")) if apart else (rows, rows)
        if any(part.select("label").distinct().count() < 2 for part in (fitted, others)):
            fitted = others = rows  # the sample has too few of a class
        self.trees = GBTClassifier(
            featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=32,
            stepSize=0.3, seed=7, minInstancesPerNode=3, predictionCol="tree_says",
        ).fit(fitted.select("features", "label"))
        self.isotonic = IsotonicRegression(featuresCol="margin", labelCol="label").fit(
            self.trees.transform(others).select(
                _margin().alias("margin"), F.col("label").cast("double").alias("label")))

    def scores(self, texts: DataFrame) -> DataFrame:
        """``score, predicted`` in place of ``text``."""
        kept = [c for c in texts.columns if c != "text"]
        if self.trees is None:
            return texts.select(*kept, F.lit(self.share).alias("score"),
                                F.lit(int(self.share)).alias("predicted"))
        ranked = self.isotonic.transform(self.trees.transform(
            described(texts, self.entries)).withColumn("margin", _margin()))
        # Isotonic steps tie; the margin, at a thousandth, keeps the order within one.
        score = 0.999 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))) \
            + 0.001 / (1 + F.exp(-2 * F.col("margin")))
        return ranked.select(*kept, score.alias("score")).withColumn(
            "predicted", (F.col("score") >= 0.5).cast("int"))


def _margin() -> Column:
    return vector_to_array("rawPrediction")[1]


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
           label: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    A null text is an empty one, and is scored like one; a row without ``doc_id`` is
    scored and not held out; a row repeated whole gives as many rows. Without labelled
    rows of both classes the score is 1 if all labels are toxic, else 0. Labels other
    than 0 and 1, and of documents that aren't there, are left out, and so are other
    columns. An empty table gives an empty one.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label"))
    model = Model(docs, known, doc_id, text, "label", fit_rows)
    return model.scores(id_and_text(docs, doc_id, text)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id",
                  text: str = "text", label: str = "toxic") -> DataFrame:
    """``docs`` without the rows whose text is scored at 0.5 or more; all columns stay.

    The rows themselves stay where they are: texts are scored under two hashes of theirs,
    and rows that share both with a toxic one go. As long as the hashes of the toxic texts
    can be broadcast, no row is shuffled. See ``scored`` for nulls and odd labels.
    """
    key = [F.xxhash64(F.lit(n), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
           for n in (1, 2)]
    names = [unused_name(docs, f"_toxic{n}") for n in (1, 2)]
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label"))
    texts = docs.select(*[k.alias(n) for k, n in zip(key, names)],
                        F.col(f"`{text}`").cast("string").alias("text"))
    toxic = Model(docs, known, doc_id, text, "label").scores(texts).where("predicted = 1")
    return lookup(docs.withColumns(dict(zip(names, key))), toxic.select(*names).distinct(),
                  names, text, "left_anti").drop(*names)

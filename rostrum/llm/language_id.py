"""Language identification in two steps: family first, then the language within it.

Texts become relative frequencies of byte n-grams (one to three bytes of lower-case
letters, other characters as spaces) hashed to ``WIDTH`` places, under a square root
and of length one. One-versus-one linear support vector machines (Spark ML) tell
families apart, and within the chosen family one-versus-one machines tell its
languages apart, so closely related languages are only ever compared with each other.
They are fitted on at most ``PER_LANGUAGE`` labelled texts a language, chosen by hash;
every whole text is predicted.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from rostrum.llm.common import id_and_text
from rostrum.session import stage

FOLDS, HELD_OUT = 4, 2
PER_LANGUAGE = 1_000
WIDTH = 2_048
UNKNOWN = "und"
# Families of language codes; a code that isn't here is its own family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi bn pa gu mr ne ur si or as",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"={lang}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _letters_only() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    table[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


_LETTERS = _letters_only()


def profiles(texts: pa.Array) -> np.ndarray:
    """One row of features per text; a null or letterless text gives zeros."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), WIDTH), np.float32)
    data = np.frombuffer(" ".join(["", *texts.to_pylist(), ""]).encode(), np.uint8)
    data = _LETTERS[data].astype(np.uint32)
    # A space stands before and after each text, so no n-gram holds letters of two.
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    body = data[1:-1] if len(sizes) else data[:0]
    body = np.append(body, np.uint32(32))[:len(owner)]
    before = np.concatenate([[32], body[:-1]]).astype(np.uint32) if len(body) else body
    after = np.append(body[1:], np.uint32(32)).astype(np.uint32) if len(body) else body
    letter = body != 32
    mixed = [
        (body * np.uint32(2654435761)) >> np.uint32(7),
        ((body << np.uint32(8) | after) * np.uint32(2246822519)) >> np.uint32(9),
        (((before << np.uint32(16)) | (body << np.uint32(8)) | after) * np.uint32(3266489917))
        >> np.uint32(11),
    ]
    cells = out.ravel()
    for h in mixed:
        at = owner[letter] * WIDTH + (h[letter] % np.uint32(WIDTH)).astype(np.int64)
        cells += np.bincount(at, minlength=len(cells)).astype(np.float32)
    np.sqrt(out, out)
    out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)
    return out


class Duels:
    """One-versus-one linear machines over names."""

    def __init__(self, names: list[str], machines: dict[tuple[str, str], tuple]) -> None:
        self.names = names
        self.pairs = [(names.index(a), names.index(b)) for a, b in machines]
        self.weights = np.array([w for w, _ in machines.values()]).reshape(len(machines), WIDTH)
        self.shift = np.array([c for _, c in machines.values()])

    def decide(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner of each row and how sure: most duels won, then the larger margins."""
        if not self.pairs:
            return np.zeros(len(rows), int), np.ones(len(rows))
        margin = rows @ self.weights.T + self.shift  # positive: the first of the pair
        won = np.zeros((len(rows), len(self.names)))
        for k, (a, b) in enumerate(self.pairs):
            first = margin[:, k] > 0
            size = 1 - 1e-3 / (1 + np.abs(margin[:, k]))
            won[:, a] += first * size
            won[:, b] += ~first * size
        best = won.argmax(axis=1)
        sure = np.ones(len(rows))
        for k, (a, b) in enumerate(self.pairs):
            for side, sign in ((a, 1), (b, -1)):
                chance = 1 / (1 + np.exp(-2 * np.clip(sign * margin[:, k], -30, 30)))
                sure = np.where(best == side, np.minimum(sure, chance), sure)
        return best, sure


def _fit(rows: DataFrame, column: str, names: list[str]) -> Duels:
    """A machine for each two of ``names``, values of ``column``."""
    machines = {}
    for a, b in combinations(names, 2):
        both = rows.where(F.col(column).isin(a, b)).select(
            "features", (F.col(column) == a).cast("double").alias("label"))
        model = LinearSVC(maxIter=25, regParam=1e-3, standardization=False,
                          aggregationDepth=2).fit(both)
        machines[a, b] = (model.coefficients.toArray(), model.intercept)
    return Duels(names, machines)


def training_rows(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int) -> DataFrame:
    """``lang, family, text`` of the labelled texts to learn from."""
    known = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.col(lang).cast("string").alias("lang"),
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id")
    # Only ids are ranked, with a limit per task; texts are read for the chosen ones.
    chosen = (
        known.where(~held_out(F.col("doc_id"))).select("doc_id", "lang")
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
        .select("doc_id", "lang").distinct()
    )
    return known.join(F.broadcast(chosen), ["doc_id", "lang"])


def predicted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
              per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score``.

    ``und`` with score 0 where the text is null or has no letter, and everywhere if
    there is nothing to learn from; a single language learned is predicted always. A
    row without ``doc_id`` is predicted and not held out. Other columns are ignored.
    """
    spark = docs.sparkSession
    own = id_and_text(docs, doc_id, text)
    features = F.arrow_udf(lambda t: _lists(profiles(t)), "array<float>")
    train = training_rows(docs, doc_id, text, lang, per_language)
    train = stage(train.select("lang", features("text").alias("values")), "profiles")
    langs = sorted(r["lang"] for r in train.select("lang").distinct().collect())
    held = held_out(F.col("doc_id")).alias("held_out")
    if not langs:
        return own.select("doc_id", held, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    families = sorted({family(x) for x in langs})
    names = spark.createDataFrame([(x, family(x)) for x in langs], "lang string, family string")
    rows = train.join(F.broadcast(names), "lang").select(
        "lang", "family", array_to_vector("values").alias("features"))
    by_family = _fit(rows, "family", families)
    within = [_fit(rows, "lang", [x for x in langs if family(x) == f]) for f in families]

    def decide(texts: pa.Array) -> pa.Array:
        said, sure = [], []
        for start in range(0, len(texts), 500):
            points = profiles(texts.slice(start, 500)).astype(float)
            group, chance = by_family.decide(points)
            name = np.empty(len(points), object)
            for g, duels in enumerate(within):
                mine = np.flatnonzero(group == g)
                best, p = duels.decide(points[mine])
                name[mine] = np.array(duels.names, object)[best]
                chance[mine] *= p
            said.extend(name), sure.extend(chance)
        return pa.StructArray.from_arrays(
            [pa.array(said, pa.string()), pa.array(sure, pa.float64())], ["lang", "score"])

    answer = F.arrow_udf(decide, "lang string, score double")("text")
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return own.withColumn("answer", answer).select(
        "doc_id", held, F.when(lettered, F.col("answer.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(lettered, F.col("answer.score")).otherwise(0.0).alias("score"))


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * WIDTH
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))

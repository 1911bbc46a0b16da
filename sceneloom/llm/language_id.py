"""Language identification by a string kernel.

The kernel is the normalised presence kernel of the blended spectrum: how many hashed character n-grams (n up to
MAX_N) two texts share, over the root of the product of what each has. Nyström landmarks stand for the training texts,
and a kernel ridge regression for each language against the rest is solved on them. As a score is
K(x, landmarks) @ alpha and K is a product of presence vectors, landmarks and alpha fold into one matrix, and a batch of
documents is scored by one product of its presence matrix with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tidy

MAX_N = 4
BUCKETS = 1 << 14
#: Bounds of the sample that the classifier is fitted on, and of the landmarks among it.
TRAIN_ROWS = 2000
LANDMARKS = 300
RIDGE = 1e-2
UNKNOWN = "und"
#: Languages beyond this number (rarest first) aren't learned.
MAX_LANGUAGES = 256
_ROWS, _CHARS = 128, 1 << 20
_MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


def presence(texts: list[str]) -> np.ndarray:
    """Row per text: which n-gram buckets occur in it, over the whole text in lower case."""
    found = np.zeros((len(texts), BUCKETS), bool)
    for row, text in enumerate(texts):
        for at in range(0, max(len(text), 1), _CHARS):
            points = np.frombuffer(text[at : at + _CHARS + MAX_N - 1].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            grams = np.zeros(len(points), np.uint32)
            for n in range(1, min(MAX_N, len(points)) + 1):
                grams = grams[: len(points) - n + 1] * np.uint32(31) + points[n - 1 :] * np.uint32(_MIX[n - 1])
                mixed = (grams ^ grams >> np.uint32(15)) * np.uint32(0x2C1B3C6D) + np.uint32(n)
                found[row, mixed >> np.uint32(18)] = True
    return found


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, found: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(found.sum(1), 1)).astype(np.float32)
        return found.astype(np.float32) @ self.weights / norm[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, values = [], []
        for at in range(0, len(texts), _ROWS):
            part = [t or "" for t in texts[at : at + _ROWS]]
            raw = self.scores(presence(part)) if self.languages else np.zeros((len(part), 1), np.float32)
            best = raw.argmax(1)
            for text, row, k in zip(part, raw, best.tolist(), strict=True):
                known = bool(self.languages) and has_letter(text)
                names.append(self.languages[k] if known else UNKNOWN)
                values.append(float(np.clip((row[k] + 1) / 2, 0, 1)) if known else 0.0)
        return names, values


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _unit(found: np.ndarray) -> np.ndarray:
    return found.astype(np.float32) / np.sqrt(np.maximum(found.sum(1, keepdims=True), 1)).astype(np.float32)


def fit(found: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström kernel ridge regression; the first rows of each language, turn by turn, are the landmarks."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    seen: dict[str, int] = {}
    turn = []
    for i, label in enumerate(labels):
        turn.append((seen.get(label, 0), label, i))
        seen[label] = seen.get(label, 0) + 1
    marks = [i for _, _, i in sorted(turn)[:landmarks]]
    at = _unit(found[marks])
    inner = (at @ at.T).astype(np.float64)
    # Rows go in parts, as all of them in floats would fill the driver.
    z = np.ones((len(found), len(marks) + 1))
    for row in range(0, len(found), _ROWS):
        z[row : row + _ROWS, :-1] = _unit(found[row : row + _ROWS]) @ at.T
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Each language weighs the same, however many rows it has.
    w = np.array([1.0 / seen[x] for x in labels])[:, None]
    penalty = np.zeros((len(marks) + 1, len(marks) + 1))
    penalty[:-1, :-1] = inner
    penalty += 1e-6 * np.eye(len(penalty))
    alpha = np.linalg.solve(z.T @ (w * z) + ridge * penalty, z.T @ (w * y))
    return Model(languages, (at.T @ alpha[:-1]).astype(np.float32), alpha[-1].astype(np.float32))


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on at most `rows` labelled rows that aren't held out, as evenly over the languages as there are rows, chosen by a seeded hash of the id."""
    known = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    known = known.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return fit(np.zeros((0, BUCKETS), bool), [])
    share = max(1, rows // len(counts))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30)).alias("u")
    limits = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int((1 << 30) * min(1.0, (share + 3 * share**0.5) / r["n"]))))])
    sample = known.withColumn("u", draw).where(F.col("u") < F.try_element_at(limits, F.col("lang"))).select("doc_id", "text", "lang", "u")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                packed = [r.tobytes() for r in np.packbits(presence(batch.column("text").to_pylist()), axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("doc_id").cast(pa.string()), batch.column("lang"), pa.array(packed, pa.binary())], names=["u", "doc_id", "lang", "bits"])

    # 2 * rows rows of BUCKETS bits at most reach the driver.
    got = sample.mapInArrow(tidy(bits), "u bigint, doc_id string, lang string, bits binary").limit(2 * rows).collect()
    got.sort(key=lambda r: (r["u"], r["doc_id"] or "", r["lang"], bytes(r["bits"])))
    taken: dict[str, int] = {}
    chosen = []
    for r in got:
        if any(r["bits"]) and taken.get(r["lang"], 0) < share:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            chosen.append(r)
    labels = [r["lang"] for r in chosen]
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in chosen), np.uint8).reshape(len(chosen), BUCKETS // 8)
    del got, chosen
    return fit(np.unpackbits(packed, axis=1).view(bool), labels, landmarks)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with _lang_pred and _score (0 to 1; 0.5 is where a language's own regression is undecided).

    A null text and one without a letter is `und` with score 0, and so is every text where no language was learned.
    Columns of docs with these two names are replaced; repeated rows are predicted alike; whole texts are read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("_lang_pred", "_score")]
    text_at = names.index(text_col)
    plain = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in plain.schema], "_lang_pred string", "_score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                languages, scores = shared.value.predict(batch.column(text_at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "_lang_pred", "_score"])

    return plain.mapInArrow(tidy(run), schema).toDF(*names, "_lang_pred", "_score")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.3) -> DataFrame:
    """docs without the rows that no language claims: `und`, and those where even the best regression says "rest" clearly."""
    return identify(docs, model, text_col).where((F.col("_lang_pred") != UNKNOWN) & (F.col("_score") >= min_score)).drop("_lang_pred", "_score")


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; ids that are null count as empty text where folds are drawn."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    got = identify(docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs, text_col).alias("text")), model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))

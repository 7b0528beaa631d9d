"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the ``profile_size`` most frequent n-grams (1 to 4 characters, inside words
padded by a boundary) in rank order. A document's own profile is compared with that of each
language by the out-of-place distance: the sum of the rank differences, ``profile_size`` for an
n-gram the language lacks. The nearest language wins, ties go to the smaller name.

Profiles are counted over at most about ``fit_rows`` labelled documents of each language, chosen by
a hash of the id in proportion to the language's count; below that all are used. Every document is
scored over its whole text.

Defined results: a null text or one without a letter is ``und`` with score 0; rows without a label
are not learned from; a null id counts as held out; with nothing to learn from all rows are ``und``;
repeated rows are scored each. Only the named columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import shielded, stored
from .words import mix, slices

UNKNOWN = "und"
FIT_ROWS = 5_000
PROFILE_SIZE = 1_000
_HASH_SPACE = 1 << 30
_CHAR_BASE = np.uint64(0x100000001B3)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_codes(text: str) -> np.ndarray:
    """Sorted codes of all n-grams of a text, one for each occurrence."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.concatenate(([0], np.where(_letters()[points], points, 0), [0])).astype(np.uint64)
    points = points[(points > 0) | np.append(True, points[:-1] > 0)]  # one boundary between words
    n = len(points)
    if n < 3:
        return np.empty(0, np.uint64)
    inner = points > 0
    found, code, whole = [], points, inner
    with np.errstate(over="ignore"):
        found.append(mix(points[inner] + np.uint64(1)))
        for size in range(2, min(4, n) + 1):
            code = code[:-1] * _CHAR_BASE + points[size - 1 :]
            if size > 2:
                whole = inner[1 : n - size + 2] if size == 3 else whole[:-1] & inner[2 : n - size + 3]
                found.append(mix(code[whole] + np.uint64(size)))
            else:
                found.append(mix(code + np.uint64(size)))
    out = np.concatenate(found)
    out.sort()
    return out


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and their counts."""
    head = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[head], np.diff(np.append(head, len(codes)))


def _held_out(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def _count_grams(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(gram_codes(text))
            for lang, found in by_lang.items():
                codes = np.concatenate(found)
                if len(codes):
                    codes.sort()
                    value, n = counted(codes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(value)), pa.array(value.view(np.int64)), pa.array(n)],
                        names=["lang", "gram", "n"],
                    )


def fit_profiles(
    labelled: DataFrame, fit_rows: int = FIT_ROWS, profile_size: int = PROFILE_SIZE
) -> dict[str, np.ndarray]:
    """Ranked n-gram codes of each language from rows (doc_id, text, lang).

    Returned to the driver: ``profile_size`` numbers for each language.
    """
    rows = labelled.select("doc_id", "text", "lang").where(
        "text is not null and lang is not null and doc_id is not null"
    )
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    share = F.create_map(
        *[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, fit_rows / n) * _HASH_SPACE))]
    )
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(_HASH_SPACE)) < share[F.col("lang")]
    counts = stored(
        rows.where(chosen)
        .select("lang", "text")
        .mapInArrow(_count_grams, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    profiles = {}
    for lang in sorted(sizes):
        top = counts.where(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(profile_size)
        found = [r.gram for r in top.select("gram", "n").collect()]
        if found:
            profiles[lang] = np.array(found, dtype=np.int64).view(np.uint64)
    return profiles


class Profiles:
    """All profiles as one sorted list of n-grams with their rank in each language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names, self.size = sorted(profiles), size
        every = [profiles[x] for x in self.names]
        self.grams = np.unique(np.concatenate(every)) if every else np.empty(0, np.uint64)
        self.rank = np.full((len(self.grams) + 1, len(self.names)), -1, dtype=np.int64)
        for k, own in enumerate(every):
            self.rank[np.searchsorted(self.grams, own), k] = np.arange(len(own))

    def nearest(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (its share of the closeness to all languages) and distance in 0 to 1."""
        codes = gram_codes(text) if text and self.names else ()
        if not len(codes):
            return UNKNOWN, 0.0, 1.0
        grams, n = counted(codes)
        top = grams[np.argsort(-n, kind="stable")[: self.size]]
        at = np.searchsorted(self.grams, top)
        known = self.grams[np.minimum(at, len(self.grams) - 1)] == top
        rank = self.rank[np.where(known, at, len(self.grams))]
        away = np.abs(rank - np.arange(len(top))[:, None])
        distance = np.where(rank < 0, self.size, away).sum(axis=0) / (self.size * len(top))
        best = int(distance.argmin())
        near = 1 - distance
        score = near[best] / near.sum() if near.sum() > 0 else 0.0
        return self.names[best], float(score), float(distance[best])


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], keep=("doc_id",)) -> DataFrame:
    """The ``keep`` columns with lang_pred, score and distance for each whole text."""
    size = max([len(x) for x in profiles.values()], default=1)
    model = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, size))
    fields = {x.name: x.dataType.simpleString() for x in docs.schema.fields}
    schema = ", ".join(f"`{x}` {fields[x]}" for x in keep)

    def run(batches):
        for batch in batches:
            found = [model.value.nearest(x) for x in batch.column("text").to_pylist()]
            made = [pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), *[pa.float64()] * 2))]
            made = made or [pa.array([], t) for t in (pa.string(), pa.float64(), pa.float64())]
            kept = [batch.column(x) for x in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, *made], names=[*keep, "lang_pred", "score", "distance"]
            )

    rows = docs.select(*dict.fromkeys((*keep, "text")))
    return rows.mapInArrow(run, schema + ", lang_pred string, score double, distance double")


def learn_and_identify(docs: DataFrame, folds: int = 5, keep=("doc_id",)) -> DataFrame:
    """Learn from the rows outside fold 0 and score all rows; adds held_out."""
    held_out = _held_out(F.col("doc_id"), folds)
    profiles = fit_profiles(docs.where(~held_out))
    return identify(docs, profiles, keep).withColumn("held_out", held_out)


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents in a learned language; those without letters or without any known n-gram go."""
    inner, columns = shielded(docs, "doc_id", "text", "lang")
    found = learn_and_identify(inner, keep=tuple(inner.columns))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("distance") < 1)).select(*columns)

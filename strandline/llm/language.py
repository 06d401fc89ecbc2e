"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its
three letters' vectors, each permuted by its place, by multiplication. A text's
vector bundles (adds) its trigrams' vectors, a language's prototype bundles its
texts' vectors, and a text gets the language whose prototype has the greatest
cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import kernels, shared

DIM = 512
SYMBOLS = 64
_GRAMS = SYMBOLS**3
UNKNOWN = "und"
_SEED = 20_240_229
#: Counts of a row's trigrams that are held at once, and trigrams whose vectors are: they bound a worker's memory.
CELLS, AT_ONCE = 8_000_000, 16_384


def _letter_table() -> np.ndarray:
    """Symbol of each code point: 0 none, 1-26 a-z, 27-63 any other letter by a hash of its code point."""
    t = np.zeros(0x110000, np.uint8)
    others = np.fromiter((cp for cp in range(128, len(t)) if chr(cp).isalpha()), np.int64)
    t[others] = 27 + (others * 2654435761 % (1 << 32) >> 7) % (SYMBOLS - 27)
    for i in range(26):
        t[97 + i] = t[65 + i] = i + 1
    return t


class Space:
    """Letter vectors, and trigram vectors made from them on demand."""

    def __init__(self, dim: int = DIM):
        self.table = _letter_table()
        draw = np.random.Generator(np.random.PCG64(_SEED))
        self.letters = (draw.integers(0, 2, (SYMBOLS, dim)) * 2 - 1).astype(np.float32)
        self._twice, self._once = np.roll(self.letters, 2, axis=1), np.roll(self.letters, 1, axis=1)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        return self._twice[grams >> 12] * self._once[grams >> 6 & 63] * self.letters[grams & 63]

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text vectors, whether each text has a letter)."""
        low = [(t or "").lower() for t in texts]
        sizes = np.fromiter(map(len, low), np.int64, len(low)) + 1
        points = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.table[points]
        doc = np.repeat(np.arange(len(low), dtype=np.int64), sizes)
        keep = sym > 0
        keep[1:] |= keep[:-1].copy()  # of a run without letters, its first place stays as a word's border
        sym, doc = sym[keep].astype(np.int64), doc[keep]
        if not len(sym):
            return np.zeros((len(low), self.letters.shape[1]), np.float32), np.zeros(len(low), bool)
        before, after = np.concatenate(([0], sym[:-1])), np.concatenate((sym[1:], [0]))
        mid = sym > 0
        grams, doc = (before[mid] << 12) | (sym[mid] << 6) | after[mid], doc[mid]
        out = np.zeros((len(low), self.letters.shape[1]), np.float32)
        cuts = np.searchsorted(doc, np.arange(len(low) + 1))
        self._add(out, grams, doc, cuts, 0, len(low))
        return out, np.diff(cuts) > 0

    def _add(self, out: np.ndarray, grams: np.ndarray, doc: np.ndarray, cuts: np.ndarray, i: int, j: int) -> None:
        """Bundle rows [i, j): counts of their trigrams times the trigrams' vectors, in halves while there are too many counts."""
        mine = grams[cuts[i] : cuts[j]]
        there = np.flatnonzero(np.bincount(mine, minlength=_GRAMS))
        if (j - i) * len(there) > CELLS and j - i > 1:
            self._add(out, grams, doc, cuts, i, (i + j) // 2)
            self._add(out, grams, doc, cuts, (i + j) // 2, j)
            return
        column = np.zeros(_GRAMS, np.int32)
        column[there] = np.arange(len(there))
        counts = np.bincount((doc[cuts[i] : cuts[j]] - i) * len(there) + column[mine], minlength=(j - i) * len(there)).astype(np.float32).reshape(j - i, len(there))
        for c in range(0, len(there), AT_ONCE):
            out[i:j] += counts[:, c : c + AT_ONCE] @ self.vectors(there[c : c + AT_ONCE])


_SPACE: list[Space] = []


def space() -> Space:
    if not _SPACE:
        _SPACE.append(Space())
    return _SPACE[0]


def held_out(id_col: str = "doc_id"):
    """Whether a document is held out: crc32 of its id as text, mod 3, is 1. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The prototype of each non-null language, from every row of ``df``.

    Each task bundles its rows; the bundles are added up in Spark. What reaches
    the driver is one vector per language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for s in kernels.slices(b, "text"):
                vectors, _ = space().bundle(s.column("text").to_pylist())
                langs = np.array(s.column("lang").to_pylist(), dtype=object)
                for lang in set(langs.tolist()):
                    part = vectors[langs == lang].astype(np.float64).sum(axis=0)
                    sums[lang] = sums[lang] + part if lang in sums else part
        rows = [(k, i, v) for k, x in sums.items() for i, v in enumerate(x.tolist())]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.float64()), strict=True)], names=["lang", "i", "v"])

    src = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    parts = src.mapInArrow(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    rows = parts.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v")).collect()
    found = {r.lang: np.array(r.v) for r in rows}
    return {k: found[k] / n for k in sorted(found) if (n := np.linalg.norm(found[k]))}


def classify(df: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row.

    ``score`` is the cosine with the winning prototype, 0 if it is negative. A
    null text, a text without a letter, or any text when nothing was learned is
    ``und`` with score 0; of equal cosines the first language by name wins; each
    repeated row gets its result; extra columns are not read.
    """
    names = list(prototypes)
    matrix = np.stack([prototypes[k] for k in names]).astype(np.float32) if names else np.zeros((0, DIM), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in kernels.slices(b, "text"):
                texts = s.column("text").to_pylist()
                vectors, some = space().bundle(texts)
                norms = np.linalg.norm(vectors, axis=1)
                cosines = vectors @ matrix.T / np.maximum(norms, 1e-9)[:, None]
                best = cosines.argmax(axis=1) if names else np.zeros(len(texts), np.int64)
                some &= bool(names) & np.array([t is not None for t in texts])
                score = np.where(some, np.clip(cosines[np.arange(len(texts)), best], 0, 1) if names else 0.0, 0.0)
                langs = [names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), some.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn prototypes from the rows that are not held out and classify all rows."""
    return classify(df, learn(df.filter(~held_out(id_col)), text_col, lang_col), id_col, text_col)


def save_prototypes(spark, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """The prototypes as a table in the shared folder: lang, vector."""
    rows = [(k, [float(x) for x in v]) for k, v in prototypes.items()]
    return shared.materialise(spark.createDataFrame(rows, "lang string, vector array<double>"), "prototypes")

"""Document quality by co-training two views.

One classifier sees only a text's content: which words and characters occur and
how its lines are laid out. The other sees only what a page's record says, and
nothing of the text: its language, its source and its recorded length. Over a
few rounds each labels the unlabelled documents that it is sure of for the other
to learn from. Each view's score is then calibrated on labelled documents by
views that were fitted without them, fold by fold, and the two calibrated
log-odds are combined to score all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import kernels, shared

#: Bounds of the labelled documents that the classifiers are fitted and calibrated on: their number, and their text in bytes.
MOST_LABELLED, MOST_LABELLED_BYTES = 6_000, 60_000_000
#: Distinct words, those of the least hashes, that an unlabelled document teaches by; all of its words are scored.
MOST_DOC_WORDS = 1_000
#: Languages, and sources, that the metadata view knows by name, the most frequent ones of what it is fitted on; the rest are one.
MOST_NAMES = 256
#: Parts of the labelled documents, each of which is scored by views fitted on the others to calibrate them.
FOLDS = 4
ROUNDS = 3
#: Pseudo-labels that a view gives per class and round for a table of POOL documents, and the least confidence it needs.
PER_ROUND, POOL, SURE = 200, 4_000, 0.95
#: The most pseudo-labels of a class, a view and a round: the views are fitted on the driver, on a bounded number of documents.
MOST_TAUGHT = 50_000
#: Words of the fitted vocabulary, by how well they tell the classes apart.
MOST_WORDS = 20_000
LEAST_DOCS = 3
#: Standard deviations from chance that a word's counts need to be listed.
LEAST_WORTH = 2.5
#: Documents with a lower score are rejected.
ACCEPT = 0.5
#: Text bytes that are made into views at once; their columns take many times as much.
VIEW_BYTES = 1_000_000

_WORD = kernels.member_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_CLASSES = np.zeros(256, np.int64)
_CLASSES[[*range(97, 123)]] = 1
_CLASSES[[*range(65, 91)]] = 2
_CLASSES[[*range(48, 58)]] = 3
_CLASSES[[32, 9]] = 4
_CLASSES[10] = 5
_CLASSES[[ord(c) for c in ".,;:?'"]] = 6
_CLASSES[[ord(c) for c in "!#$%&*|@^~_=+<>{}[]/\\"]] = 7
_CLASSES[128:] = 8
_N_CONTENT, _N_LENGTH = 14, 2


def _mean_square(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.concatenate(([0.0], np.cumsum(x)))
    square = np.concatenate(([0.0], np.cumsum(x * x)))
    n = np.maximum(1, hi - lo)
    mean = (total[hi] - total[lo]) / n
    return mean, np.sqrt(np.maximum(0, (square[hi] - square[lo]) / n - mean**2))


@dataclass
class Views:
    """Both views of some documents; words are distinct hashes in rows of a ragged array."""

    words: np.ndarray
    offs: np.ndarray
    content: np.ndarray
    length: np.ndarray
    hashed: np.ndarray


def _name(value: object) -> int:
    """A number for a category; null is a category of its own."""
    return xxhash.xxh64_intdigest(repr(value).encode()) >> 1


def views(text: pa.Array, lang: list, source: list, n_chars: np.ndarray) -> Views:
    """``n_chars`` is the recorded length, NaN where there is none."""
    data, offs = kernels.text_buffer(text)
    n = len(offs) - 1
    size = np.maximum(1, np.diff(offs)).astype(np.float64)
    doc = np.repeat(np.arange(n), np.diff(offs))
    shares = np.bincount(doc * 9 + _CLASSES[data], minlength=9 * n).reshape(n, 9) / size[:, None] if n else np.zeros((0, 9))
    first, end = kernels.runs(_WORD[data], offs)
    lo, hi = kernels.per_document(first, offs)
    word_mean, word_dev = _mean_square((end - first).astype(np.float64), lo, hi)
    h = kernels.span_hashes(data, first, end, kernels.LOWER)
    rows = np.repeat(np.arange(n, dtype=np.int64), hi - lo)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[new], rows[new]
    distinct = np.bincount(rows, minlength=n)
    line = data != 10
    lf, le = kernels.runs(line, offs)
    llo, lhi = kernels.per_document(lf, offs)
    mean, dev = _mean_square((le - lf).astype(np.float64), llo, lhi)
    lh = kernels.span_hashes(data, lf, le)
    lrow = np.repeat(np.arange(n, dtype=np.int64), lhi - llo)
    order = np.lexsort((lh, lrow))
    a, b = lh[order], lrow[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lines = np.maximum(1, lhi - llo)
    unique = np.bincount(b[fresh], minlength=n) / lines
    dense = [shares[:, 1], shares[:, 2], shares[:, 3], shares[:, 6], shares[:, 7], word_mean / 10, word_dev / 10, distinct / np.maximum(1, hi - lo)]
    dense += [np.log1p(lines) / 5, np.log1p(mean) / 5, np.log1p(dev) / 5, unique, shares[:, 5] * 10, np.diff(offs) == 0]
    content = np.column_stack(dense).astype(np.float64) if n else np.zeros((0, _N_CONTENT))
    unknown = np.isnan(n_chars)
    length = np.column_stack([np.log1p(np.where(unknown, 0, np.maximum(n_chars, 0))) / 10, unknown]).astype(np.float64) if n else np.zeros((0, _N_LENGTH))
    hashed = np.array([[_name(x), _name(y)] for x, y in zip(lang, source, strict=True)], np.int64).reshape(n, 2)
    return Views(h, np.concatenate(([0], np.cumsum(distinct))), content, length, hashed)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 30) -> np.ndarray:
    """Newton's method for a penalised logistic regression; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Indicators of which of a column's bins a value is in, so that a linear model can follow any shape."""
    return np.concatenate([(x[:, j : j + 1] > edges[:, j][None, :]).astype(np.float64) for j in range(x.shape[1])], axis=1)


@dataclass
class ContentView:
    """Naive-Bayes-scaled logistic regression over words and character shares."""

    vocab: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    ratio: np.ndarray = field(default_factory=lambda: np.zeros(0))
    edges: np.ndarray = field(default_factory=lambda: np.zeros((0, _N_CONTENT)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _sparse(self, v: Views) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(v.offs) - 1), np.diff(v.offs))
        if not len(self.vocab):
            return rows[:0], rows[:0]
        at = np.minimum(np.searchsorted(self.vocab, v.words), len(self.vocab) - 1)
        known = self.vocab[at] == v.words
        return rows[known], at[known]

    def fit(self, v: Views, y: np.ndarray, weight: np.ndarray) -> ContentView:
        n = len(y)
        rows = np.repeat(np.arange(n), np.diff(v.offs))
        words, inverse = np.unique(v.words, return_inverse=True)
        docs = np.bincount(inverse, minlength=len(words))
        good = np.bincount(inverse, (y * weight)[rows], len(words))
        bad = np.bincount(inverse, ((1 - y) * weight)[rows], len(words))
        n_good, n_bad = (y * weight).sum(), ((1 - y) * weight).sum()
        ratio = np.log((good + 1) / (n_good + 2)) - np.log((bad + 1) / (n_bad + 2))
        # how many standard deviations the classes' counts are from what chance gives
        share = n_bad / max(1e-9, n_good + n_bad)
        seen = good + bad
        worth = np.abs(bad - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
        pick = np.flatnonzero((docs >= LEAST_DOCS) & (worth >= LEAST_WORTH))
        pick = np.sort(pick[np.argsort(-worth[pick], kind="stable")[:MOST_WORDS]])
        self.vocab, self.ratio = words[pick], np.clip(ratio[pick], -4, 4)
        self.edges = np.quantile(v.content, np.linspace(0.05, 0.95, 10), axis=0) if n else np.zeros((10, _N_CONTENT))
        r, c = self._sparse(v)
        dense = _binned(v.content, self.edges)
        k = len(self.vocab)
        w, m, u = np.zeros(k + dense.shape[1] + 1), 0.0, 0.0
        x = self.ratio[c]
        total = max(1.0, weight.sum())
        for step in range(1, 301):  # Adam
            z = np.bincount(r, x * w[c], n) + dense @ w[k:-1] + w[-1]
            e = weight * (_sigmoid(z) - y) / total
            g = np.concatenate((np.bincount(c, x * e[r], k), dense.T @ e, [e.sum()])) + 1e-4 * np.append(w[:-1], 0)
            m, u = 0.9 * m + 0.1 * g, 0.999 * u + 0.001 * g * g
            w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        return self

    def score(self, v: Views) -> np.ndarray:
        k = len(self.vocab)
        r, c = self._sparse(v)
        z = np.bincount(r, self.ratio[c] * self.weights[c], len(v.offs) - 1)
        return z + _binned(v.content, self.edges) @ self.weights[k:-1] + self.weights[-1]


@dataclass
class MetadataView:
    """Logistic regression over language, source and recorded length."""

    edges: np.ndarray = field(default_factory=lambda: np.zeros((0, _N_LENGTH)))
    names: list[np.ndarray] = field(default_factory=list)  # known languages and sources, in order
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _matrix(self, v: Views) -> np.ndarray:
        cells = [_binned(v.length, self.edges)]
        for known, own in zip(self.names, v.hashed.T, strict=True):
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            hot = np.zeros((len(own), len(known) + 1))  # the last cell is for all others
            hot[np.arange(len(own)), np.where(known[at] == own, at, len(known)) if len(known) else 0] = 1
            cells.append(hot)
        return np.column_stack(cells)

    def fit(self, v: Views, y: np.ndarray, weight: np.ndarray) -> MetadataView:
        self.edges = np.quantile(v.length, np.linspace(0.05, 0.95, 10), axis=0) if len(y) else np.zeros((10, _N_LENGTH))
        self.names = []
        for own in v.hashed.T:
            found, count = np.unique(own, return_counts=True)
            self.names.append(np.sort(found[np.lexsort((found, -count))[:MOST_NAMES]]))
        self.weights = _fit_dense(self._matrix(v), y, weight, 1.0)
        return self

    def score(self, v: Views) -> np.ndarray:
        return self._matrix(v) @ self.weights[:-1] + self.weights[-1]


@dataclass
class Model:
    """Both fitted views and the weights that calibrate and combine them."""

    content: ContentView
    metadata: MetadataView
    combine: np.ndarray  # of the two views' scores, and an intercept
    single: np.ndarray  # slope and intercept of each view alone

    def scores(self, v: Views) -> np.ndarray:
        """Columns: combined, content, metadata; each a probability that the document is good."""
        a, b = self.content.score(v), self.metadata.score(v)
        both = _sigmoid(np.column_stack([a, b]) @ self.combine[:2] + self.combine[2])
        return np.column_stack([both, _sigmoid(a * self.single[0, 0] + self.single[0, 1]), _sigmoid(b * self.single[1, 0] + self.single[1, 1])])


def _take(v: Views, rows: np.ndarray) -> Views:
    n = np.diff(v.offs)[rows]
    at = np.repeat(v.offs[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return Views(v.words[at], np.concatenate(([0], np.cumsum(n))), v.content[rows], v.length[rows], v.hashed[rows])


def _append(a: Views, b: Views) -> Views:
    return Views(np.concatenate((a.words, b.words)), np.concatenate((a.offs, a.offs[-1] + b.offs[1:])), *(np.concatenate((getattr(a, c), getattr(b, c))) for c in ("content", "length", "hashed")))


def co_train(v: Views, label: np.ndarray, fold: np.ndarray, rounds: int = ROUNDS, per_round: int = PER_ROUND, sure: float = SURE, pool_of: Pool | None = None) -> Model:
    """Fit both views. ``label`` is 1 good, 0 bad, -1 unlabelled; ``fold`` deals labelled rows into parts for calibration.

    With ``pool_of`` the unlabelled documents are those of a table: in each
    round it appends the ones that a view is sure of to ``v``. What the views
    taught each other stays when they are fitted anew without a part of the
    labelled rows, which they then score; those scores calibrate and combine.
    """
    train, pool = np.flatnonzero(label >= 0), np.flatnonzero(label < 0)
    given: dict[str, dict[int, float]] = {"content": {}, "metadata": {}}  # what each view is taught: row to label

    def fit(view, own: np.ndarray):
        taught = given["content" if isinstance(view, ContentView) else "metadata"]
        extra = np.array(sorted(taught), np.int64)
        y = np.concatenate((label[own].astype(np.float64), [taught[r] for r in extra.tolist()]))
        return view.fit(_take(v, np.concatenate((own, extra))), y, np.concatenate((np.ones(len(own)), np.full(len(extra), 0.5))))

    def both(own: np.ndarray) -> tuple[ContentView, MetadataView]:
        return fit(ContentView(), own), fit(MetadataView(), own)

    for _ in range(rounds):
        content, metadata = both(train)
        if pool_of is not None:
            v = pool_of.teach(content, metadata, v, given)
            continue
        for teacher, pupil in ((content, "metadata"), (metadata, "content")):
            left = np.array([r for r in pool if r not in given[pupil]], np.int64)
            p = _sigmoid(teacher.score(_take(v, left)))
            for side, y in ((p, 1.0), (1 - p, 0.0)):
                top = np.argsort(-side, kind="stable")[:per_round]
                given[pupil].update({int(left[i]): y for i in top if side[i] >= sure})
    # each labelled row is scored by views that have not seen it; a part without which a class is gone is scored by the views of all rows
    content, metadata = both(train)
    unseen = np.column_stack([view.score(_take(v, train)) for view in (content, metadata)])
    for f in sorted(set(fold[train].tolist())):
        own, out = train[fold[train] != f], fold[train] == f
        if len(set(label[own].tolist())) == 2:
            unseen[out] = np.column_stack([view.score(_take(v, train[out])) for view in both(own)])
    y, one = label[train].astype(np.float64), np.ones(len(train))
    return Model(content, metadata, _fit_dense(unseen, y, one, 0.1), np.stack([_fit_dense(s[:, None], y, one, 0.1) for s in unseen.T]))


def good_label(quality: Column, toxic: Column) -> Column:
    """1 if a document is of quality and not toxic, 0 if it is not, null if neither label is there."""
    return F.when(quality.isNull() & toxic.isNull(), None).otherwise(((F.coalesce(quality, F.lit(1)) == 1) & (F.coalesce(toxic, F.lit(0)) == 0)).cast("int"))


_FEATURES = "key bigint, label int, fold int, words binary, content array<double>, length array<double>, hashed array<bigint>"


def _columns(df: DataFrame) -> list[Column]:
    """text, lang, source and recorded length as the views read them; a column that is missing reads as null."""
    have = set(df.columns)
    lang, source = (F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("lang", "source"))
    chars = F.col("n_chars").cast("double") if "n_chars" in have else F.lit(None).cast("double")
    return [F.col("text"), lang, source, F.coalesce(chars, F.lit(float("nan"))).alias("__chars")]


def _batch_views(s: pa.RecordBatch) -> Views:
    return views(s.column("text"), s.column("lang").to_pylist(), s.column("source").to_pylist(), np.asarray(s.column("__chars")))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows in slices of at most VIEW_BYTES of text; at its end its worker returns what memory is free."""
    kernels.let_go()
    for b in batches:
        yield from kernels.slices(b, "text", VIEW_BYTES)
    kernels.give_back()


def _features(rows: DataFrame) -> tuple[Views, np.ndarray, np.ndarray]:
    """Both views, labels and folds of rows (key, label, fold, text, lang, source, length), in the keys' order.

    Of rows that share a key the least is taken, whatever order they come in.
    """
    names = ["text", "lang", "source", "__chars"]
    one = rows.groupBy("key", "label", "fold").agg(F.min(F.struct(*names)).alias("r")).select("key", "label", "fold", "r.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _small(batches):
            v = _batch_views(s)
            most = np.where(np.asarray(s.column("label")) < 0, MOST_DOC_WORDS, len(v.words))
            words = [v.words[a : min(e, a + m)].tobytes() for a, e, m in zip(v.offs[:-1], v.offs[1:], most, strict=True)]
            yield pa.RecordBatch.from_arrays([s.column("key"), s.column("label"), s.column("fold"), pa.array(words, pa.binary()), *[pa.array(list(x), pa.list_(t)) for x, t in ((v.content, pa.float64()), (v.length, pa.float64()), (v.hashed, pa.int64()))]], names=["key", "label", "fold", "words", "content", "length", "hashed"])

    got = one.mapInArrow(run, _FEATURES).toArrow().sort_by("key")
    words = [np.frombuffer(x, np.uint64) for x in got["words"].to_pylist()]
    stack = lambda c, n: np.array(got[c].to_pylist()).reshape(-1, n)
    v = Views(np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate(([0], np.cumsum([len(x) for x in words]))).astype(np.int64), stack("content", _N_CONTENT), stack("length", _N_LENGTH), stack("hashed", 2).astype(np.int64))
    return v, np.asarray(got["label"]), np.asarray(got["fold"])


def _to_driver(df: DataFrame) -> pa.Table:
    return df.toArrow()


#: The order of what is sure, coarse first: steps of confidence, its exact value, then leading bits of the key. A step has at most some thousand values within one of the step before.
_STEPS = 8_192


def _digits(sure: Column, key: Column) -> list[Column]:
    lost = F.round((1 - sure) * 1e9).cast("bigint")
    return [F.floor(lost / (1e9 * (1 - SURE) / _STEPS)).cast("bigint"), lost, F.shiftright(key, 50), F.shiftright(key, 36)]


def surest(rows: DataFrame, most: int, lessons: int) -> list[list[int]]:
    """The keys of the ``most`` surest rows (lesson, key, sure) of each lesson, ties by key.

    Counts by steps of confidence say up to where all are taken, and in which
    step the rest lie; that is cut finer until it holds no more than ``most``.
    So the driver gets counts, and at most twice as many rows as it takes.
    """
    rows = rows.select("lesson", "key", "sure", *[d.alias(f"d{i}") for i, d in enumerate(_digits(F.col("sure"), F.col("key")))])
    cuts: dict[int, list[int]] = {i: [] for i in range(lessons)}  # the digits so far of the last one that is taken
    whole: dict[int, Column] = {}
    need = dict.fromkeys(cuts, most)
    for depth in range(4):
        inside = F.lit(False)
        for i in need:
            match = F.col("lesson") == i
            for d, x in enumerate(cuts[i]):
                match &= F.col(f"d{d}") == x
            inside |= match
        if not need:
            break
        got = _to_driver(rows.filter(inside).groupBy("lesson", F.col(f"d{depth}").alias("d")).agg(F.count(F.lit(1)).alias("n"))).to_pylist()
        for i in list(need):
            counts = sorted((r["d"], r["n"]) for r in got if r["lesson"] == i)
            above, last, n = 0, None, 0
            for x, n in counts:
                last = x
                if above + n >= need[i]:
                    break
                above += n
            taken = F.col("lesson") == i
            for d, x in enumerate(cuts[i]):
                taken &= F.col(f"d{d}") == x
            under = taken & (F.col(f"d{depth}") < last) if last is not None else F.lit(False)
            if last is None or n <= most or depth == 3:
                # the step itself is small enough to be sent whole
                whole[i] = whole.get(i, F.lit(False)) | (taken & (F.col(f"d{depth}") <= last) if last is not None else F.lit(False))
                del need[i]
            else:
                whole[i] = whole.get(i, F.lit(False)) | under
                need[i] -= above
                cuts[i].append(last)
    taken = F.lit(False)
    for c in whole.values():
        taken |= c
    out: list[list[tuple]] = [[] for _ in range(lessons)]
    for r in _to_driver(rows.filter(taken).select("lesson", "key", "sure")).to_pylist():
        out[r["lesson"]].append((-r["sure"], r["key"]))
    return [[k for _, k in sorted(x)[:most]] for x in out]


#: Who is taught by which view, and what.
_LESSONS = (("metadata", "content", 1.0), ("metadata", "content", 0.0), ("content", "metadata", 1.0), ("content", "metadata", 0.0))


class Pool:
    """All unlabelled documents of a table; equal documents are one, known by a hash of what the views read.

    Each round scores the whole table where it is and writes down the confident
    ones, by hash and score. Counts by confidence find those that are taught, and
    only these and their features reach the driver. Their number per lesson grows
    with the root of the table's rows, up to MOST_TAUGHT.
    """

    def __init__(self, docs: DataFrame, known: DataFrame):
        key = F.xxhash64(*_columns(docs))
        self._rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), *_columns(docs))
        self._known = known.select("doc_id")
        self.per_round = min(MOST_TAUGHT, int(np.ceil(PER_ROUND * max(1.0, (docs.count() / POOL) ** 0.5))))
        self._at: dict[int, int] = {}  # key to row of the views

    def teach(self, content: ContentView, metadata: MetadataView, v: Views, given: dict[str, dict[int, float]]) -> Views:
        """Add to ``given`` what each view is surest of among all documents that its pupil does not have yet; returns ``v`` with their rows."""
        spark = self._rows.sparkSession
        row_key = {r: k for k, r in self._at.items()}
        had = [(i, row_key[r]) for i, (pupil, _, _) in enumerate(_LESSONS) for r in given[pupil]]

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in _small(batches):
                x = _batch_views(s)
                p, q = (np.round(_sigmoid(view.score(x)), 9) for view in (content, metadata))
                out = pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("key"), pa.array(p), pa.array(q)], names=["doc_id", "key", "content", "metadata"])
                yield out.filter(pa.array(np.maximum(np.abs(p - 0.5), np.abs(q - 0.5)) >= SURE - 0.5))

        slim = self._rows.mapInArrow(scored, "doc_id bigint, key bigint, content double, metadata double").join(self._known, "doc_id", "left_anti")
        # rows of one key have one score; copies meet as one row of each task
        one = slim.groupBy("key").agg(F.min("content").alias("content"), F.min("metadata").alias("metadata"))
        sides = [F.struct(F.lit(i).alias("lesson"), (F.col(teacher) if y else 1 - F.col(teacher)).alias("sure")) for i, (_, teacher, y) in enumerate(_LESSONS)]
        rows = one.select("key", F.explode(F.array(*sides)).alias("x")).select("key", "x.*").filter(F.col("sure") >= SURE)
        if had:
            taught = spark.createDataFrame(pa.table({"lesson": pa.array([i for i, _ in had], pa.int32()), "key": pa.array([k for _, k in had], pa.int64())}))
            rows = rows.join(F.broadcast(taught), ["lesson", "key"], "left_anti")
        rows = shared.materialise(rows, "sure")
        picked = surest(rows, self.per_round, len(_LESSONS))
        shared.drop(spark, rows)
        fresh = sorted({k for keys in picked for k in keys} - self._at.keys())
        if fresh:
            ids = spark.createDataFrame(pa.table({"key": pa.array(fresh, pa.int64())}))
            none = F.lit(-1).cast("int")
            more, _, _ = _features(self._rows.drop("doc_id").join(F.broadcast(ids), "key").withColumns({"label": none, "fold": none}))
            self._at.update({k: len(v.offs) - 1 + i for i, k in enumerate(fresh)})
            v = _append(v, more)
        for (pupil, _, y), keys in zip(_LESSONS, picked, strict=True):
            given[pupil].update({self._at[k]: y for k in keys})
        return v


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model | None:
    """Fit on a bounded sample of labelled documents, taken by a hash of the id, and on all unlabelled ones; None without both classes.

    Of differing labels of an id the worse counts, of its rows the least one. A
    document that would take the sample over MOST_LABELLED_BYTES is passed over.
    """
    known = labels.select("doc_id", good_label(F.col("quality"), F.col("toxic")).alias("label")).filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).groupBy("doc_id").agg(F.max("size").alias("size"))
    drawn = known.join(sized, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).collect()
    left, some = MOST_LABELLED_BYTES, []
    for r in drawn:
        if r["size"] <= left:
            left -= r["size"]
            some.append((r.doc_id, r.label))
    chosen = docs.sparkSession.createDataFrame(some, "doc_id bigint, label int")
    rows = docs.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("bigint").alias("key"), *_columns(docs), "label", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold"))
    v, label, fold = _features(rows)
    if len(set(label.tolist())) < 2:
        return None
    return co_train(v, label, fold, pool_of=Pool(docs, known))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, content_score, metadata_score, keep for each row's whole text; without a model all are kept at 1.

    A null or empty text has no words and is judged by what is left, a missing
    language, source or length is a value of its own; repeated rows get equal
    scores; an empty table gives an empty result; extra columns are not read.
    """
    if model is None:
        one = F.lit(1.0)
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), one.alias("score"), one.alias("content_score"), one.alias("metadata_score"), F.lit(True).alias("keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _small(batches):
            p = model.scores(_batch_views(s))
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), *(pa.array(c, pa.float64()) for c in p.T), pa.array(p[:, 0] >= ACCEPT, pa.bool_())], names=["doc_id", "score", "content_score", "metadata_score", "keep"])

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_columns(docs))
    return src.mapInArrow(run, "doc_id bigint, score double, content_score double, metadata_score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows, with all their columns, that the fitted model accepts; rows are judged where they are, with no shuffle."""
    model = model or fit(docs, labels)
    if model is None:
        return docs

    @F.arrow_udf("boolean")
    def accepted(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kernels.let_go()
        for columns in parts:
            batch = pa.RecordBatch.from_arrays(list(columns), names=["text", "lang", "source", "__chars"])
            good = [model.scores(_batch_views(s))[:, 0] >= ACCEPT for s in kernels.slices(batch, "text", VIEW_BYTES)]
            yield pa.array(np.concatenate([np.zeros(0, bool), *good]), pa.bool_())
        kernels.give_back()

    return docs.filter(accepted(*_columns(docs)))

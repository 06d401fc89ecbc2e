"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ten consecutive benchmark words (a shorter item is one
window). Patterns of one length share a shift table keyed by blocks of two
words: a block that ends no window lets the search jump ahead, a block that ends
some windows leads to a bucket of them, and the words themselves are compared.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import kernels, shared

WINDOW = 10
#: Benchmark text that one pass searches for at once; more is searched in several passes.
BLOCK_CHARS = 4_000_000

# word characters are 0-9, a-z after lower-casing A-Z, and every byte of a non-ASCII character
_TO_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class Matcher:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.windows: dict[tuple[bytes, ...], set[int]] = defaultdict(set)

    def add(self, window: list[bytes], item: int) -> None:
        self.windows[tuple(window)].add(item)

    def build(self) -> Matcher:
        self.least = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], set[int]]]] = defaultdict(list)
        for w, items in self.windows.items():
            for end in range(self.block, self.length + 1):
                key = w[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.least), self.length - end)
            self.buckets[w[-self.block :]].append((w, items))
        return self

    def search(self, seq: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(first word, items) of each occurrence of a window."""
        m, b, shift, least, n = self.length, self.block, self.shift, self.least, len(seq)
        end = m
        while end <= n:
            key = tuple(seq[end - b : end])
            jump = shift.get(key, least)
            if jump:
                end += jump
                continue
            head = tuple(seq[end - m : end])
            for w, items in self.buckets[key]:
                if w == head:
                    yield end - m, items
            end += 1


def matchers(items: Iterable[tuple[int, str | None]], window: int = WINDOW) -> list[Matcher]:
    """One matcher for each window length among (item_id, text)."""
    by: dict[int, Matcher] = {}
    for item, text in items:
        seq = words(text)
        n = min(window, len(seq))
        for i in range(len(seq) - n + 1 if n else 0):
            by.setdefault(n, Matcher(n)).add(seq[i : i + n], item)
    return [m.build() for m in by.values()]


def scan(text: str | None, tables: list[Matcher]) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(words, merged hit ranges of words, items that occur)."""
    seq = words(text)
    found: set[int] = set()
    ranges: list[tuple[int, int]] = []
    for m in tables:
        for start, items in m.search(seq):
            found |= items
            ranges.append((start, start + m.length))
    return len(seq), merge(ranges), found


def merge(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def items_digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _items(bench: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The distinct items (i, t), and in how many blocks of at most BLOCK_CHARS characters (one item at least) they are searched for."""
    sized = bench.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t is not null and i is not null").distinct()
    total = sized.agg(F.sum(F.length("t"))).first()[0] or 0
    return sized, max(1, -(-int(total) // BLOCK_CHARS))


def _block(items: DataFrame, k: int, n: int) -> list[tuple[str, str]]:
    """The k-th of n blocks. Only one is on the driver at a time."""
    return sorted((r.i, r.t) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect())


_TABLES: dict[tuple[str, int], list[Matcher]] = kernels.kept()


def _tables(name: str, block: list[tuple[str, str]], window: int) -> list[Matcher]:
    """A block's search tables, made once by each worker."""
    if (name, window) not in _TABLES:
        _TABLES.clear()
        _TABLES[name, window] = matchers(block, window)
    return _TABLES[name, window]


def _named(block: list[tuple[str, str]]) -> str:
    return hashlib.sha256(repr(block).encode("utf-8", "surrogatepass")).hexdigest()


_RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
_HITS = "row bigint, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"


def _searcher(block: list[tuple[str, str]], window: int, whole: bool):
    """With ``whole`` a result for each row, else the hits of the rows that have some."""
    name = _named(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(name, block, window)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                got = [scan(t, tables) for t in part.column("text").to_pylist()]
                if whole:
                    hit = [sum(e - s for s, e in r) for _, r, _ in got]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _, _ in got], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for _, _, i in got], pa.int64()), pa.array([items_digest(i) for _, _, i in got], pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], names=[x.split()[0] for x in _RESULT.split(", ")])
                    continue
                rows = [(k, n, [s for s, _ in r], [e for _, e in r], sorted(i)) for k, (n, r, i) in zip(part.column("row").to_pylist(), got, strict=True) if r]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _HITS.split(", ")])

    return run


def _merged_hits(texts: DataFrame, items: DataFrame, n: int, window: int) -> DataFrame:
    """row, n_words, n_hit, items of each (row, text) with hits, searched block by block; ``row`` is known by what is in it."""
    hits = None
    for k in range(n):
        part = shared.materialise(texts.mapInArrow(_searcher(_block(items, k, n), window, whole=False), _HITS), "hits")
        hits = part if hits is None else hits.unionByName(part)
    merged = hits.groupBy("row").agg(F.max("n_words").alias("n_words"), F.collect_set(F.struct("starts", "ends")).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    spans = F.array_sort(F.flatten(F.transform("r", lambda x: F.arrays_zip(x["starts"], x["ends"]))))
    # how many words the union of the sorted ranges covers
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))
    covered = F.aggregate(spans, zero, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("bigint"), x["ends"] - F.greatest(x["starts"], a["upto"]))).alias("n"), F.greatest(a["upto"], x["ends"]).alias("upto")), lambda a: a["n"])
    return merged.select("row", "n_words", covered.alias("n_hit"), "items")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Benchmark windows in each row's whole text.

    Returns doc_id, n_words, n_hit (words inside any occurrence of a window),
    n_items, items_sha256, contaminated. A null or wordless text has no words
    and no hits; repeated rows get equal results, one each; an empty benchmark
    finds nothing; a null item is no item, a repeated item counts once; extra
    columns are not read. A benchmark over BLOCK_CHARS is searched for block by
    block: the driver holds one block, each costs a pass over the documents, and
    a row's hits of all blocks are merged. With one block there is no shuffle.
    """
    items, n = _items(bench, item_col, item_text_col)
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    if n == 1:
        return src.mapInArrow(_searcher(_block(items, 0, 1), window, whole=True), _RESULT)
    keyed = src.withColumn("row", F.xxhash64("text"))
    hits = shared.materialise(_merged_hits(keyed.select("row", "text").filter("text is not null"), items, n, window), "merged")
    counted = keyed.mapInArrow(_count_words, "row bigint, doc_id bigint, n_words bigint")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(hits.drop("n_words"), "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.size(found).cast("bigint").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in kernels.slices(b, "text"):
            yield pa.RecordBatch.from_arrays([s.column("row"), s.column("doc_id"), pa.array([len(words(t)) for t in s.column("text").to_pylist()], pa.int64())], names=["row", "doc_id", "n_words"])


def drop_contaminated(docs: DataFrame, bench: DataFrame, most: float = 0.0, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows, with all their columns, of whose words at most the fraction ``most`` lies in benchmark windows.

    A null or wordless text is kept. Hits of all of the benchmark's blocks count
    together, however many there are. With one block rows are judged where they
    are, with no shuffle; with several, the texts that go are known by a hash.
    """
    items, n = _items(bench, "item_id", "text")
    if n == 1:
        return docs.filter(_share_udf(_block(items, 0, 1), window)(F.col(text_col)) <= F.lit(float(most)))
    (row,) = shared.free_names(docs, "row")
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    bad = shared.materialise(_merged_hits(texts, items, n, window).filter(F.col("n_hit") / F.col("n_words") > most).select(F.col("row").alias(row)), "bad")
    return docs.withColumn(row, F.xxhash64(text_col)).join(bad, row, "left_anti").drop(row)


def _share_udf(block: list[tuple[str, str]], window: int):
    name = _named(block)

    @F.arrow_udf("double")
    def share(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = _tables(name, block, window)
        for texts in batches:
            out = []
            for at in range(0, len(texts), 500):
                for t in texts.slice(at, 500).to_pylist():
                    n, ranges, _ = scan(t, tables)
                    out.append(sum(e - s for s, e in ranges) / n if n else 0.0)
            yield pa.array(out, pa.float64())
        kernels.give_back()

    return share


def read_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")

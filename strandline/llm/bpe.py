"""Byte-level BPE encoding and decoding, by a priority queue of merge ranks over a doubly linked symbol list.

A text is cut into pieces by the vocabulary's pattern. Within a piece, every
adjacent pair that a merge rule knows waits in a heap under the rule's rank and
its place; merging a pair unlinks its right symbol and adds the two new pairs.
Entries whose pair has changed since are skipped when they come up, so a piece
of n bytes takes O(n log n) time however it merges. Decoding lays the
vocabulary's strings end to end.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import kernels

#: Distinct pieces that a worker keeps before it starts over, and the length of the longest that it keeps.
CACHE_PIECES = 400_000
LONGEST_CACHED = 64
#: Characters of a text that are cut into pieces at a time.
WINDOW_CHARS = 500_000

# The pattern of byte-level vocabularies, and the letters and numbers that Unicode gained after the
# edition of the tokenizers library, to which they are other signs.
_LATER_LETTERS = r"""\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d
\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2\U00016ff3
\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6
\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff
\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f""".replace("\n", "")
_LATER_NUMBERS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
_LETTER, _NUMBER = rf"[\p{{L}}--[{_LATER_LETTERS}]]", rf"[\p{{N}}--[{_LATER_NUMBERS}]]"
_PIECE = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTER}+| ?{_NUMBER}+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_CUT = regex.compile(r"(?<=\S)(?=\s)")


def byte_signs() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible Latin-1, else one from U+0100 on, in order."""
    seen = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    hidden = iter(range(256, 512))
    return [chr(b) if s else chr(next(hidden)) for b, s in enumerate(seen)]


class _Pieces(dict):
    """Ids of pieces, as bytes; made where they are missing."""

    def __init__(self, codec: Codec):
        self._codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self._codec.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encodes texts and decodes ids with a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut, extra = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer")
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for t in extra for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
        if model.get("type", "BPE") != "BPE" or not plain or odd:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary: {odd or cut}")
        vocab = model["vocab"]
        of_byte = byte_signs()
        byte_of = {c: b for b, c in enumerate(of_byte)}
        self.special = {t["content"]: t["id"] for t in extra}
        self._of_byte = [vocab[c] for c in of_byte]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: (left id, right id) -> (rank, id of both)
        self.rules = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [b""] * top
        for t, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in t)
        for t, i in self.special.items():
            self.strings[i] = t.encode()
        self.decimals = [str(i) for i in range(top)]
        self._table = _Pieces(self)
        names = sorted(self.special, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the rule of the least rank first, of equal ranks the leftmost pair."""
        symbol = [self._of_byte[b] for b in piece]
        n, rules = len(symbol), self.rules
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(rules[p][0], i) for i, p in enumerate(zip(symbol, symbol[1:], strict=False)) if p in rules]
        heapify(queue)
        while queue:
            rank, i = heappop(queue)
            j = after[i]
            rule = rules.get((symbol[i], symbol[j])) if j >= 0 else None
            if rule is None or rule[0] != rank:
                continue  # a neighbour has merged since
            k = after[j]
            symbol[i], symbol[j] = rule[1], -1
            after[i], after[j] = k, -1
            if k >= 0:
                before[k] = i
                if (rule := rules.get((symbol[i], symbol[k]))) is not None:
                    heappush(queue, (rule[0], i))
            h = before[i]
            if h >= 0 and (rule := rules.get((symbol[h], symbol[i]))) is not None:
                heappush(queue, (rule[0], h))
        return [x for x in symbol if x >= 0]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of special tokens become their ids."""
        out: list[bytes] = []
        for part in self._split.split(text) if self._split else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            for span in _spans(part):
                out += map(self._table.__getitem__, _PIECE.findall(span))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: list[int]) -> str:
        """The strings of ids, end to end; bytes that are not UTF-8 become U+FFFD, ids that the vocabulary lacks nothing."""
        strings, top = self.strings, len(self.strings)
        try:
            raw = b"".join(map(strings.__getitem__, ids)) if not ids or min(ids) >= 0 else b"".join(strings[i] for i in ids if 0 <= i < top)
        except IndexError:
            raw = b"".join(strings[i] for i in ids if 0 <= i < top)
        return raw.decode("utf-8", "replace")


def _spans(text: str) -> Iterator[str]:
    """A text in windows, cut where a visible character meets white space: there every piece ends."""
    at = 0
    while len(text) - at > WINDOW_CHARS:
        cut = _CUT.search(text, at + WINDOW_CHARS)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_CODECS: dict[str, Codec] = kernels.kept()


def codec(path: str) -> Codec:
    """This worker's codec of a vocabulary file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of each row's whole text.

    A null or empty text has no ids; repeated rows stay; a null id is kept; an
    empty table gives an empty result; extra columns are not read. A text is
    cut into pieces by windows; only a single piece without a boundary (such as
    a very long word) is merged at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            for s in kernels.slices(b, "text"):
                ids = [c.encode(t or "") for t in s.column("text").to_pylist()]
                offs = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs), flat)], names=["doc_id", "ids"])
        kernels.give_back()

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row's ids. A null array or an empty one is an empty text; null ids, and ids that the vocabulary lacks, are nothing; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                texts = [c.decode([i for i in ids or [] if i is not None]) for ids in s.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: what :func:`encode` gives and what :func:`decode` makes of it, in one pass.

    ``ids_sha256`` is over the decimal ids joined by commas. Nulls, empty texts,
    repeated rows, empty tables and extra columns are taken as in :func:`encode`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            for s in kernels.slices(b, "text"):
                n, of_ids, of_text = [], [], []
                for t in s.column("text").to_pylist():
                    ids = c.encode(t or "").tolist()
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(c.decimals.__getitem__, ids)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        kernels.give_back()

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

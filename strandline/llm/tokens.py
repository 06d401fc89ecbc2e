"""Token ids of whole texts, by a public tokenizer, with each distinct piece of text encoded once.

A text is cut before white space that follows a visible character, and before
punctuation that follows a letter or digit. Both public vocabularies used here
cut there too before they merge, so the pieces' ids laid end to end are the
text's ids. Pieces repeat a lot: each worker keeps a bounded table from a
piece's hash to its bytes and ids and asks the tokenizer only for new ones. A
piece takes ids from the table only if its bytes are the ones that are kept.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from strandline.llm import kernels

#: Distinct pieces that a worker keeps before it starts over.
CACHE_PIECES = 600_000
#: Longer pieces are not looked up by hash; they are encoded each time.
LONGEST_CACHED = 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 32]] = True
#: Bytes after which a cut is safe: printable ASCII, and the last byte of two-byte Latin letters.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT = _VISIBLE & ~_ALNUM


def cut_points(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the pieces: each document's start, and the places that the module names."""
    if not len(data):
        return np.zeros(0, np.int64)
    cut = np.zeros(len(data), bool)
    seen = _VISIBLE[data]
    latin = np.zeros(len(data), bool)
    # not the signs for times and division, which are punctuation
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    seen |= latin
    letter = _ALNUM[data] | latin
    cut[1:] = (_SPACE[data[1:]] & seen[:-1]) | (_PUNCT[data[1:]] & letter[:-1])
    at = offs[:-1]
    cut[at[(at < len(data)) & (offs[1:] > at)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes Arrow string columns into one flat array of ids with offsets."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._special = [t.content.encode() for t in self._tok.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self._keys = np.zeros(0, np.uint64)  # sorted
        self._rows = np.zeros(0, np.int32)  # of _start, _count
        self._start = np.zeros(0, np.int32)
        self._count = np.zeros(0, np.int32)
        self._ids = np.zeros(0, np.uint32)
        self._raw = np.zeros(0, np.uint8)  # the pieces' bytes, with their places and sizes
        self._at = np.zeros(0, np.int64)
        self._size = np.zeros(0, np.int64)

    def _encode_texts(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(texts), 20_000):
            out += [e.ids for e in self._tok.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)]
        return out

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece)."""
        flat, count = [], np.zeros(len(pieces), np.int64)
        for at in range(0, len(pieces), 500):
            e = self._tok.encode(pieces[at : at + 500], is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(e.ids, np.uint32))
            of = np.array(e.word_ids, np.int64)
            count[at : at + 500] = np.bincount(of, minlength=min(500, len(pieces) - at)) if len(of) else 0
        return np.concatenate(flat), count

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        flat, count = self._encode_pieces([x.decode() for x in pieces])
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self._at = np.concatenate((self._at, len(self._raw) + np.cumsum(size) - size))
        self._size = np.concatenate((self._size, size))
        self._raw = np.concatenate((self._raw, np.frombuffer(b"".join(pieces), np.uint8)))
        base, row = len(self._ids), len(self._start)
        self._start = np.concatenate((self._start, (base + np.cumsum(count) - count).astype(np.int32)))
        self._count = np.concatenate((self._count, count.astype(np.int32)))
        self._ids = np.concatenate((self._ids, flat))
        keys_all = np.concatenate((self._keys, keys))
        rows_all = np.concatenate((self._rows, np.arange(row, row + len(keys), dtype=np.int32)))
        order = np.argsort(keys_all, kind="stable")
        self._keys, self._rows = keys_all[order], rows_all[order]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): document i has ids[offsets[i]:offsets[i + 1]]; a null or empty text has none.

        A text that holds the string of a special token is encoded whole, as the
        library takes that string out before it cuts the rest.
        """
        data, offs = kernels.text_buffer(col)
        whole = self._special_texts(data.tobytes(), offs)
        if not len(whole):
            return self._encode_plain(data, offs)
        raw = data.tobytes()
        alone = self._encode_texts([raw[offs[i] : offs[i + 1]].decode() for i in whole.tolist()])
        size = np.diff(offs)
        keep = np.ones(len(size), bool)
        keep[whole] = False
        size[whole] = 0
        flat, others = self._encode_plain(data[np.repeat(keep, np.diff(offs))], np.concatenate(([0], np.cumsum(size))))
        parts = np.split(flat, others[1:-1])
        for i, ids in zip(whole.tolist(), alone, strict=True):
            parts[i] = np.array(ids, np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def _special_texts(self, raw: bytes, offs: np.ndarray) -> np.ndarray:
        """The texts in which the string of a special token may be."""
        found = []
        for token in self._special:
            at = raw.find(token)
            while at >= 0:
                found.append(at)
                at = raw.find(token, at + 1)
        return np.unique(np.searchsorted(offs, np.array(found, np.int64), "right") - 1)

    def _encode_plain(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = cut_points(data, offs)
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        end = np.append(first[1:], len(data))
        raw, size = data.tobytes(), end - first
        hashes = kernels.span_hashes(data, first, end)
        uniq, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._keys) + len(uniq) > CACHE_PIECES:
            self._reset()
        at = np.searchsorted(self._keys, uniq)
        known = (at < len(self._keys)) & (self._keys[np.minimum(at, max(0, len(self._keys) - 1))] == uniq if len(self._keys) else np.zeros(len(uniq), bool))
        new = np.flatnonzero(~known)
        if len(new):
            w = where[new]
            self._learn(uniq[new], [raw[s:e] if e - s <= LONGEST_CACHED else b"" for s, e in zip(first[w].tolist(), end[w].tolist(), strict=True)])
            at = np.searchsorted(self._keys, uniq)
        row = self._rows[at]
        # a hash only proposes: the bytes must be those of the table's piece, and of the first piece here with that hash
        kept = self._size[row] == size[where]
        kept[kept] = kernels.same_spans(data, first[where[kept]], self._raw, self._at[row[kept]], size[where[kept]])
        ok = kept[inverse] & (size == size[where][inverse])
        ok[ok] = kernels.same_spans(data, first[ok], data, first[where[inverse[ok]]], size[ok])
        row = row[inverse]
        start, count = self._start[row].astype(np.int64), self._count[row].astype(np.int64)
        pool = self._ids
        alone = np.flatnonzero(~ok)
        if len(alone):
            ids = self._encode_texts([raw[s:e].decode() for s, e in zip(first[alone].tolist(), end[alone].tolist(), strict=True)])
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            start[alone] = len(pool) + np.cumsum(n) - n
            count[alone] = n
            pool = np.concatenate((pool, np.fromiter((x for y in ids for x in y), np.uint32, int(n.sum()))))
        total = np.concatenate(([0], np.cumsum(count)))
        flat = pool[np.repeat(start - total[:-1], count) + np.arange(total[-1])]
        lo, hi = kernels.per_document(first, offs)
        return flat, np.concatenate((total[lo], total[hi[-1:]]))


_ENCODERS: dict[str, Encoder] = kernels.kept()


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)

"""Token ids of whole texts by the tokenizers library, with a word cache.

The tokenizer's pre-tokenizer never joins characters across white space, so a text's ids are those of its
words, one after another. Arrow cuts a portion of texts at ASCII white space, numbers its different words, and parts
words of Latin letters from the marks after them. Such letters are a pre-token of their own and go straight to the library's
BPE model, in lower case; marks and every other word go through the whole tokenizer. Each is encoded once a worker, however
often it recurs, and the texts' ids are gathered from theirs in a few array operations.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of a worker's cache, in two halves: a full half becomes the older one, and the older one goes. Bounds memory, not results.
CACHE_WORDS = 400_000
#: Bytes of text in a portion, unless a single text has more; a portion's words are numbered together.
PORTION_BYTES = 4 << 20
# Workers live on between tasks: what a batch needed goes back to the system, not to a pool.
pa.set_memory_pool(pa.system_memory_pool())
#: Letters whose lower case is a Latin-1 letter, then ASCII punctuation but for the apostrophe.
_CORE = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-þ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


class Encoder:
    """Encodes words through a cache from a lower-case core, or a tuple of any other word, to ids as little-endian unsigned 32-bit integers."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        self.newer: dict[str | tuple[str], bytes] = {}
        self.older: dict[str | tuple[str], bytes] = {}
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = byte_letters()
        self.letters = {i: "".join(letters[b] for b in chr(i).encode()) for i in range(0x80, 0x100)}
        # The short way to the model must agree with the tokenizer; for a file with another normalizer it is not taken.
        self.short = all(self._model_ids(w) == self._whole_ids(w) for w in ("the", "Été", "naïve", "Straße", "UPPER"))

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _model_ids(self, word: str) -> list[int]:
        low = word.lower()
        return [t.id for t in self.model.tokenize(low if low.isascii() else low.translate(self.letters))]

    def _whole_ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _encoded(self, words: pa.Array, core: bool) -> list[bytes]:
        """Ids of each word, through the cache."""
        make = self._model_ids if core else self._whole_ids
        words = words.to_numpy(zero_copy_only=False).tolist()
        keys = words if core else [(w,) for w in words]
        out = list(map(self.newer.get, keys))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            ids = self.older.get(keys[i])
            if ids is None:
                ids = array("I", make(words[i])).tobytes()
            if len(self.newer) >= CACHE_WORDS // 2:
                self.older, self.newer = self.newer, {}
            self.newer[keys[i]] = out[i] = ids
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one after another, and each word's number of ids."""
        parts = pc.extract_regex(words, _CORE) if self.short else pa.nulls(len(words), pa.struct([("core", pa.string()), ("marks", pa.string())]))
        core, marks = (pc.struct_field(parts, i).dictionary_encode() for i in ("core", "marks"))
        low = pc.utf8_lower(core.dictionary).dictionary_encode()
        whole = words.filter(parts.is_null())
        # Units: lower-case cores, marks, whole words, and none.
        units = [*self._encoded(low.dictionary, True), *self._encoded(marks.dictionary, False), *self._encoded(whole, False), b""]
        n_core, n_marks = len(low.dictionary), len(marks.dictionary)
        plain = ~parts.is_null().to_numpy(zero_copy_only=False)
        pair = np.full((len(words), 2), len(units) - 1)
        pair[plain, 0] = low.indices.to_numpy(zero_copy_only=False)[core.indices.drop_null().to_numpy(zero_copy_only=False)]
        pair[plain, 1] = n_core + marks.indices.drop_null().to_numpy(zero_copy_only=False)
        pair[~plain, 0] = n_core + n_marks + np.arange(len(whole))
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units)) // 4
        ids, stops = gather(np.frombuffer(b"".join(units), dtype="<u4"), np.cumsum(size) - size, size, pair.reshape(-1))
        return ids, np.diff(stops[1::2], prepend=0)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one text after another (unsigned 32-bit), and each text's number of ids; null: none.

        end_id: put after each text's ids and counted.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        bounds = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
        numbered = split.flatten().dictionary_encode()
        ids, size = self._words(numbered.dictionary)
        word = numbered.indices.to_numpy(zero_copy_only=False)
        if end_id is not None:
            # The end is one more word of each text, numbered after the others.
            word = np.insert(word, bounds[1:], len(size))
            bounds += np.arange(len(bounds))
            ids, size = np.append(ids, np.array([end_id], dtype="<u4")), np.append(size, 1)
        out, stops = gather(ids, np.cumsum(size) - size, size, word)
        return out, np.diff(np.concatenate([[0], stops])[bounds])


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[first[i] : first[i] + size[i]] for each i of `at`, one after another, and where each ends."""
    sizes = size[at]
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    place = np.repeat(first[at] - stops + sizes, sizes)
    place += np.arange(total)
    return flat[place], stops


def portions(batch: pa.RecordBatch, column: int, most: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column holds about `most` bytes each, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

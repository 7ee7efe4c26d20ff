"""Token ids of whole Arrow text batches by a public tokenizer that never joins text across white space.

Such a tokenizer gives every stretch between ASCII white space the same ids wherever it stands, so each distinct
stretch is encoded once in a worker and found by its hash from then on. The memory of these is bounded. Stretches also
end where an ASCII mark follows a Latin letter: no token spans these two, as a run of letters is split off first. New
stretches of letters alone go to the tokenizer many in a text, which the ids that end a word take apart again.
"""

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa

from . import words

MOST_KNOWN = 800_000
#: Stretches of letters that the tokenizer gets in one text.
TOGETHER = 512
_FOLDED, _EXACT = words.byte_table(words.SPACES), words.byte_table(words.SPACES, fold_case=False)


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # A task has one core: threads of the tokenizer's own would wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.ending = self._ending_ids()
        self._forget()

    def _ending_ids(self) -> np.ndarray | None:
        """Whether an id ends a word, if words end in one such id each: the model marks ends and has every byte."""
        from tokenizers.pre_tokenizers import ByteLevel

        suffix, ids = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        if not suffix or not all(c in ids and c + suffix in ids for c in ByteLevel.alphabet()):
            return None
        ending = np.zeros(max(ids.values()) + 1, bool)
        ending[[i for word, i in ids.items() if word.endswith(suffix)]] = True
        return ending

    def _forget(self):
        self.hashes = np.zeros(0, np.uint64)
        #: The stretch of each hash; stretch i has the ids bounds[i] to bounds[i + 1] of the pool.
        self.numbers = np.zeros(0, np.int32)
        self.bounds = np.zeros(1, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each stretch of letters has, and the ids of all. A stretch has one word at least, so that those of a
        group have one each if there are no more; a group with more is encoded one by one."""
        groups = [texts[i : i + TOGETHER] for i in range(0, len(texts), TOGETHER)]
        counts, ids = [], []
        for group, own in zip(groups, self._encode([" ".join(g) for g in groups])):
            ends = np.flatnonzero(self.ending[own]) + 1
            if len(ends) == len(group):
                counts.append(np.diff(ends, prepend=0))
                ids += own
            else:
                alone = self._encode(group)
                counts.append(list(map(len, alone)))
                ids += chain.from_iterable(alone)
        return np.concatenate([np.zeros(0, np.int64), *counts]), np.array(ids, np.uint32)

    def _learn(self, hashes: np.ndarray, texts: list[str]):
        """Encode new stretches, those of letters first."""
        # In lower case, as the tokenizer may see them: the dotted I then has a mark.
        letters = np.array([self.ending is not None and t.lower().isalpha() for t in texts], bool)
        counts, ids = self._encode_letters(list(compress(texts, letters)))
        others = self._encode(list(compress(texts, ~letters)))
        counts = np.concatenate((counts, np.array(list(map(len, others)), np.int64)))
        ids = np.concatenate((ids, np.array(list(chain.from_iterable(others)), np.uint32)))
        hashes = np.concatenate((hashes[letters], hashes[~letters]))
        own, used = len(self.bounds) - 1, int(self.bounds[-1])
        if used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[:used], np.zeros(used + 2 * len(ids), np.uint32)))
        self.pool[used : used + len(ids)] = ids
        self.bounds = np.concatenate((self.bounds, used + np.cumsum(counts)))
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.numbers = np.insert(self.numbers, at, own + order)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Looked up in order, which keeps to the cache.
        order = np.argsort(hashes)
        at = np.empty(len(hashes), np.int64)
        at[order] = np.searchsorted(self.hashes, hashes[order])
        return at, self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes if len(self.hashes) else at < 0

    def rows(self, texts: pa.Array, end: int | None) -> Iterator[np.ndarray]:
        """The ids of each text, in order, and `end` after them."""
        tail = np.zeros(0, np.uint32) if end is None else np.array([end], np.uint32)
        # Only the strings of special tokens depend on case, and only they span letters and marks.
        data, _ = words.text_bytes(texts)
        exact = b"<|" in data.tobytes()
        for block in words.word_blocks(texts, _EXACT if exact else _FOLDED, cut_marks=not exact):
            coded = pa.array(block.hashes).dictionary_encode()
            distinct, which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            first = np.empty(len(distinct), np.int64)
            first[which] = np.arange(len(which))  # any one of its places
            at, known = self._find(distinct)
            if not known.all():
                new = np.flatnonzero(~known)
                raw = block.data.tobytes()
                places = zip(block.starts[first[new]].tolist(), block.ends[first[new]].tolist())
                if len(self.hashes) + len(new) > MOST_KNOWN:
                    self._forget()
                    new = np.arange(len(distinct))
                    places = zip(block.starts[first].tolist(), block.ends[first].tolist())
                self._learn(distinct[new], [raw[s:e].decode() for s, e in places])
                at, _ = self._find(distinct)
            numbers = self.numbers[at]
            starts, counts = self.bounds[numbers][which], (self.bounds[numbers + 1] - self.bounds[numbers])[which]
            bounds = np.concatenate(([0], np.cumsum(counts)))
            places = np.repeat(starts - bounds[:-1], counts)
            places += np.arange(len(places))
            ids, bounds = self.pool[places], bounds[block.bounds]
            for low, high in zip(bounds.tolist(), bounds[1:].tolist()):
                yield np.concatenate((ids[low:high], tail))


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)

"""Token ids of many text fragments: every distinct fragment is encoded once per worker.

A fragment is a piece of text that can be encoded on its own. Fragments of a block are hashed, the distinct
ones that the worker has not met are given to the tokenizers library, and the ids of all are gathered with
array operations. The memory of earlier fragments is emptied when it holds ``REMEMBER`` of them.
"""

from __future__ import annotations

import os

import numpy as np

from faceoff.llm import text as T

REMEMBER = 800_000
#: Bytes of text per block: a token id and its place take more room than the text.
TEXT = 1 << 20
_coders: dict[str, FragmentCoder] = {}


class FragmentCoder:
    """Ids of fragments by a tokenizer file, without special tokens, truncation or padding."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    def _forget(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        each = [e.ids for e in found]
        size = np.array([len(x) for x in each], np.int64)
        values = np.fromiter((i for x in each for i in x), np.int32, int(size.sum()))
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, values])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.start, self.size = (np.concatenate(x)[order] for x in ((keys,), (self.start, start), (self.size, size)))

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all fragments in a row, and the number of ids of each fragment."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        keys, first, where = np.unique(T.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBER:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == keys[at < len(self.keys)]
        if not known.all():
            new = first[~known]
            raw = data.tobytes()
            self._learn(keys[~known], [raw[a:z].decode("utf-8", "replace") for a, z in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        size, start = self.size[at][where], self.start[at][where]
        before = np.cumsum(size) - size
        return self.ids[np.repeat(start - before, size) + np.arange(int(size.sum()))], size


def coder(path: str) -> FragmentCoder:
    """The worker's coder for a tokenizer file."""
    if path not in _coders:
        _coders[path] = FragmentCoder(path)
    return _coders[path]

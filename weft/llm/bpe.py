"""Byte-pair merging of many sequences at once, on ragged numpy arrays.

A batch of pre-tokens is one flat array of symbol ids plus the sequence that each symbol belongs to. In each
round every sequence finds its lowest-rank adjacent pair and merges all its occurrences, leftmost first; the
rounds of all sequences run together. A merge's result only takes part in merges of higher rank, so merging all
occurrences at once gives the same symbols as merging them one by one.
"""

from __future__ import annotations

import json

import numpy as np

NONE = np.int64(1) << 40

#: White space as the pre-tokenizers' regular expressions see it.
SPACE = r"\t-\r\x20\x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Merges:
    """The merges and pieces of a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: p for p, i in vocab.items()} | {i: p for p, i in self.specials.items()}
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.width = max(self.pieces) + 1
        # of a pair listed twice the later rank holds
        ranks = {vocab[a] * self.width + vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        keys = sorted(ranks)
        self.keys = np.array(keys, np.int64)
        self.ranks = np.array([ranks[k] for k in keys], np.int64)
        #: what the merge of each rank makes
        self.made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; NONE where they don't merge."""
        key = left * self.width + right
        slot = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        return np.where(self.keys[slot] == key, self.ranks[slot], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each word has. An empty word has none.

        A pair's rank is looked up once, when its symbols become neighbours. Rounds are as many as the word with the most distinct
        ranks has merges, and each passes over the symbols of the words that are not done.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        flat, owner = self.first[raw], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)[sizes > 0] - 1
        flat[ends] = self.last[raw[ends]]
        done_ids, done_owner = [], []
        pair = np.full(flat.size, NONE)  # of each symbol with the next one
        if flat.size > 1:
            at = np.flatnonzero(owner[:-1] == owner[1:])
            pair[at] = self._ranks(flat[at], flat[at + 1])
        while flat.size:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, flat.size])
            least = np.minimum.reduceat(pair, starts)
            if (least == NONE).any():
                ended = np.repeat(least == NONE, lengths)
                done_ids.append(flat[ended])
                done_owner.append(owner[ended])
                flat, owner, pair = flat[~ended], owner[~ended], pair[~ended]
                lengths, least = lengths[least != NONE], least[least != NONE]
                if not flat.size:
                    break
            chosen = np.flatnonzero(pair == np.repeat(least, lengths))
            # of a run of overlapping occurrences every second one merges
            place = np.arange(chosen.size)
            began = np.r_[True, np.diff(chosen) != 1]
            left = chosen[(place - np.maximum.accumulate(np.where(began, place, 0))) % 2 == 0]
            flat[left] = self.made[pair[left]]
            pair[left] = pair[left + 1]
            keep = np.ones(flat.size, bool)
            keep[left + 1] = False
            flat, owner, pair = flat[keep], owner[keep], pair[keep]
            # the merged symbols' pairs are new
            left -= np.arange(left.size)
            at = np.union1d(left, left[left > 0] - 1)
            at = at[at + 1 < flat.size]
            at = at[owner[at] == owner[at + 1]]
            pair[at] = self._ranks(flat[at], flat[at + 1])
        if not done_ids:
            return np.zeros(0, np.int64), counts
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        counts += np.bincount(owner, minlength=len(words))
        return ids[order], counts

"""Whole-text tokenizing inside Spark tasks, by a public tokenizer's file."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers before it forgets those not met since the last time (results do not change).
REMEMBERED = 200_000


#: Stands between pieces that are encoded in one call; a token of its own.
BETWEEN = "\x01"

#: Stops behind a word, which are pieces of their own where the tokenizer parts them, too.
STOPS = r"([a-z])([.,!?;:]+) "
#: What a tokenizer that lowers and parts in this way encodes equally.
FOLDED = [("ABC", "abc"), ("Zx. Yq", "zx . yq"), ("qZ,;: K", "qz ,;: k"), ("Q!? x", "q !? x")]
#: Begins the tokens that must be found before letters are lowered.
SPECIAL = "<|"


class WordTokenizer:
    """Token ids of texts by a ``tokenizers`` file whose tokens never span a space or line feed.

    Texts are cut at those two characters, each distinct piece is encoded once
    and remembered, and a text's ids are the pieces' ids in order.  Pieces are
    looked up once a call, not once a place.  Special tokens are not added.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        between = self._encode(BETWEEN)
        self._between = int(between[0]) if len(between) == 1 else None
        # whether the tokenizer itself lowers letters and parts words from the stops behind them
        self._folds = all(np.array_equal(self._encode(a), self._encode(b)) for a, b in FOLDED)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces in one call, with a mark between them that none of them holds."""
        ids = self._encode(f" {BETWEEN} ".join(pieces))
        ends = np.append(np.flatnonzero(ids == self._between), len(ids)) if self._between is not None else [0]
        if len(ends) != len(pieces):  # the mark is no token of its own here
            for piece in pieces:
                self._known[piece] = self._encode(piece).tobytes()
            return
        data, start = ids.tobytes(), 0
        for piece, end in zip(pieces, ends.tolist(), strict=True):
            self._known[piece] = data[4 * start : 4 * end]
            start = end + 1

    def _remember(self, pieces: list[str]) -> None:
        if len(self._known) > REMEMBERED:
            self._older, self._known = self._known, {}
        known, older = self._known, self._older
        new = []
        for p in pieces:
            if p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    new.append(p)
        plain = [p for p in new if BETWEEN not in p]
        for at in range(0, len(plain), 512):
            self._learn(plain[at : at + 512])
        for piece in new if len(plain) < len(new) else ():
            if BETWEEN in piece:
                self._known[piece] = self._encode(piece).tobytes()

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` one after another, and where each text begins (and the last one ends)."""
        lines = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " ")
        if self._folds and not any(SPECIAL in x for x in texts):
            lines = pc.replace_substring_regex(pc.ascii_lower(lines), STOPS, r"\1 \2 ")
        split = pc.split_pattern(lines, " ")
        words = split.flatten().dictionary_encode()
        pieces = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._remember(pieces)
        found = [self._known[p] for p in pieces]
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.array([len(x) // 4 for x in found], np.int64)
        first = np.cumsum(size) - size
        at = words.indices.to_numpy()
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        # the place of each id in flat: where its piece begins there, plus its place in the piece
        place = np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])
        offsets = split.offsets.to_numpy()
        return flat[place], ends[offsets - offsets[0]]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Per text the ids as little-endian unsigned 32-bit numbers."""
        if not texts:
            return []
        ids, ends = self._encoded(texts)
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.ids(texts)]


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a file and worker."""
    return WordTokenizer(path)


def slices(texts: list[str], chars: int = 2_000_000):
    """Ranges of ``texts`` of about ``chars`` characters at most (one text at least)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end

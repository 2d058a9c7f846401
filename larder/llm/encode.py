"""Token ids of texts by a public tokenizer file.

The tokenizer cuts a text into pieces (words with the space before them, digits,
signs, white space) and encodes each alone.  Texts are cut here at their spaces:
a space begins a piece, and what follows up to the next space is encoded as it
would be in the text, unless a run of white space reaches over the next cut.
Such texts, and those with a special token's string, are encoded as a whole.  Of a
column of texts each distinct part is looked up once, and the ids of the texts are
gathered from those of the parts; frequent parts are kept for later columns.
"""

from __future__ import annotations

import os
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from larder.llm.files import kept

# Whose ids a worker keeps, some 200 bytes each; of parts, those that a column of texts
# has this often.
KEEP_PARTS = 300_000
KEEP_FROM = 2
KEEP_PIECES = 60_000
MARK = "\r"  # between parts that are encoded in one go
CROSSING = re.compile(r"\s (?:\s|\Z)")
# Characters whose class does not depend on the Unicode version.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(f"[ -~\n{_LETTERS}]*")
DOUBTFUL = f"[^!-~{_LETTERS}] (?:[^!-~{_LETTERS}]|$)"  # matches wherever CROSSING does
SOLID = re.compile(f"[!-~{_LETTERS}]+")  # without white space
# Fixed value: the pattern of the byte-level vocabulary, on plain characters.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+"
                    rf"| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
ID_TYPE = np.dtype("<u4")


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(sizes.sum())


class Encoder:
    """Texts to ids, four little-endian bytes each."""

    def __init__(self, path: str):
        # a task has one core, and every thread keeps memory of its own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # strings that are tokens of their own wherever they stand
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        one, mark, two = (self.tokenizer.encode(t, add_special_tokens=False).ids
                          for t in (" one", MARK, " two"))
        joined = self.tokenizer.encode(f" one{MARK} two", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 and joined == one + mark + two else None

    def plain(self, texts: list[str]) -> list[bytes]:
        """The tokenizer's own answer."""
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, ID_TYPE).tobytes() for e in encoded]

    def solid(self, parts: list[str]) -> list[bytes]:
        """Ids of parts after a space, encoded as one text with marks between."""
        if self.mark is None or not parts:
            return self.plain([" " + p for p in parts])
        ids = np.array(self.tokenizer.encode_batch_fast(
            [" " + f"{MARK} ".join(parts)], add_special_tokens=False)[0].ids, ID_TYPE)
        cuts = np.flatnonzero(ids == self.mark).tolist()
        raw = ids.tobytes()
        return [raw[4 * low:4 * high]
                for low, high in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        ids, counts = self.encode_column(pa.array(texts, pa.large_string()))
        raw, ends = ids.tobytes(), 4 * np.cumsum(counts)
        return [raw[end - 4 * n:end] for end, n in zip(ends, counts)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (large strings, no nulls), and how many each has."""
        whole = np.zeros(len(texts), bool)
        doubtful = reduce(pc.or_, [pc.match_substring(texts, a) for a in self.added],
                          pc.match_substring_regex(texts, DOUBTFUL))
        for i in np.flatnonzero(doubtful.to_numpy(zero_copy_only=False)).tolist():
            text = texts[i].as_py()
            whole[i] = bool(CROSSING.search(text)) or any(a in text for a in self.added)
        lists = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
        parts = lists.flatten().dictionary_encode()
        first = lists.offsets.to_numpy()[:-1]
        heads = lists.flatten().take(pa.array(first)).to_pylist()
        often = np.bincount(parts.indices, minlength=len(parts.dictionary)) >= KEEP_FROM
        table = [*self.after_space(parts.dictionary.to_pylist(), often), *self.encode_parts(heads),
                 *self.plain(texts.filter(pa.array(whole)).to_pylist())]
        place = parts.indices.to_numpy().astype(np.int64)
        place[first] = len(parts.dictionary) + np.arange(len(first))
        n_places = np.ones(len(texts), np.int64)
        n_places[~whole] = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(texts)), n_places)
        places = np.empty(len(owner), np.int64)
        places[~whole[owner]] = place
        places[whole[owner]] = len(table) - whole.sum() + np.arange(whole.sum())
        sizes = np.array([len(ids) // 4 for ids in table], np.int64)
        flat = np.frombuffer(b"".join(table), ID_TYPE)
        ids = flat[ranges((np.cumsum(sizes) - sizes)[places], sizes[places])]
        return ids, np.bincount(owner, sizes[places], minlength=len(texts)).astype(np.int64)

    def after_space(self, parts: list[str], often: np.ndarray) -> list[bytes]:
        """Ids of distinct ``parts``, each after a space; those met ``often`` are kept."""
        unknown = [p for p in parts if p not in self.parts]
        solid = [p for p in unknown if SOLID.fullmatch(p)]
        fresh = dict(zip(solid, self.solid(solid)))
        others = [p for p in unknown if p not in fresh]
        fresh.update(zip(others, self.encode_parts([" " + p for p in others])))
        known = self.parts
        out = [known[p] if p in known else fresh[p] for p in parts]
        if len(known) < KEEP_PARTS:
            met = [parts[i] for i in np.flatnonzero(often).tolist()]
            for p in [p for p in met if p in fresh][:KEEP_PARTS - len(known)]:
                known[p] = fresh[p]
        return out

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        pieces = [PIECES.findall(p) if PLAIN.fullmatch(p) else [p] for p in parts]
        unknown = list({q for own in pieces for q in own if q not in self.pieces})
        fresh = dict(zip(unknown, self.plain(unknown)))
        known = self.pieces
        out = [b"".join(known[q] if q in known else fresh[q] for q in own) for own in pieces]
        for q in unknown[:max(0, KEEP_PIECES - len(known))]:
            known[q] = fresh[q]
        return out


def encoder(path: str) -> Encoder:
    return kept(("encoder", path), lambda: Encoder(path))

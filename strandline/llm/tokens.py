"""Token ids of whole texts, many at a time, for use inside Python workers.

The word-end BPE never joins characters across a space or a line break: its
pre-tokeniser drops white space, its normaliser composes nothing with a space,
and its special strings hold none.  A text's ids are therefore the ids of its
space-separated pieces, one after the other.  Pieces repeat, so those of a
slice of texts are told apart first, and the library encodes each distinct one
once; ids are then laid out by array operations.  Nothing is kept from one
slice to the next, so memory is that of a slice.

Two more rules make fewer pieces distinct.  Punctuation at the end of a piece
is encoded apart where an ASCII letter comes before it, as the pre-tokeniser
starts a new token there (after other letters it may not, as normalised
letters can end in a combining mark, which joins what follows).  Pieces all in
ASCII are lower-cased first, as the normaliser does, unless they could hold a
special string.  tests/llm holds all this against the library on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about so many bytes, and a longer text in stretches of so many characters, cut at a space.
SLICE, STRETCH = 5 << 20, 1 << 21
#: So many pieces are encoded in one call.
CALL = 4096
_TAIL = ".,;:!?#$%&*"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _bounds(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]


def _body(texts: pa.Array) -> np.ndarray:
    body = texts.buffers()[2]
    return np.empty(0, np.uint8) if body is None else np.frombuffer(body, np.uint8)


def _spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after the other."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(len(at))
    return flat[at]


def _parts(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each piece as what comes before its closing punctuation, in lower case where that is safe, and the punctuation."""
    stems = pc.utf8_rtrim(pieces, _TAIL)
    body, bounds, kept = _body(pieces), _bounds(pieces), np.diff(_bounds(stems))
    ends = bounds[:-1] + kept
    apart = (kept > 0) & _LETTER[body[np.maximum(ends - 1, 0)]] if len(body) else np.zeros(len(pieces), bool)
    sizes = np.where(apart, bounds[1:] - ends, 0)
    tails = _spread(body, ends, sizes)
    tails = pa.StringArray.from_buffers(len(pieces), pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.py_buffer(tails.tobytes()))
    stems = pc.if_else(pa.array(apart), stems, pieces)
    plain = pc.and_(pc.string_is_ascii(stems), pc.invert(pc.match_substring(stems, "<|")))
    return pc.if_else(plain, pc.ascii_lower(stems), stems), tails


class PieceIds:
    """The ids of texts under one tokeniser file, special strings handled as the library does, nothing added or cut."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def _encode(self, pieces: list[str]) -> pa.Array:
        """The ids of each piece, as little-endian 32-bit bytes."""
        flat, cuts, total = [], [np.zeros(1, np.int64)], 0
        for at in range(0, len(pieces), CALL):
            some = pieces[at : at + CALL]
            coded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            first = np.cumsum([len(x) + 1 for x in some])
            cuts.append(total + np.searchsorted(np.array([a for a, _ in coded.offsets], np.int64), first))
            flat.append(np.array(coded.ids, "<u4").tobytes())
            total += len(flat[-1]) // 4
        return pa.BinaryArray.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer((4 * np.concatenate(cuts)).astype(np.int32)), pa.py_buffer(b"".join(flat))])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts one after the other, and where each text's begin (and the last one's end)."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        heads = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        del split
        stems, tails = (x.dictionary_encode() for x in _parts(words.dictionary))
        coded = self._encode(stems.dictionary.to_pylist() + tails.dictionary.to_pylist())
        tail = pc.add(tails.indices, len(stems.dictionary))
        distinct = pc.binary_join_element_wise(coded.take(stems.indices), coded.take(tail), pa.scalar(b"", pa.binary()))
        which = words.indices
        del words, stems, tails, coded, tail
        out = distinct.take(which)
        bounds = _bounds(out)[heads - heads[0]].astype(np.int64) >> 2
        pa.default_memory_pool().release_unused()
        return _body(out).view("<u4"), bounds

    def _long(self, text: str) -> np.ndarray:
        out, at = [np.empty(0, "<u4")], 0
        while at < len(text):
            cut = text.find(" ", at + STRETCH)
            end = len(text) if cut < 0 else cut
            out.append(self._slice(pa.array([text[at:end]], pa.string()))[0])
            at = end
        return np.concatenate(out)

    def encode_many(self, texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(index of the first text, ids one after the other, where each text's begin and the last one's end) for slices of the texts (of about `size` bytes, SLICE if none is given); null counts as empty."""
        size = size or SLICE
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
        while at < len(texts):
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            if stop == at + 1 and ends[at] - before > size:
                ids = self._long(texts[at].as_py())
                yield at, ids, np.array([0, len(ids)])
            else:
                yield at, *self._slice(texts.slice(at, stop - at).cast(pa.string()))
            at = stop

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian 32-bit bytes; null counts as empty."""
        return b"".join(ids.tobytes() for _, ids, _ in self.encode_many(pa.array([text], pa.string())))


@lru_cache(maxsize=4)
def piece_ids(path: str) -> PieceIds:
    """One a worker and file."""
    return PieceIds(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))

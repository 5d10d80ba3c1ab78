"""Whole texts to token ids with the tokenizers library, each distinct piece encoded once.

Both vocabularies split a text into pieces by a pattern before any merge. Texts
are cut at blanks, the distinct words of a step found by Arrow and looked up
among those that the worker knows; new words are split into pieces by the same
pattern (letters with points behind them without it), and of these the
library's own model encodes the new ones. The ids are put back in order by
numpy gathers. Texts with white space beside a blank or at an end, and texts
that hold the string of an added token, go through the library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Distinct words, or pieces, that a worker remembers before it starts anew.
MEMORY = 250_000
_GAPS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACE = f"[{_GAPS}]"
_BESIDE = f" {_SPACE}|{_SPACE} |^{_SPACE}|{_SPACE}$"
_CONTROL = r"[\x00\x1c-\x1f]"
#: The patterns by which the two vocabularies split, as their files state them, for words without two gaps in a row.
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PATTERN = rf"{_SHORT}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_GAPS}\p{{L}}\p{{N}}]+|{_SPACE}"
WORD_PATTERN = rf"{_SHORT}|\p{{L}}+|\p{{N}}|[^{_GAPS}\p{{L}}\p{{N}}]+"
#: A code point that stands between pieces; words that hold it are encoded alone.
_EDGE = "\uf8ff"
#: Marks that end words often; several together are one piece.
_POINTS = ".,;:!?)\"'"


def _byte_letters() -> dict[int, str]:
    """The library's letter for each byte: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions start, start+1, ... of every run in turn, offsets of the runs)."""
    upto = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=upto[1:])
    at = np.repeat(start - upto[:-1], size)
    at += np.arange(upto[-1])
    return at, upto


class _Table:
    """Runs of ids that grow by whole blocks of runs."""

    def __init__(self, kind: type):
        self.n = 0
        self.flat, self.ends = np.zeros(1 << 16, kind), np.zeros(1 << 16, np.int64)

    def add(self, ids: np.ndarray, stops: np.ndarray) -> None:
        """More runs: their ids in turn and where each one ends in these."""
        base = int(self.ends[self.n])
        while self.n + len(stops) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while base + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[base : base + len(ids)] = ids
        self.ends[self.n + 1 : self.n + 1 + len(stops)] = base + stops
        self.n += len(stops)

    def runs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the runs in turn, offsets of the runs)."""
        at, upto = _spread(self.ends[codes], self.ends[codes + 1] - self.ends[codes])
        return self.flat[at], upto


class _Known:
    """Strings that a worker knows, each with its ids."""

    def __init__(self, kind: type):
        self.names, self.runs = pa.array([], pa.large_string()), _Table(kind)

    def codes(self, distinct: pa.Array, learn) -> np.ndarray:
        """Number of each string; learn(new) gives (order, ids, stops): ids of the new ones in that order."""
        codes = pc.index_in(distinct, value_set=self.names)
        missing = _mask(pc.is_null(codes))
        out = _mask(pc.fill_null(codes, 0)).astype(np.int64)
        if missing.any():
            new = distinct.filter(pa.array(missing))
            order, ids, stops = learn(new)
            place = np.empty(len(new), np.int64)
            place[order] = self.runs.n + np.arange(len(new))
            out[missing] = place
            self.runs.add(ids, stops)
            self.names = pa.concat_arrays([self.names, new.take(pa.array(order))])
        return out


def _behind(strings: pa.Array, skip: np.ndarray) -> pa.Array:
    """Each string without its first skip bytes."""
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    at, upto = _spread(ends[:-1] + skip, np.diff(ends) - skip)
    data = np.frombuffer(strings.buffers()[2], np.uint8)[at] if len(at) else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(strings), pa.py_buffer(upto), pa.py_buffer(data))


def _list(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def _mask(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False)


class Encoder:
    """Ids of texts, as ``Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)`` gives them.

    ``lowered`` is for the vocabulary with word ends, which lowers and drops
    white space.
    """

    def __init__(self, path: str, lowered: bool = False):
        self.tok, self.lowered = Tokenizer.from_file(path), lowered
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tok.model, _byte_letters()
        self.kind = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.words, self.pieces = _Known(self.kind), _Known(self.kind)

    def _alone(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts by the library, one by one."""
        return [self.tok.encode(t, add_special_tokens=False).ids for t in texts]

    def _model(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, stops) of pieces; an empty one has no ids."""
        encode, letters = self.model.tokenize, self.letters
        ids: list[int] = []
        stops = []
        for p in _list(new):
            if p and not (p.isascii() and p.isalpha()):
                p = p.encode().decode("latin-1").translate(letters)
            ids += [t.id for t in encode(p)] if p else []
            stops.append(len(ids))
        return np.arange(len(new)), np.array(ids, self.kind), np.array(stops, np.int64)

    def _runs(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces in turn, offsets of the pieces)."""
        kinds = pieces.dictionary_encode()
        return self.pieces.runs.runs(self.pieces.codes(kinds.dictionary, self._model)[kinds.indices.to_numpy(zero_copy_only=False)])

    def _split(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, stops) of strings that hold no two gaps in a row and no _EDGE, by the pattern."""
        parted = pc.replace_substring_regex(words, f"({WORD_PATTERN if self.lowered else BYTE_PATTERN})", rf"\1{_EDGE}")
        parted = pc.split_pattern(pc.utf8_rtrim(parted, _EDGE), _EDGE)
        offs = parted.offsets.to_numpy().astype(np.int64)
        ids, upto = self._runs(parted.flatten())
        return ids, upto[(offs - offs[0])[1:]]

    def _words(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, stops) of words: letters and points, then others, then those for the library."""
        stem = pc.utf8_rtrim(strings, _POINTS)
        simple = pc.utf8_is_alpha(stem if self.lowered else pc.utf8_ltrim(stem, " "))
        odd = pc.match_substring_regex(strings, f"{_SPACE}{_SPACE}|{_EDGE}" if not self.lowered else _EDGE)
        odd = pc.and_not(pc.or_(odd, pc.equal(strings, "")), simple)
        rest = pc.invert(pc.or_(simple, odd))
        stem, whole = stem.filter(simple), strings.filter(simple)
        tail = _behind(whole, pc.binary_length(stem).to_numpy(zero_copy_only=False))
        ids, upto = self._runs(pa.concat_arrays([stem, tail]))
        n = len(stem)
        own = np.stack([np.arange(n), n + np.arange(n)], axis=1).ravel()
        where, ends = _spread(upto[own], upto[own + 1] - upto[own])
        more, stops = self._split(strings.filter(rest))
        alone = [np.array(x, self.kind) for x in self._alone(_list(strings.filter(odd)))]
        last = np.cumsum([len(x) for x in alone], dtype=np.int64)
        both = np.concatenate([ids[where], more, *alone])
        ends = np.concatenate([ends[2::2], ends[-1] + stops, ends[-1] + len(more) + last])
        return np.concatenate([np.flatnonzero(_mask(x)) for x in (simple, rest, odd)]), both, ends

    def _learned(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, stops) of words; of the one vocabulary as they follow a blank."""
        if not self.lowered:
            return self._words(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), new, pa.scalar("", pa.large_string())))
        normal, plain = pc.ascii_lower(new), _mask(pc.string_is_ascii(new))
        if not plain.all():
            other = self.tok.normalizer.normalize_str(" ".join(_list(new.filter(pa.array(~plain))))).split(" ")
            normal = pc.replace_with_mask(normal, pa.array(~plain), pa.array(other, pa.large_string()))
        return self._words(normal)

    def _odd(self, texts: list[str], column: pa.Array) -> np.ndarray:
        """Texts that the library has to see whole."""
        odd = pc.match_substring_regex(column, _CONTROL if self.lowered else _BESIDE).to_numpy(zero_copy_only=False)
        odd = odd | pc.equal(column, "").to_numpy(zero_copy_only=False)
        for token in self.added:
            odd |= pc.match_substring(column, token, ignore_case=True).to_numpy(zero_copy_only=False)
        return odd

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, offsets of each text's ids)."""
        if max(self.words.runs.n, self.pieces.runs.n) > MEMORY:
            self._forget()
        column = pa.array(texts, pa.large_string())
        odd = self._odd(texts, column)
        if self.lowered:
            regular = [" ".join(t.split()) for t in texts]
            odd |= np.fromiter((not t for t in regular), bool, len(texts))
        else:
            regular = texts
        if odd.any():
            regular = ["x" if o else t for t, o in zip(regular, odd)]
        split = pc.split_pattern(pa.array(regular, pa.large_string()) if regular is not texts else column, " ")
        seen = split.flatten().dictionary_encode()
        codes = self.words.codes(seen.dictionary, self._learned)[seen.indices.to_numpy(zero_copy_only=False)]
        table = self.words.runs
        offs = split.offsets.to_numpy().astype(np.int64)
        offs = offs - offs[0]
        if not self.lowered:  # a text's first word has no blank before it: its pieces are others
            alone, at = np.unique(codes[offs[:-1]], return_inverse=True)
            firsts = self.words.names.take(pa.array(alone))
            order, more, stops = self._words(firsts)
            own = np.diff(stops, prepend=0)
            at = np.argsort(order)[at]
            start, sizes = table.ends[codes], table.ends[codes + 1] - table.ends[codes]
            start[offs[:-1]], sizes[offs[:-1]] = len(table.flat) + (stops - own)[at], own[at]
            where, upto = _spread(start, sizes)
            ids, ends = np.concatenate([table.flat, more])[where], upto[offs]
        else:
            ids, upto = table.runs(codes)
            ends = upto[offs]
        if not odd.any():
            return ids, ends
        out, stops = [], [0]
        for i, t in enumerate(texts):
            out.append(np.array(self._alone([t])[0], self.kind) if odd[i] else ids[ends[i] : ends[i + 1]])
            stops.append(stops[-1] + len(out[-1]))
        return np.concatenate(out), np.array(stops, np.int64)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, lowered: bool = False) -> Encoder:
    """One for each worker and vocabulary."""
    if (path, lowered) not in _encoders:
        _encoders[path, lowered] = Encoder(path, lowered)
    return _encoders[path, lowered]

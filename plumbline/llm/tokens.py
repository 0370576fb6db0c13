"""Token ids of whole texts, many documents at a time."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from plumbline.llm.words import hashes_of_spans, text_bytes

#: Parts of texts whose ids a worker remembers; beyond that it begins anew.
REMEMBERED = 300_000

# Fixed values of the vocabulary file: a text falls into runs of letters, single digits, runs of other signs, and these
# endings where an apostrophe begins a part. White space (0x20, 0x09-0x0D) only separates.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_OUT, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _OUT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32

#: A token that may end a sentence: its last sign is one of these, but for closing quotes and brackets.
_SENTENCE_END = re.compile(r"""[.!?…。]["'»”)\]]*$""")

_LOADED: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids by a tokenizer that lowers case, drops white space and encodes each part of a text by itself.

    Texts of ASCII and Latin-1 letters fall into parts by their bytes, for many
    texts at a time; each different part is encoded once and remembered by its
    hash. Any other text, and one that might name a special token, goes to the
    tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, at in vocabulary.items():
            self.ends[at] = bool(_SENTENCE_END.search(token.removesuffix("</w>")))
        self.closes = np.zeros(len(self.ends), dtype=bool)
        self.closes[[at for token, at in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}  # a part's hash -> its place in `sizes`
        self.sizes, self.begins, self.flat = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _learn(self, hashes: list[int], parts: list[str]) -> None:
        """Encode parts in one text; the tokens of a part end with the one that closes it."""
        if not parts:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype=np.int32)
        bounds = np.concatenate([[0], np.flatnonzero(self.closes[ids]) + 1])
        if len(bounds) != len(parts) + 1:
            raise ValueError("the tokenizer doesn't encode parts by themselves")
        self.known.update(zip(hashes, range(len(self.sizes), len(self.sizes) + len(parts)), strict=True))
        self.begins = np.concatenate([self.begins, len(self.flat) + bounds[:-1]])
        self.sizes = np.concatenate([self.sizes, np.diff(bounds)])
        self.flat = np.concatenate([self.flat, ids])

    def _places(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The places of the parts' ids in `sizes`; unknown parts are learnt."""
        different, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        names = different.tolist()
        new = [k for k, h in enumerate(names) if h not in self.known]
        if new and len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = list(range(len(names)))
        text = raw.tobytes()
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            spans = zip(starts[first[some]].tolist(), ends[first[some]].tolist(), strict=True)
            self._learn([names[k] for k in some], [text[a:b].decode() for a, b in spans])
        return np.fromiter((self.known[h] for h in names), np.int64, len(names))[number]

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), each followed by the id `end`, and the texts' n + 1 offsets."""
        raw, offsets = text_bytes(texts)
        raw, starts, ends, plain = parts_of(raw, offsets)
        docs = np.searchsorted(starts, offsets)
        places = self._places(hashes_of_spans(raw, starts, ends), raw, starts, ends) if len(starts) else np.zeros(0, np.int64)
        sizes = self.sizes[places]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.begins[places] - upto[:-1], sizes) + np.arange(upto[-1])]
        bounds = upto[docs]
        others = np.flatnonzero(~plain).tolist()
        if others or end is not None:
            tail = np.array([] if end is None else [end], dtype=np.int32)
            whole = {n: np.array(x.ids, dtype=np.int32) for n, x in zip(others, self.tokenizer.encode_batch_fast(texts.take(pa.array(others, pa.int64())).to_pylist(), add_special_tokens=False), strict=True)} if others else {}
            pieces: list[np.ndarray] = []
            for n, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                pieces += [whole[n] if n in whole else ids[a:b], tail]
            lengths = np.array([len(pieces[i]) + len(tail) for i in range(0, len(pieces), 2)], dtype=np.int64)
            ids = np.concatenate(pieces) if pieces else ids
            bounds = np.concatenate([[0], np.cumsum(lengths)])
        return ids, bounds


def parts_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case, where parts begin and end in them, and which texts are plain (others have no parts)."""
    n = len(raw)
    if not n:
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(len(offsets) - 1, dtype=bool)
    kind, small = _KIND[raw], _SMALL[raw]
    high = np.flatnonzero(raw >= 0x80)
    bad = np.zeros(n, dtype=bool)
    if len(high):
        lead = raw[high] == 0xC3
        after = np.zeros(len(high), dtype=bool)  # the second byte of such a letter
        after[1:] = lead[:-1] & (high[1:] == high[:-1] + 1)
        bad[high[~(lead | after)]] = True
        second = high[after]
        letter = (raw[second] != 0x97) & (raw[second] != 0xB7)
        kind[second[letter]] = kind[second[letter] - 1] = _LETTER
        capital = letter & (raw[second] < 0x9F)
        small[second[capital]] += 0x20
    bar = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))  # <| may begin a special token
    bad[bar] = True
    # control signs that the tokenizer may take for white space
    bad |= (raw < 0x09) | ((raw > 0x0D) & (raw < 0x20)) | (raw == 0x7F)
    plain = np.diff(np.concatenate([[0], np.cumsum(bad)])[offsets]) == 0
    if not plain.all():
        kind[np.repeat(~plain, np.diff(offsets))] = _OUT
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin = edge[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    begin |= kind == _DIGIT
    begin &= kind != _OUT
    # the second byte of a letter never begins a part: both bytes have its kind
    marks = np.flatnonzero(begin & (raw == 39))
    if len(marks):
        last = offsets[np.searchsorted(offsets, marks, side="right")]  # the end of the mark's text
        at = lambda k: np.where(marks + k < last, small[np.minimum(marks + k, n - 1)], 0)
        one, two = at(1), at(2)
        size = np.zeros(len(marks), dtype=np.int64)
        for ending in _ENDINGS:
            fits = one == ord(ending[0])
            if len(ending) > 1:
                fits &= two == ord(ending[1])
            size[fits] = len(ending)
        marks, size, last = marks[size > 0], size[size > 0], last[size > 0]
        begin[marks + 1] = False
        rest = marks + 1 + size
        inside = rest < last
        rest = rest[inside]
        begin[rest[kind[rest] == _LETTER]] = True
    edge[:n] |= begin | (kind == _OUT)
    bounds, starts = np.flatnonzero(edge), np.flatnonzero(begin)
    ends = bounds[np.searchsorted(bounds, starts) + 1]
    return small, starts, ends, plain


def encoder(path: str) -> Encoder:
    """The worker's encoder for the file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]

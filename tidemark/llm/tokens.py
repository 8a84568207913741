"""Public tokenizers over Arrow batches of whole texts.

Pseudo code of the speed-up: a text is cut at single spaces that have a
non-space on either side. No token of the three supported models crosses
such a cut (byte level: a word takes its one leading space along; word BPE:
white space is dropped; sentence pieces: no piece has an inner space mark),
so the ids of a text are its chunks' ids in a row, and each distinct chunk of
a batch is encoded once. Chunks are found and numbered by Arrow, ids are
gathered by numpy. A text for which a cut is not certain (doubled, leading or
trailing white space, a special token's string) is encoded whole by the
library.

Null and empty texts have no ids.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import byte_slices, plain_strings

#: Bytes of text encoded at a time.
STEP_BYTES = 6 << 20
#: Distinct chunks that a worker keeps between batches, and words of them.
CACHE_ENTRIES = 500_000
CACHE_WORDS = 300_000

#: Letters that need no normalisation, and ASCII marks without the apostrophe
#: (which starts contractions) and "<" (which starts special tokens).
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=-@\[-`{-~]*)")

_OPEN: dict[str, "Codec"] = {}


def codec(path: str) -> "Codec":
    """The codec for a tokenizer file, opened once per Python worker."""
    if path not in _OPEN:
        _OPEN[path] = PieceCodec(path) if path.endswith(".model") else JsonCodec(path)
    return _OPEN[path]


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class _Vocabulary:
    """Distinct chunks seen so far in this worker, with their ids. Kept as
    Arrow and numpy arrays; started anew beyond ``CACHE_ENTRIES``."""

    def __init__(self, encode) -> None:
        self._encode = encode
        self._clear()

    def _clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.sizes = np.zeros(0, np.int32)
        self.sure = np.zeros(0, bool)
        self.ids = np.zeros(0, np.uint32)

    def number(self, words: pa.Array) -> np.ndarray:
        """Each word's number; unknown words are encoded and added."""
        if len(self.words) > CACHE_ENTRIES:
            self._clear()
        index = pc.index_in(words, value_set=self.words)
        if index.null_count:
            missing = index.is_null()
            absent = words.filter(missing)
            new = absent.unique()
            found = [self._encode(w) for w in _strings(new)]
            index = pc.replace_with_mask(index, missing, pc.add(pc.index_in(absent, value_set=new), pa.scalar(len(self.words), pa.int32())))
            self.words = pa.concat_arrays([self.words, new])
            self.sure = np.concatenate([self.sure, np.fromiter((x is not None for x in found), bool, len(found))])
            self.sizes = np.concatenate([self.sizes, np.fromiter((len(x or b"") // 4 for x in found), np.int32, len(found))])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join([x or b"" for x in found]), np.uint32)])
        return index.to_numpy(zero_copy_only=False)


def _strings(array: pa.Array) -> list[str]:
    """Chunks as Python strings; none holds a space."""
    if not len(array):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)
    return pc.binary_join(whole, " ")[0].as_py().split(" ")


class Codec:
    def __init__(self) -> None:
        self._inner = _Vocabulary(lambda chunk: self._sure(" ", chunk))
        self._lead = _Vocabulary(lambda chunk: self._sure("", chunk))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and each text's number of ids."""
        texts = plain_strings(texts)
        parts = [self._encode(texts.slice(a, b - a)) for a, b in byte_slices(texts, STEP_BYTES)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def count(self, texts: pa.Array) -> np.ndarray:
        return self.encode(texts)[1]

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.split_pattern(texts, " ")
        at = np.asarray(cut.offsets, dtype=np.int64)
        at = at - at[0]
        words = cut.flatten()
        first = at[:-1]
        inner = self._inner.number(words).astype(np.int64)
        lead_words = words.take(pa.array(first))
        lead = self._lead.number(lead_words)
        known = self._inner.sure[inner]
        known[first] = self._lead.sure[lead]
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        whole = np.flatnonzero((np.add.reduceat(~known, first) > 0) & ~empty)
        encoded = [np.array(self._whole(texts[int(i)].as_py()), np.uint32) for i in whole]
        # Numbers of inner chunks, then of leading ones, of nothing, of whole texts.
        n_inner, n_lead = len(self._inner.words), len(self._lead.words)
        size = np.concatenate([self._inner.sizes, self._lead.sizes, [0], [len(x) for x in encoded]]).astype(np.int64)
        flat = np.concatenate([self._inner.ids, self._lead.ids, *encoded])
        inner[first] = n_inner + lead
        if len(whole):
            for i in whole:
                inner[at[i] : at[i + 1]] = n_inner + n_lead
            inner[first[whole]] = n_inner + n_lead + 1 + np.arange(len(whole))
        begin = np.cumsum(size) - size
        taken = size[inner]
        ends = np.cumsum(taken)
        place = np.repeat(begin[inner] - (ends - taken), taken) + np.arange(int(ends[-1]))
        return flat[place], np.add.reduceat(taken, first)

    def _sure(self, before: str, chunk: str) -> bytes | None:
        """Ids of a chunk after ``before``; None where a cut beside it would
        not be certain."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace() or "<|" in chunk or "▁" in chunk:
            return None
        return self._chunk(before, chunk)

    def _chunk(self, before: str, chunk: str) -> bytes:
        """The chunk's ids as 32-bit integers."""
        raise NotImplementedError

    def _whole(self, text: str) -> list[int]:
        raise NotImplementedError


class JsonCodec(Codec):
    """A byte-pair model of the tokenizers library. A chunk of plain letters
    with marks behind them is one or two words of the file's split pattern, so
    its byte-pair model is asked directly; any other chunk goes through the
    library's whole chain."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer  # noqa: PLC0415 - only where texts are encoded

        self._tokenizer = Tokenizer.from_file(path)
        self._spaced = self._tokenizer.normalizer is None
        self.vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._model = self._tokenizer.model
        self._bytes = _byte_letters()
        self._words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        got = self._words.get(word)
        if got is None:
            if len(self._words) >= CACHE_WORDS:
                self._words.clear()
            shown = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self._bytes)
            got = self._words[word] = _packed([t.id for t in self._model.tokenize(shown)])
        return got

    def _chunk(self, before: str, chunk: str) -> bytes:
        if not self._spaced:
            before = ""
        if "\n" not in chunk:
            return self._line(before, chunk)
        lines = chunk.split("\n")
        if not all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            return _packed(self._library(before + chunk))
        end = self._word("\n") if self._spaced else b""
        return end.join([self._line("" if i else before, line) for i, line in enumerate(lines)])

    def _line(self, before: str, line: str) -> bytes:
        letters, marks = (line, "") if line.isascii() and line.isalpha() else self._split(line)
        if letters is None:
            return _packed(self._library(before + line))
        if not self._spaced:
            letters = letters.lower()
        if not letters:
            return self._word(before + marks)
        return self._word(before + letters) + self._word(marks) if marks else self._word(before + letters)

    def _split(self, line: str) -> tuple[str | None, str]:
        simple = _SIMPLE.fullmatch(line)
        return simple.groups() if simple else (None, "")

    def _library(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, text: str) -> list[int]:
        return self._library(text)


class PieceCodec(Codec):
    """A sentence-piece model. The library itself puts a space mark before
    every text, so a chunk is passed without its space."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import sentencepiece  # noqa: PLC0415 - only where texts are encoded

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary = self._model.vocab_size()

    def _chunk(self, before: str, chunk: str) -> bytes:
        return _packed(self._model.encode(chunk, num_threads=1))

    def _whole(self, text: str) -> list[int]:
        return self._model.encode(text, num_threads=1)


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for
    themselves, the others for the letters from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

"""Token ids of whole texts, by the tokenizers library.

White space never joins two pre-tokens of the supported vocabulary, and on
Latin-1 characters its normalizer does no more than lower the letters.  So such
texts are cut into pre-tokens here, a batch of texts at a time as one array of
bytes, by the kind of each byte; each different pre-token of a batch is looked
up once in a table of ids, and numpy gathers the ids of the texts from those.
The batch's unknown pre-tokens go to the library's model in one call, as one text
whose words a space parts; every word ends in a token that closes it, which parts
the ids again.  In a text that holds other characters, or the beginning of an
added token, each chunk between white space that does goes through the library's
whole pipeline; under another pattern of pre-tokens every text does.  The table
has two generations, so what is in use outlives its bound.
"""

from __future__ import annotations

import array
import json
import re
import sys
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

END_ID = 2
#: Entries of one generation of the table, and the longest pre-token or chunk that is kept.
KEPT = 300_000
LONGEST_KEPT = 64
#: A batch ends at so many characters or texts; a text of more is taken in pieces that end before white space.
BATCH_CHARS, BATCH_TEXTS = 1 << 21, 4096
#: Split by str.split() but not white space to the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
_GAP = re.compile("[ \t\n\r]")
# Fixed value: the vocabulary's pre-token pattern, and what it comes to on Latin-1 letters in lower case.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = r"[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+"


_SPACE, _LETTER, _DIGIT, _SYMBOL = range(4)
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _kinds() -> np.ndarray:
    """The kind of each Latin-1 character in lower case."""
    letter, digit = re.compile("[a-zªµºß-öø-ÿ]"), re.compile("[0-9²³¹¼-¾]")
    return np.array([_LETTER if letter.match(c) else _DIGIT if digit.match(c) else _SPACE if c.isspace() else _SYMBOL for c in map(chr, range(256))], np.uint8)


_KINDS = _kinds()


def pre_tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of Latin-1 text in lower case that ends in white space: where each pre-token begins, the text without white space, where each begins there."""
    chars = np.frombuffer(data, np.uint8)
    kind = _KINDS[chars]
    solid = kind != _SPACE
    first = solid & (kind == _DIGIT)
    first[0] = solid[0]
    first[1:] |= solid[1:] & (kind[1:] != kind[:-1])
    # an apostrophe that begins a pre-token takes an ending along, whatever follows
    for at in np.flatnonzero(first & (chars == 0x27)).tolist():
        ending = next((x for x in _ENDINGS if data.startswith(x, at + 1)), b"")
        if ending:
            first[at + 1] = False
            first[at + 1 + len(ending)] = solid[at + 1 + len(ending)]
    begins = np.flatnonzero(first)
    return begins, chars[solid], np.cumsum(solid, dtype=np.int64)[begins] - 1


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_END = _packed([END_ID])


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        first, second = spec["pre_tokenizer"]["pretokenizers"]
        suffix = spec["model"]["end_of_word_suffix"]
        if kinds != ["NFC", "Replace", "Lowercase"] or (first["type"], second["type"], second["use_regex"]) != ("Split", "ByteLevel", False) or not suffix:
            raise ValueError(f"{path}: not a lower-case word vocabulary with word ends that drops white space")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        pattern = first["pattern"]["Regex"]
        self.known = pattern == _PATTERN
        self.words = re.compile(_LATIN)
        self.letters = str.maketrans({b: c for b, c in _byte_letters().items() if b != 0x20})
        self.size = self.tokenizer.get_vocab_size()
        self.closes = np.zeros(self.size, bool)
        for token, i in spec["model"]["vocab"].items():
            self.closes[i] = token.endswith(suffix)
        marks = "|".join(re.escape(x["content"][:2]) for x in spec["added_tokens"])
        other = r"[^\x00-\xff]" + (f"|{marks}" if marks else "")
        self.other = re.compile(other)
        #: Latin-1 texts without these are plain.
        self.signs = [*map(chr, range(0x1C, 0x20)), *{c for x in spec["added_tokens"] for c in (x["content"][0].lower(), x["content"][0].upper())}]
        self.chunk = re.compile(rf"\S*?(?:{other})\S*")
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _plain(self, text: str) -> bool:
        """Whether the text is of pre-tokens only that are told by their bytes."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return not any(map(text.__contains__, self.signs)) or (self.other.search(text) or _ODD.search(text)) is None

    def _parts(self, text: str) -> list[str]:
        """Pre-tokens in lower case, and chunks for the whole pipeline as they are."""
        out, at = [], 0
        for m in self.chunk.finditer(text):
            out += self.words.findall(text[at : m.start()].lower())
            out.append(m[0])
            at = m.end()
        return out + self.words.findall(text[at:].lower())

    def _learn(self, words: list[str]) -> None:
        """Ids of unknown pre-tokens."""
        if not words:
            return
        letters = " ".join(words)
        if not (letters.isascii() and letters.isprintable()):
            letters = letters.encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u4")
        data, ends = ids.tobytes(), ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
        self.now.update(zip(words, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _found(self, parts: list[str], mixed: bool) -> list[bytes]:
        """Ids of different parts; ``mixed`` if any may be for the whole pipeline."""
        out = list(map(self.now.get, parts))
        if None not in out:
            return out
        lacking = [i for i, ids in enumerate(out) if ids is None]
        words = [parts[i] for i in lacking]
        before = list(map(self.old.get, words))
        self.now.update([(w, ids) for w, ids in zip(words, before, strict=True) if ids is not None])
        unknown = [w for w, ids in zip(words, before, strict=True) if ids is None]
        whole = [w for w in unknown if self.other.search(w)] if mixed else []
        self.now.update(zip(whole, map(self._whole, whole), strict=True))
        self._learn([w for w in unknown if w not in self.now] if whole else unknown)
        for i, ids in zip(lacking, map(self.now.__getitem__, words), strict=True):
            out[i] = ids
        for w in [w for w in unknown if len(w) > LONGEST_KEPT]:
            del self.now[w]
        if len(self.now) > KEPT:
            self.old, self.now = self.now, {}
        return out

    def _gathered(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of plain texts."""
        lower = [t.lower() for t in texts]
        begins, chars, offsets = pre_tokens("\n".join([*lower, ""]).encode("latin-1"))
        if not len(begins):
            yield from [b""] * len(texts)
            return
        buffers = [None, pa.py_buffer(np.append(offsets, len(chars))), pa.py_buffer(chars)]
        coded = pa.Array.from_buffers(pa.large_binary(), len(begins), buffers).dictionary_encode()
        row = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        # out of Arrow as one text that is split again: far faster than one by one
        found = self._found(pc.binary_join(row, pa.scalar(b"\n", pa.large_binary()))[0].as_py().decode("latin-1").split("\n"), False)
        ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        codes = coded.indices.to_numpy()
        size = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        # the place in ids of each id of the texts: where its pre-token's begin, and how far it lies behind
        at = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], size)
        data = ids[at].tobytes()
        edges = np.cumsum([0, *(len(t) + 1 for t in lower)])
        cuts = (4 * ends[np.searchsorted(begins, edges)]).tolist()
        yield from map(data.__getitem__, map(slice, cuts[:-1], cuts[1:]))

    def _batch(self, texts: list[str]) -> Iterator[bytes]:
        if not self.known:
            yield from (self._whole(t) + _END for t in texts)
            return
        plain = list(map(self._plain, texts))
        gathered = self._gathered([t for t, p in zip(texts, plain, strict=True) if p])
        split = [None if p else [] if _ODD.search(t) else self._parts(t) for t, p in zip(texts, plain, strict=True)]
        some = list(set(chain.from_iterable(parts for parts in split if parts)))
        known = dict(zip(some, self._found(some, True), strict=True))
        for text, parts in zip(texts, split, strict=True):
            if parts is None:
                yield next(gathered) + _END
            else:
                yield (b"".join(map(known.__getitem__, parts)) if parts else self._whole(text)) + _END

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while m := _GAP.search(text, at + BATCH_CHARS):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """For each text its ids and the end id."""
        held, size = [], 0
        for text in texts:
            if held and (size + len(text) > BATCH_CHARS or len(held) >= BATCH_TEXTS):
                yield from self._batch(held)
                held, size = [], 0
            if len(text) > BATCH_CHARS and self.known and not _ODD.search(text):
                yield b"".join([*(ids[: -len(_END)] for piece in self._pieces(text) for ids in self._batch([piece])), _END])
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from self._batch(held)

    def forget(self) -> None:
        """Empties the table; ids don't depend on it."""
        self.now, self.old = {}, {}

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a vocabulary file, read once."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

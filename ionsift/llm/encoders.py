"""Exact token ids of whole texts, with the tokenizers library and a bounded store of parts already encoded.

Most of the library's time goes into words that came before.  Where the
tokenizer's own settings show that a text's ids are the ids of certain parts
in sequence (a byte-level one without normaliser; one that lower-cases, drops
white space and splits at it), the text is split there and the library
encodes each new part once.  Parts may hold several of the tokenizer's own
pre-tokens but cut none: they end where letters end, and numerals are none.  Any other tokenizer, and any text that holds
an added token's string, goes to the library whole.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

from .common import release

# A task has one core; the library's own threads would take those of other tasks.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept in the machine's own order, which is little-endian with 32 bits here")

#: White space as the tokenizers' patterns know it (a fixed value; Python's own class holds four control characters more).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _numerals() -> str:
    """The characters that Python's \\w holds beside letters and decimal digits, as ranges of a pattern: numbers such as halves, squares and Roman numerals."""
    own = [c for c in range(sys.maxunicode + 1) if chr(c).isnumeric() and not chr(c).isalpha() and not chr(c).isdecimal()]
    runs = [list(run) for _, run in itertools.groupby(enumerate(own), lambda p: p[1] - p[0])]
    return "".join(f"\\U{run[0][1]:08x}-\\U{run[-1][1]:08x}" for run in runs)


#: What letters are not: all but word characters, and of those the digits, numerals and the underscore.
OTHER = rf"\W\d_{_numerals()}"
#: A space and letters; a space and anything up to the next white space; white space as the byte-level pattern groups it.
BYTE_PARTS = re.compile(rf" ?[^{OTHER}]+| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Letters that a space, comma, full stop or line end follows (but one letter, whose lower case ends in a mark); anything up to the next ASCII white space.
WORD_PARTS = re.compile(rf"[^{OTHER}\u0130]+(?=[ ,.\n])|[^ \t\n\r\x0b\x0c]+")
#: What str.split() takes for white space and the tokenizers don't.
CONTROLS = re.compile("[\x1c-\x1f]")
#: Parts held at most, twice (those in use, and those of the time before).  About 150 bytes each.
ENTRIES = 400_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: its own where that is printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in shown else next(other)) for b in range(256)]


SYMBOLS = dict(enumerate(byte_symbols()))


class Store(dict):
    """Ids of parts, as bytes; a part that isn't held is encoded when it is asked for.  When there are too many, those not asked for since the last time are dropped."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= ENTRIES:
            self.old = dict(self)
            self.clear()
        found = self.old.get(part) or self.encode(part)
        if len(part) < 32:  # longer ones hardly come again
            self[part] = found
        return found


class Encoder:
    """ids(text): the text's ids as little-endian unsigned 32-bit integers, in bytes.

    Texts are first split at spaces, which is quick; a piece that is letters,
    or letters and one mark, is a part or two, and others are split by the
    pattern of the parts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.parts = self._split()
        self.pieces, self.store = Store(self._piece), Store(self._part)
        self.lead, self.symbol = (" ", "Ġ") if self.parts is BYTE_PARTS else ("", "")
        self.ends = {c: self._whole(c) for c in ",.!?;:"}

    def _split(self) -> re.Pattern | None:
        """The pattern of the parts that the tokenizer's settings allow, if any."""
        library = self.library
        settings = lambda x: json.loads(x.__getstate__()) if x is not None else {}
        pre, norm = settings(library.pre_tokenizer), settings(library.normalizer)
        if type(self.model).__name__ != "BPE" or self.model.dropout or library.truncation or library.padding or any(t.lstrip or t.rstrip or t.single_word for t in library.get_added_tokens_decoder().values()):
            return None
        if not norm and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]:
            return BYTE_PARTS
        kinds = [n["type"] for n in norm.get("normalizers", [])]
        steps = pre.get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]:
            return WORD_PARTS
        return None

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _letters(self, word: str) -> bytes:
        """Of a word of letters: the library's model on the word's byte symbols; the library as a whole for letters beyond U+024F."""
        if not word.isascii() and (max(word) > "\u024f" or "\u0130" in word):
            return self._whole(self.lead + word)
        if self.parts is WORD_PARTS and (low := word.lower()) != word:
            return self.pieces[low]
        own = self.symbol + (word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(SYMBOLS))
        return array("I", [t.id for t in self.model.tokenize(own)]).tobytes()

    def _part(self, part: str) -> bytes:
        """Of a part as the pattern gives it, which begins with a space only if that belongs to it."""
        word = part.removeprefix(" ") if self.lead else part
        if word.isalpha() and len(word) < len(part) + (not self.lead):
            return self.pieces[word]
        return self._whole(part)

    def _piece(self, piece: str) -> bytes:
        """Of a piece between spaces, with the space before it where that belongs to it."""
        if piece.isalpha():
            return self._letters(piece)
        if piece[-1:] in self.ends and piece[:-1].isalpha() and "\u0130" not in piece:  # whose lower case ends in a mark
            return self.pieces[piece[:-1]] + self.ends[piece[-1]]
        return b"".join(map(self.store.__getitem__, self.parts.findall(self.lead + piece)))

    def rest(self) -> None:
        """Between tasks, an idle process holds the parts in use alone."""
        self.pieces.old, self.store.old = {}, {}
        release()

    def ids(self, text: str) -> bytes:
        if self.parts is None or any(a in text for a in self.added):
            return self._whole(text)
        if self.parts is WORD_PARTS and not CONTROLS.search(text):
            return b"".join(map(self.pieces.__getitem__, text.split()))
        if self.parts is BYTE_PARTS and "  " not in text:  # more spaces group in ways that pieces don't show
            first, *rest = text.split(" ")
            return b"".join(map(self.store.__getitem__, BYTE_PARTS.findall(first))) + b"".join(map(self.pieces.__getitem__, rest))
        return b"".join(map(self.store.__getitem__, self.parts.findall(text)))


@lru_cache(maxsize=2)
def vocabulary_size(path: str) -> int:
    """One more than the largest id that a tokenizer file can give."""
    from tokenizers import Tokenizer

    return 1 + max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per process and file."""
    return Encoder(path)


def default_path(name: str) -> str:
    """Where a public vocabulary file of this machine is; nothing is copied into the repository."""
    import public_tokenizers

    return str(public_tokenizers.path(name))

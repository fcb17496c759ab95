"""Encoding texts by remembered words.

Both vocabularies split a text at white space before they merge, so a word between single spaces has the same ids in
every text. The encoders here cut texts at single spaces and line ends, look each distinct word up in a bounded memory
and ask the tokenizer only for words that are not in it. Texts with other white-space runs go to the tokenizer whole, as
do texts that hold the string of an added token, which the library gives that token's id.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than the space and the line end.
_OTHER = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_OTHER_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def uneven(text: str) -> bool:
    """Whether white space other than single spaces and line ends between words is in the text."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return True
    return any(c in text for c in (_OTHER if text.isascii() else _OTHER + _OTHER_WIDE))


def _groups(texts: list[str | None], chars: int = 500_000) -> Iterator[list[str]]:
    """Texts in order, in groups of about ``chars`` characters; null as empty."""
    some, n = [], 0
    for t in texts:
        some.append(t or "")
        n += len(some[-1])
        if n >= chars:
            yield some
            some, n = [], 0
    if some:
        yield some


class _Memory:
    """At most ``size`` words twice: when the young half is full, it becomes the old one."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, words: list[str], missing: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        find, old = self.young.get, self.old
        out = [find(w) for w in words]
        if gaps := [i for i, v in enumerate(out) if v is None]:
            new = dict.fromkeys([words[i] for i in gaps])
            for w in new:
                new[w] = old.get(w)
            if unknown := [w for w, v in new.items() if v is None]:
                new.update(zip(unknown, missing(unknown), strict=True))
            for i in gaps:
                out[i] = new[words[i]]
            if len(self.young) + len(new) > self.size:
                self.old, self.young = self.young, {}
            self.young.update(new)
        return out


class LineChunks:
    """For encoders that join a space with the word after it. ``encode_many`` gives each string's ids as bytes, and
    ``whole`` those of a text with any of the strings ``added`` in it."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], size: int = 400_000, added: tuple[str, ...] = (), whole: Callable[[str], bytes] | None = None):
        self.many, self.added, self.text = encode_many, added, whole
        self.heads, self.tails = _Memory(size), _Memory(size)
        self.newline = encode_many(["\n"])[0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [x for some in _groups(texts) for x in self._some(some)]

    def _some(self, texts: list[str]) -> list[bytes]:
        cut = [None if not t or uneven(t) or any(x in t for x in self.added) else [line.split(" ") for line in t.split("\n")] for t in texts]
        heads = iter(self.heads.get([x[0] for lines in cut if lines for x in lines], self.many))
        tails = self.tails.get([w for lines in cut if lines for x in lines for w in x[1:]], lambda new: self.many([" " + w for w in new]))
        out, at = [], 0
        for text, lines in zip(texts, cut, strict=True):
            if lines is None:
                out.append(b"" if not text else self.text(text) if any(x in text for x in self.added) else self.many([text])[0])
                continue
            parts = []
            for x in lines:
                parts.append(next(heads))
                parts += tails[at : at + len(x) - 1]
                parts.append(self.newline)
                at += len(x) - 1
            parts.pop()
            out.append(b"".join(parts))
        return out


class WordChunks:
    """For encoders that drop white space: every word stands alone. ``added`` and ``whole`` as above."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], size: int = 500_000, added: tuple[str, ...] = (), whole: Callable[[str], bytes] | None = None):
        self.many, self.memory, self.added, self.text = encode_many, _Memory(size), added, whole

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [x for some in _groups(texts) for x in self._some(some)]

    def _some(self, texts: list[str]) -> list[bytes]:
        cut = [None if any(x in t for x in self.added) else t.replace("\n", " ").split(" ") for t in texts]
        found, out, at = self.memory.get([w for words in cut if words for w in words], self.many), [], 0
        for text, words in zip(texts, cut, strict=True):
            if words is None:
                out.append(self.text(text))
                continue
            out.append(b"".join(found[at : at + len(words)]))
            at += len(words)
        return out


#: One composed Latin word, maybe with a space before it and signs (none of them an apostrophe) after it.
_SIMPLE = re.compile(r"""( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)([.,;:!?|*%$&#"()\-]*)""")
#: How byte-level vocabularies spell the bytes that have no printable sign: by the code points from 256 on.
_SPELLING = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


_LATIN, _SIGNS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+", '.,;:!?|*%$&#"()-'


class LibraryEncoder:
    """Ids by the tokenizers library as little-endian unsigned 32-bit integers.

    Short parts go through the library's own normaliser, pre-tokenizer and merges one after the other, which gives the
    ids of a full encoding without the offsets that it computes; a Latin word with signs after it needs the merges only.
    """

    def __init__(self, path: str, lower: bool, space: str = ""):
        """``lower``: the vocabulary folds case. ``space``: how its pieces spell a space before a word."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.signs: dict[str, list[int]] = {}
        self.lower, self.space, self.pack = lower, space, lambda ids: array("I", ids).tobytes()

    def __call__(self, parts: list[str]) -> list[bytes]:
        return [self.pack(self.ids(p)) for p in parts]

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of Latin words after a space."""
        tokenize, space = self.tokenizer.model.tokenize, self.space
        if not self.lower:
            return [array("I", [t.id for t in tokenize(space + (w if w.isascii() else self.spelt(w)))]).tobytes() for w in words]
        return [self.pack([t.id for t in tokenize(space + self.spelt(w))]) for w in words]

    def text(self, text: str) -> bytes:
        """A whole text's ids by the library's own encoding."""
        return self.pack(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def ids(self, part: str) -> list[int]:
        """The ids of a part without the strings of added tokens."""
        tokenizer = self.tokenizer
        if not part or len(part) > 1000:
            return tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids
        word = part[1:] if part[0] == " " else part
        if word.isascii() and word.isalpha():
            return [t.id for t in tokenizer.model.tokenize((self.space if word is not part else "") + (word.lower() if self.lower else word))]
        if simple := _SIMPLE.fullmatch(part):
            space, word, signs = simple.groups()
            found = [t.id for t in tokenizer.model.tokenize((self.space if space else "") + self.spelt(word))]
            return found + self.after(signs) if signs else found
        return self.whole(part)

    def whole(self, part: str) -> list[int]:
        """The ids of any part."""
        tokenizer = self.tokenizer
        if tokenizer.normalizer:
            part = tokenizer.normalizer.normalize_str(part)
        return [t.id for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(part) for t in tokenizer.model.tokenize(piece)]

    def spelt(self, word: str) -> str:
        """A word of Latin letters as the vocabulary spells its bytes."""
        if self.lower:
            word = word.lower()
        return word if word.isascii() else word.encode().decode("latin-1").translate(_SPELLING)

    def after(self, signs: str) -> list[int]:
        if (found := self.signs.get(signs)) is None:
            found = self.signs[signs] = self.whole(signs)
            if len(self.signs) > 10_000:
                self.signs.clear()
        return found


def _joined(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of a table that begin at ``starts``, one after the other."""
    ends = sizes.cumsum()
    kind = np.int32 if max(len(table), *ends[-1:], 0) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + sizes).astype(kind), sizes)
    at += np.arange(len(at), dtype=kind)
    return table.take(at)


class EndedTexts:
    """Whole texts' ids and an end id after each, for vocabularies that join a space with the word after it.

    Arrow cuts the texts and finds the distinct words, which are looked up in a memory of at most ``size`` words; only those
    not in it are encoded. Signs after a Latin word have ids of their own. A word after a line end is kept with that, a
    text's first word with the end id, which is then that of the text before.
    """

    def __init__(self, path: str, end: int, size: int = 1_000_000):
        self.encoder, self.end, self.size = LibraryEncoder(path, False, "\u0120"), end, size
        self.before = {"\r": self.encoder.pack([end]), "\n": self.encoder(["\n"])[0]}
        self.known, self.used = pa.array([], pa.string()), np.zeros(0, bool)
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        rows, added = texts.to_pylist(), self.encoder.added
        odd = {i for i, t in enumerate(rows) if not t or uneven(t) or any(x in t for x in added)}
        even = iter(self._even([t for i, t in enumerate(rows) if i not in odd]))
        return [self._odd(t or "") if i in odd else next(even) for i, t in enumerate(rows)]

    def _odd(self, text: str) -> np.ndarray:
        whole = self.encoder.text(text) if any(x in text for x in self.encoder.added) else self.encoder([text])[0]
        return np.append(np.frombuffer(whole, "<u4"), np.uint32(self.end))

    def _even(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        pieces = pc.split_pattern(pa.array(["\r" + t.replace("\n", " \n") for t in texts], pa.string()), " ")
        named = pieces.flatten().dictionary_encode()
        ids, size = self._distinct(named.dictionary)
        which, offsets = named.indices.to_numpy(), pieces.offsets.to_numpy()
        sizes = size.take(which)
        flat = np.append(_joined(ids, (size.cumsum() - size).take(which), sizes)[1:], np.uint32(self.end))
        ends = sizes.cumsum().take(offsets[1:] - offsets[0] - 1).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and how many each has."""
        words = pc.utf8_rtrim(pieces, _SIGNS)
        latin = pc.and_(pc.match_substring_regex(words, _LATIN + "$"), pc.less(pc.binary_length(words), 1000))
        words = pc.if_else(latin, words, pieces)
        at = self._places(words, latin)
        signed = pc.not_equal(words, pieces)
        signs = pc.replace_substring_regex(pieces.filter(signed), _LATIN, "").dictionary_encode()
        after = self.encoder(signs.dictionary.to_pylist())
        table = np.concatenate([self.ids, np.frombuffer(b"".join(after), "<u4")])
        more = np.fromiter(map(len, after), np.int64, len(after)) >> 2
        starts, sizes = np.zeros((len(pieces), 2), np.int64), np.zeros((len(pieces), 2), np.int64)
        starts[:, 0], sizes[:, 0] = (self.sizes.cumsum() - self.sizes).take(at), self.sizes.take(at)
        if len(after):
            rows, which = np.flatnonzero(signed.to_numpy(zero_copy_only=False)), signs.indices.to_numpy()
            starts[rows, 1], sizes[rows, 1] = (more.cumsum() - more).take(which) + len(self.ids), more.take(which)
        return _joined(table, starts.ravel(), sizes.ravel()), sizes.sum(axis=1)

    def _places(self, words: pa.Array, latin: pa.Array) -> np.ndarray:
        """Where the words are in the memory, which takes in those that were not."""
        if len(self.known) > self.size:  # keep what was met again since it was taken in
            starts, kept = self.sizes.cumsum() - self.sizes, self.used
            self.ids, self.sizes = _joined(self.ids, starts[kept], self.sizes[kept]), self.sizes[kept]
            self.known, self.used = self.known.filter(pa.array(kept)), np.zeros(int(kept.sum()), bool)
        found = pc.index_in(words, value_set=self.known)
        at, n = pc.fill_null(found, -1).to_numpy().astype(np.int64), len(self.known)
        gone = at < 0
        self.used[at[~gone]] = True
        if gone.any():
            simple = latin.to_numpy(zero_copy_only=False)
            plain, other = (pc.unique(words.filter(pa.array(gone & x))) for x in (simple, ~simple))
            made = self.encoder.words(_strings(plain)) + self._others(_strings(other))
            new = pa.concat_arrays([plain, other])
            at[gone] = pc.index_in(words.filter(pa.array(gone)), value_set=new).to_numpy().astype(np.int64) + n
            self.known, self.used = pa.concat_arrays([self.known, new]), np.append(self.used, np.zeros(len(new), bool))
            self.sizes = np.append(self.sizes, np.fromiter(map(len, made), np.int64, len(made)) >> 2)
            self.ids = np.append(self.ids, np.frombuffer(b"".join(made), "<u4"))
        return at

    def _others(self, pieces: list[str]) -> list[bytes]:
        before = self.before
        made = self.encoder([x[1:] if x[0] in before else " " + x for x in pieces])
        return [before[x[0]] + ids if x[0] in before else ids for x, ids in zip(pieces, made, strict=True)]


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def byte_level(path: str) -> LineChunks:
    """For vocabularies that keep white space and case."""
    encoder = LibraryEncoder(path, False, "\u0120")
    return LineChunks(encoder, added=encoder.added, whole=encoder.text)


def word_level(path: str) -> WordChunks:
    """For vocabularies that fold case and drop white space."""
    encoder = LibraryEncoder(path, True)
    return WordChunks(encoder, added=encoder.added, whole=encoder.text)

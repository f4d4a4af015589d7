"""Token ids by the tokenizers library, each distinct word encoded once per worker.

A word is a stretch between single spaces. Both vocabularies used here split
texts before merging such that no merge crosses a lone space, so the ids of a
text are its words' ids side by side; where a space has white space beside it
the text is cut only at lone spaces, and the rest goes to the library whole. A
text that holds a special token's own spelling goes there whole as well. A
vocabulary that lower-cases takes all white space as an end of a word, so its
texts are cut at every ASCII white space, and Latin-1 texts are lower-cased at
once.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Words a worker remembers; beyond it the memory starts anew (results don't depend on it).
REMEMBERED = 1_000_000

_ENCODERS: dict[str, "WordEncoder"] = {}


#: Marks that end a word and are pre-tokens of their own in both vocabularies.
MARKS = frozenset(",.;:!?")
#: Letters below U+0250 but U+0130, and one mark at most behind them (see _plain).
PLAIN_WORD = (r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+[,.;:!?]?$")


def _plain(word: str) -> bool:
    """Only letters below U+0250 that stay letters in lower case (U+0130 gets a
    mark of its own): one pre-token in either vocabulary, which no normalisation
    but lower case changes."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250" and word.lower().isalpha())


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself
    where it prints, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """``tokenizers`` ids of whole texts. Plain words go straight to the
    vocabulary's BPE model, all else through the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        wide = self.tok.get_vocab_size() > 65536
        self.dtype, self._code = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        self.letters = _byte_letters()
        # a vocabulary with word ends drops the space and lower-cases; the other keeps the space as a letter
        self.lowers = bool(getattr(self.tok.model, "end_of_word_suffix", None))
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        # of a vocabulary that lower-cases: the words met lately, and those before
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.marks = {m: self._pack(self.tok.encode(m, add_special_tokens=False).ids) for m in MARKS}

    def _pack(self, ids: list[int]) -> bytes:
        return array(self._code, ids).tobytes()

    def _word(self, word: str, lead: str) -> bytes:
        text = word.lower() if self.lowers else lead + word
        if not (self.lowers and text.isascii()):  # ASCII letters stand for themselves
            text = text.encode().decode("latin-1").translate(self.letters)
        return self._pack([t.id for t in self.tok.model.tokenize(text)])

    def _learn(self, words: list[str], known: dict[str, bytes], lead: str) -> None:
        rest = []
        for w in words:
            if _plain(w):
                known[w] = self._word(w, lead)
            elif w[-1:] in self.marks and _plain(w[:-1]):
                base = known.get(w[:-1])
                if base is None:
                    base = known[w[:-1]] = self._word(w[:-1], lead)
                known[w] = base + self.marks[w[-1]]
            else:
                rest.append(w)
        if rest:
            for w, e in zip(rest, self.tok.encode_batch_fast([lead + w for w in rest], add_special_tokens=False)):
                known[w] = self._pack(e.ids)

    def _lowered(self, text: str) -> str | None:
        """``text`` with its words in lower case, None where the tokenizer must take it whole. Only Latin-1 is
        lowered here: beside a combining mark, lower case before normalisation could give another letter."""
        if any(s in text for s in self.specials):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        text = text.lower()
        return None if any(s in text for s in self.specials) else text  # <|ENDOFTEXT|> is no special token

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text. Where white space ends words, the distinct words of all texts are looked up
        once and their ids laid out by position."""
        if not self.lowers:
            return [self.ids(t) for t in texts]
        lowered = [self._lowered(t) for t in texts]
        lists = pc.ascii_split_whitespace(pa.array([t or "" for t in lowered], pa.string()))
        words = lists.flatten().dictionary_encode()
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        each = self._looked_up(words.dictionary)
        flat = np.frombuffer(b"".join(each), self.dtype)
        size = np.fromiter(map(len, each), np.int64, len(each)) // self.dtype.itemsize
        begin = np.cumsum(size) - size
        at = words.indices.to_numpy()
        many = size.take(at)
        stop = np.cumsum(many)
        total = int(stop[-1]) if len(stop) else 0
        ids = flat.take(np.repeat(begin.take(at) - (stop - many), many) + np.arange(total))
        ends = np.concatenate([[0], stop])[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        return [ids[i:j] if low is not None else self._whole(t)
                for t, low, i, j in zip(texts, lowered, ends, ends[1:])]

    def _looked_up(self, words: pa.Array) -> list[bytes]:
        """The ids of each of the distinct ``words``; a plain word is kept without the mark that ends it."""
        plain = pc.match_substring_regex(words, PLAIN_WORD).to_numpy(zero_copy_only=False)
        bases = pc.if_else(pa.array(plain), pc.utf8_rtrim(words, characters="".join(MARKS)), words)
        marked = np.flatnonzero(pc.not_equal(bases, words).to_numpy(zero_copy_only=False))
        keys = bases.cast(pa.binary()).to_pylist()
        known, older = self.known, self.older
        each = list(map(known.get, keys))
        new = [k for k, ids in enumerate(each) if ids is None]
        if older:
            for k in new:
                ids = older.get(keys[k])
                if ids is not None:
                    each[k] = known[keys[k]] = ids
            new = [k for k in new if each[k] is None]
        fresh = list(dict.fromkeys(keys[k] for k in new if plain[k]))
        known.update((w, self._word(w.decode(), "")) for w in fresh)
        rest = [keys[k] for k in new if not plain[k]]
        for w, e in zip(rest, self.tok.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
            known[w] = self._pack(e.ids)
        for k in new:
            each[k] = known[keys[k]]
        for k, w in zip(marked.tolist(), words.take(pa.array(marked)).to_pylist()):
            each[k] += self.marks[w[-1]]
        return each

    def _whole(self, text: str) -> np.ndarray:
        return np.frombuffer(self._pack(self.tok.encode(text, add_special_tokens=False).ids), self.dtype)

    def ids(self, text: str) -> np.ndarray:
        """The whole text's ids (uint16 or uint32, little-endian)."""
        if self.lowers:
            return self.many([text])[0]
        if any(s in text for s in self.specials):
            return self._whole(text)
        parts = text.split(" ")
        later = self.later
        try:
            out = [later[p] for p in parts[1:]]
        except KeyError:
            new = [p for p in set(parts[1:]) if p not in later]
            if any(not p or p[0].isspace() or p[-1].isspace() for p in new) or text[:1].isspace():
                return self._mixed(text)
            if len(later) > REMEMBERED:
                later.clear()
                new = list(set(parts[1:]))
            self._learn(new, later, " ")
            out = [later[p] for p in parts[1:]]
        if len(parts) > 1 and (not parts[0] or parts[0][-1].isspace()):
            return self._mixed(text)
        return np.frombuffer(self._head(parts[0]) + b"".join(out), self.dtype)

    def _head(self, word: str) -> bytes:
        if word not in self.first:
            if len(self.first) > REMEMBERED // 10:
                self.first.clear()
            self._learn([word], self.first, "")
        return self.first[word]

    def _mixed(self, text: str) -> np.ndarray:
        parts = LONE_SPACE.split(text)
        out = [self._pack(e.ids) for e in self.tok.encode_batch_fast(
            [parts[0], *(" " + p for p in parts[1:])], add_special_tokens=False)]
        return np.frombuffer(b"".join(out), self.dtype)


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; kept across tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]

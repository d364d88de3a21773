"""Encoding with the tokenizers library through a bounded memo of space-separated chunks.

A tokenizer whose pre-tokenizer never lets a token run from one word over a following single space gives
the same ids for a text as for its chunks, each starting at such a space, in turn. Chunks repeat, so most
are looked up. The memo holds two generations of at most ``cap`` chunks each.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from lumafold.llm.common import own_memory

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Before a single space that stands between two characters that aren't white space.
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


#: Longest chunk that a memo keeps.
LONGEST = 256


class _Unsafe(Exception):
    """A text holds a word at which it can't be cut."""


class _Memo(dict):
    """A dictionary that asks for what it lacks."""

    def __init__(self, ask: Callable[[str], bytes]) -> None:
        super().__init__()
        self._ask = ask

    def __missing__(self, word: str) -> bytes:
        return self._ask(word)


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    drops_space: the tokenizer drops white space, so every space is a place to cut. Otherwise a space is
    one only between two characters that aren't white space; texts with other spaces take a slower path.
    A text that holds a special token as it is written takes the library's own way as a whole, since the library
    finds such tokens before it cuts anything (``Tokenizer.encode(text, add_special_tokens=False)`` gives their ids).
    """

    def __init__(self, path: str, drops_space: bool, cap: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.marked = Tokenizer.from_file(path)
        special = {i: t.content for i, t in self.marked.get_added_tokens_decoder().items() if t.special}
        if any(not t.special or t.normalized or "<" not in t.content for t in self.marked.get_added_tokens_decoder().values()):
            raise ValueError("added tokens must be special ones with a '<', matched as they are written")
        self.mark_id, self.mark = max(special.items()) if special else (-1, "")
        self.special = tuple(special.values())
        self.drops_space, self.cap = drops_space, cap
        self._byte_letters = {b: c for b, c in _byte_letters().items() if chr(b) != c}
        self.words = _Memo(self._word_ids)  # of a word with the space before it, if spaces count
        self.older: dict[str, bytes] = {}
        self.rare: dict[str, bytes] = {}  # of short first chunks, and of short chunks with other white space
        self.marks = {m: array("I", [t.id for t in self.plain.model.tokenize(m)]).tobytes() for m in ".,!?;:"}
        probes = ["the", "Théa", "ßtr", "x,", "Àb.", "q?", "zzgh", "É", "über!", "a;", "Ñu:", "µ", *([] if drops_space else ["\nThe", "\nÉa."])]
        #: Whether the model alone agrees with the whole tokenizer on the probes; else it isn't used alone.
        self.direct = self._encoded([self._chunk(w) for w in probes]) == [self._by_model(w) for w in probes]

    def _fresh(self, chunks: list[str]) -> list[bytes]:
        """Encode chunks: in one text, apart from each other by a special token, or alone if they contain one."""
        out: list[bytes] = []
        if not self.special or any("<|" in c for c in chunks):
            return [np.array(e.ids, "<u4").tobytes() for e in self.plain.encode_batch_fast(chunks, add_special_tokens=False)]
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            ids = np.array(self.marked.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            raw = ids.tobytes()
            starts, ends = [0, *((cuts + 1) * 4).tolist()], [*(cuts * 4).tolist(), len(raw)]
            if len(starts) != len(part):
                raise ValueError("the tokenizer does not keep its special token apart")
            out += [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        return out

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """As _fresh; the few chunks that might hold a special token's text go apart."""
        if not any("<|" in c for c in chunks):
            return self._fresh(chunks)
        odd = {c: ids for c in chunks if "<|" in c for ids in self._fresh([c])}
        even = iter(self._fresh([c for c in chunks if c not in odd]))
        return [odd[c] if c in odd else next(even) for c in chunks]

    def _by_model(self, word: str) -> bytes | None:
        """Ids of ``word`` as it stands in the memo, from the library's model alone: for Latin-1 letters, then at most one
        mark of ".,!?;:". Such a word is one pre-token, or two, whose letters are known without the library's
        normalizer and pre-tokenizer; None for others."""
        lead = word[0] == "\n"
        if word[-1] in self.marks:
            core = word[:-1]
            if not core[lead:].isalpha():
                return None
            ids = self.words.get(core) or self.older.get(core)
            if ids is None and (ids := self._by_model(core)) and len(core) <= LONGEST:
                self.words[core] = ids
            return ids + self.marks[word[-1]] if ids else None
        core = word[lead:]
        if not core.isalpha():
            return None
        if self.drops_space:
            core = core.lower()
        if not core.isascii():
            if max(core) > "\xff":
                return None
            core = core.encode().decode("latin-1").translate(self._byte_letters)
        tokenize = self.plain.model.tokenize
        if self.drops_space:
            ids = [t.id for t in tokenize(core)]
        elif lead:
            ids = [t.id for x in (self._byte_letters[10], core) for t in tokenize(x)]
        else:
            ids = [t.id for t in tokenize(self._byte_letters[32] + core)]
        return array("I", ids).tobytes()

    def _chunk(self, word: str) -> str:
        return word if self.drops_space else chunk_of(word)

    def _word_ids(self, word: str) -> bytes:
        """Ids of a word that the memo doesn't hold. Raises _Unsafe where the text can't be cut at every space."""
        ids = self.older.get(word)
        if ids is None:
            if self.direct and word:
                ids = self._by_model(word)  # a word of letters is safe to cut at
            if ids is None:
                if not self.drops_space and not safe_word(word):
                    raise _Unsafe
                ids = self._encoded([self._chunk(word)])[0]
            if len(word) > LONGEST:
                return ids
        self.words[word] = ids
        return ids

    def _rarely(self, chunks: list[str]) -> list[bytes]:
        missing = list(set(chunks).difference(self.rare))
        found = dict(zip(missing, self._encoded(missing), strict=True)) if missing else {}
        self.rare.update((c, ids) for c, ids in found.items() if len(c) <= LONGEST)
        return [found[c] if c in found else self.rare[c] for c in chunks]

    def _split(self, text: str) -> tuple[str, list[str]] | None:
        """A first chunk, and the words after it; None if the text can't be cut at every space."""
        if self.drops_space:
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, but not to the tokenizer
                return None
            return "", (text.lower() if text.isascii() or _latin(text) else text).split()
        head, *rest = cuts(text)
        return None if rest and not safe_word(head) else (head, rest)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids_of = self.words.__getitem__
        out: list[bytes] = []
        for text in texts:
            if "<" in text and any(s in text for s in self.special):
                out.append(np.array(self.marked.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            split = self._split(text)
            try:
                out.append(self._first(split[0]) + b"".join(map(ids_of, split[1])) if split else self._slowly(text))
            except _Unsafe:
                out.append(self._slowly(text))
        if len(self.words) > self.cap:
            self.older, self.words = self.words, _Memo(self._word_ids)
        if len(self.rare) > self.cap // 8:
            self.rare = {}
        return out

    def _first(self, head: str) -> bytes:
        return self._rarely([head])[0] if head else b""

    def _slowly(self, text: str) -> bytes:
        return b"".join(self._rarely([text] if self.drops_space else safe_chunks(text)))


def _latin(text: str) -> bool:
    """Whether lower-casing works letter by letter, without rules of position: within Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def cuts(text: str) -> list[str]:
    """The text's words as they stand between spaces; a word after a line break keeps the break."""
    return text.replace("\n", " \n").split(" ")


def chunk_of(word: str) -> str:
    """What ``word`` (not the first of cuts) stands for."""
    return word if word[0] == "\n" else " " + word


def safe_word(word: str) -> bool:
    """Whether white space is nowhere but in the single line break that may stand before the word.
    A text with another word than such (as where spaces follow each other) can't be cut at every space."""
    body = word[1:] if word[:1] == "\n" else word
    return bool(body) and not body[0].isspace() and not body[-1].isspace()


def safe_chunks(text: str) -> list[str]:
    """The text, cut before each single space between two characters that aren't white space."""
    return _SAFE_CUT.split(text)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: printable Latin-1 as itself, the rest from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


@lru_cache(maxsize=4)
def _kept(path: str, drops_space: bool, cap: int) -> ChunkEncoder:
    return ChunkEncoder(path, drops_space, cap)


def encoder(path: str, drops_space: bool, cap: int = 500_000) -> ChunkEncoder:
    """One encoder for each worker process, kept over its tasks."""
    own_memory(path, _kept.cache_clear)
    return _kept(path, drops_space, cap)

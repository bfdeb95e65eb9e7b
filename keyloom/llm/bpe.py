"""Byte-level BPE ids by the tokenizers library, each distinct chunk between safe boundaries encoded once.

A single blank or line feed between two characters that aren't white space always starts a new piece of
the byte-level pattern, whatever stands around it. Texts are cut there; a bounded table in each Python
worker keeps the ids of chunks seen, and only new chunks reach the library.
"""

from __future__ import annotations

import functools
import gc
import json
import re

import numpy as np

_ADJACENT = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_SAFE = re.compile(r"(?=.*[^\w.,;:!?])\S+")
_SIGNS = frozenset(".,;:!?")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


class ChunkedBpe:
    """``encode(texts)`` gives each text's ids as little-endian bytes of ``dtype``.

    ``table_limit`` bounds the chunks kept in memory; beyond it the table starts anew, which only costs time. A word with
    a sign behind it is looked up as a word and a sign.
    Tokenizers of other kinds than plain byte-level BPE get whole texts.
    """

    def __init__(self, path: str, table_limit: int = 500_000, segment_chars: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.chunked = not made.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        # an added token may neither reach over a cut nor lie in a word with a sign
        self.chunked = self.chunked and all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and _SAFE.fullmatch(t["content"]) for t in made.get("added_tokens") or [])
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.table_limit, self.segment_chars = table_limit, segment_chars
        self.heads: dict[str, bytes] = {}
        self.table: dict[str, bytes] = {}
        self.signs = {x: self._ids(x) for x in _SIGNS} if self.chunked else {}

    def _segments(self, text: str):
        """(starts the text, part): parts of long texts, cut at single blanks, which are left out."""
        at, first = 0, True
        while len(text) - at > 2 * self.segment_chars and (cut := _SINGLE.search(text, at + self.segment_chars)):
            yield first, text[at : cut.start()]
            at, first = cut.end(), False
        yield first, text[at:] if at else text

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """Chunks without the blank that starts them; the first one stands as it is."""
        if not _ADJACENT.search(text):
            return text.replace("\n", " \n").split(" ")
        return [x[1:] if i and x[0] == " " else x for i, x in enumerate(_CUT.split(text))]

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _add(self, chunks: list[str]) -> None:
        """Words of letters that every Unicode version agrees on are one piece of the pattern, and the model gets them as they are."""
        tokenize, table, dtype = self.tokenizer.model.tokenize, self.table, self.dtype
        others = []
        for x in chunks:
            if x.isalpha() and (x.isascii() or max(x) < "\u0250"):
                word = "\u0120" + (x if x.isascii() else x.encode().decode("latin-1").translate(_BYTES))
                table[x] = np.array([t.id for t in tokenize(word)], dtype).tobytes()
            else:
                others.append(x)
        full = [x if x[:1] == "\n" else " " + x for x in others]
        table.update((x, np.array(e.ids, dtype).tobytes()) for x, e in zip(others, self.tokenizer.encode_batch_fast(full, add_special_tokens=False)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.chunked:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out = [b""] * len(texts)
        short = [i for i, x in enumerate(texts) if len(x) <= 2 * self.segment_chars]
        for i, ids in zip(short, self._join([self._chunks(texts[i]) for i in short], [True] * len(short))):
            out[i] = ids
        for i, text in enumerate(texts):
            if len(text) > 2 * self.segment_chars:
                out[i] = b"".join(self._join([self._chunks(part)], [first])[0] for first, part in self._segments(text))
        return out

    def _join(self, cut: list[list[str]], first: list[bool]) -> list[bytes]:
        table, signs = self.table, self.signs
        if len(table) > self.table_limit:
            table.clear()
        found = [list(map(table.get, chunks[1:] if head else chunks)) for chunks, head in zip(cut, first)]
        # of the chunks that aren't there: a word and its sign apart, if the word is one of letters
        missing, words = [], set()
        for ids, chunks, head in zip(found, cut, first):
            for i, x in enumerate(ids):
                if x is None:
                    chunk = chunks[i + head]
                    if chunk[-1:] in signs and (word := chunk[:-1]).isalpha() and (word.isascii() or max(word) < "\u0250"):
                        sign = signs[chunk[-1]]
                    else:
                        word, sign = chunk, b""
                    ids_of = table.get(word)
                    if ids_of is None:
                        words.add(word)
                    elif sign:
                        # a word met before: it may come again with the same sign
                        ids[i] = table[chunk] = ids_of + sign
                        continue
                    missing.append((ids, i, word, sign))
        self._add(list(words))
        for ids, i, word, sign in missing:
            ids[i] = table[word] + sign
        heads = [self._head(chunks[0]) if head else b"" for chunks, head in zip(cut, first)]
        return [head + b"".join(ids) for head, ids in zip(heads, found)]

    def _head(self, chunk: str) -> bytes:
        if len(self.heads) > self.table_limit // 8:
            self.heads.clear()
        if chunk not in self.heads:
            self.heads[chunk] = self._ids(chunk)
        return self.heads[chunk]


def _byte_letters() -> dict[int, str]:
    """The published letters that stand for bytes in byte-level BPE: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_letters()


@functools.cache
def worker_bpe(path: str) -> ChunkedBpe:
    """One table for each Python worker, kept from task to task; it holds no cycles, so looking for them is rarer."""
    gc.set_threshold(200_000, 20, 100)
    return ChunkedBpe(path)

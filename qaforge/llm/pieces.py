"""Token ids and token counts of whole texts, with a memo of space-separated pieces.

Both vocabularies here never join text across a space that follows a non-space character, so a text may be cut
there and each piece encoded alone. A piece that was seen before costs one dictionary lookup; the tokenizer library
itself encodes every other piece. The memo is bounded: when full, it starts again with the pieces in use.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_SPACE_RUNS = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")
_JOINED = 256  # pre-tokens that go to the library as one text
GROUP = 1 << 20  # bytes of text that are encoded at once, a longer text by itself
#: The pre-tokenizer's pattern (fixed by the vocabulary), and characters on which it depends in no Unicode version.
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PLAIN = re.compile("[\n!-~\u00a1-\u024f\u2010-\u2027]+")
_ENDED = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+[.,;:!?]")  # a word and one mark: two pre-tokens
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[*range(9, 14), *range(28, 33)]] = True
_BEGINS, _ENDS, _ODD = 1, 2, 4  # white space at a piece's begin or end; separators that only Python takes for white space
_ODD_ONES = frozenset("\x1c\x1d\x1e\x1f")


class PieceEncoder:
    """Ids of a byte-level BPE of the tokenizers library, as little-endian unsigned 16- or 32-bit integers.

    encode_batch(texts, add_special_tokens=False) of the library gives the same ids. Its pre-tokenizer starts a new
    pre-token at every space that stands between two non-space characters, or between white space and a non-space
    character, so pieces cut there are encoded independently of each other. A piece that holds more than letters is cut
    into pre-tokens, so that a word is encoded once whatever punctuation follows it.
    """

    def __init__(self, path: str, keep: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.bytes_of = np.zeros(size, np.int64)
        for string, i in self.library.get_vocab().items():
            self.bytes_of[i] = len(string)  # a byte-level vocabulary has one character for each byte
        added = self.library.get_added_tokens_decoder()
        for i, token in added.items():
            self.bytes_of[i] = len(token.content.encode())
        self.has_added = re.compile("|".join(re.escape(t.content) for t in added.values()) or "(?!)").search
        # alone: words of letters; joint: all other pieces, both without the space before them. bare: pre-tokens without one.
        self.keep, self.alone, self.joint, self.bare = keep, {}, {}, {}

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, tokens: list[str], into: dict, spaced: bool) -> None:
        """Encode tokens without white space, _JOINED of them as one text: each with a space before it, or a line break after."""
        width = self.dtype.itemsize
        groups = [tokens[i : i + _JOINED] for i in range(0, len(tokens), _JOINED)]
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            texts = [" " + " ".join(g) if spaced else "\n".join(g) for g in part]
            for group, encoding in zip(part, self.library.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(encoding.ids, self.dtype)
                ends = np.cumsum([1 + len(t.encode()) for t in group])
                sizes = np.cumsum(self.bytes_of[ids])
                cuts = (width * np.searchsorted(sizes, ends if spaced else ends - 1, "right")).tolist()
                begins = [0, *(cuts if spaced else (width * np.searchsorted(sizes, ends[:-1], "right")).tolist())]
                raw = ids.tobytes()
                into.update(zip(group, [raw[a:b] for a, b in zip(begins, cuts)]))

    def _learn(self, new: list[str]) -> None:
        """Make the ids of these pieces known."""
        if len(self.alone) + 2 * len(new) > self.keep or len(self.joint) + len(new) > self.keep:
            self.alone, self.joint, self.bare = {}, {}, {}
        words, whole, ended, split = set(), [], [], []
        for p in new:
            if p.isalpha():
                words.add(p)
            elif _ENDED.fullmatch(p):
                ended.append(p)
            elif _PLAIN.fullmatch(p) and not self.has_added(p):
                split.append((p, _PRE_TOKEN.findall(" " + p)))
            else:
                whole.append(p)
        words.update([w for p in ended if (w := p[:-1]) not in self.alone])
        bare = {p[-1] for p in ended}
        for _, tokens in split:
            for t in tokens:
                if t[0] == " " and len(t) > 1:
                    words.add(t[1:])
                else:
                    bare.add(t)
        self._joined([w for w in words if w not in self.alone], self.alone, True)
        bare.difference_update(self.bare)
        spaces = [t for t in bare if t.isspace()]
        self._joined([t for t in bare if not t.isspace()], self.bare, False)
        self.bare.update(zip(spaces, self._by_library(spaces)))
        self.joint.update(zip(whole, self._by_library([" " + p for p in whole])))
        alone, bare = self.alone, self.bare
        self.joint.update([(p, alone[p[:-1]] + bare[p[-1]]) for p in ended])
        self.joint.update([(p, b"".join([alone[t[1:]] if t[0] == " " and len(t) > 1 else bare[t] for t in tokens])) for p, tokens in split])

    @staticmethod
    def _edges(dictionary: pa.Array, pieces: list[str]) -> np.ndarray:
        """Flags of each piece."""
        begin = np.frombuffer(dictionary.buffers()[1], np.int64, len(pieces) + 1, dictionary.offset * 8)
        data = dictionary.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[: begin[-1]] if data is not None else np.zeros(0, np.uint8)
        flag = np.full(len(pieces), _BEGINS | _ENDS, np.int8)
        some = np.flatnonzero(begin[1:] > begin[:-1])
        first, last = raw[begin[some]], raw[begin[some + 1] - 1]
        flag[some] = _BEGINS * _ASCII_SPACE[first] + _ENDS * _ASCII_SPACE[last]
        for i in some[(first >= 128) | (last >= 128)].tolist():
            flag[i] = _BEGINS * pieces[i][0].isspace() + _ENDS * pieces[i][-1].isspace()
        if ((raw >= 28) & (raw < 32)).any():
            flag |= np.array([_ODD * (not _ODD_ONES.isdisjoint(p)) for p in pieces], np.int8)
        return flag

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), one after the other, and their number for each text. end: an id after each text."""
        parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
        off = parts.offsets.to_numpy().astype(np.int64)
        found = parts.flatten().dictionary_encode()
        codes, distinct = found.indices.to_numpy().copy(), found.dictionary
        # No piece holds a space, so one string brings all of them to Python.
        one = pa.ListArray.from_arrays([0, len(distinct)], distinct.cast(pa.string()))
        pieces = pc.binary_join(one, " ")[0].as_py().split(" ") if len(distinct) else []
        heads, n_texts = off[:-1], len(texts)
        is_head = np.zeros(len(codes), bool)
        is_head[heads] = True
        # Texts with white space on both sides of a space go to the library whole.
        raws = list(map(self.alone.get, pieces))
        other = [i for i, raw in enumerate(raws) if raw is None]
        flag = self._edges(distinct, pieces)[codes]
        tight = flag & _ODD > 0
        tight[1:] |= (flag[:-1] & _ENDS > 0) & (flag[1:] & _BEGINS > 0) & ~is_head[1:]
        whole = np.unique(np.searchsorted(off, np.flatnonzero(tight), "right") - 1)
        by_piece = ~is_head
        for t in whole.tolist():
            by_piece[off[t] : off[t + 1]] = False
        used = np.zeros(len(pieces), bool)
        used[codes[by_piece]] = True
        self._fill(raws, pieces, [i for i in other if used[i]])
        for i in other:
            if raws[i] is None:
                raws[i] = b""  # in no text that is cut into pieces
        # Texts' heads have no space before them: the library encodes them, and whole texts.
        first = [pieces[i] for i in codes[heads].tolist()]
        for t in whole.tolist():
            first[t] = texts[t].as_py()
        own = list(dict.fromkeys(first))
        place = {p: i for i, p in enumerate(own)}
        raws += self._by_library(own)
        codes[heads] = len(pieces) + np.fromiter(map(place.__getitem__, first), np.int64, n_texts)
        keep = is_head | by_piece
        count = np.add.reduceat(keep.astype(np.int64), heads) if n_texts else np.zeros(0, np.int64)
        codes = codes[keep]
        if end is not None:
            codes = np.insert(codes, np.cumsum(count), len(raws))
            raws.append(np.array([end], self.dtype).tobytes())
            count = count + 1
        size = np.fromiter(map(len, raws), np.int64, len(raws)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(raws), self.dtype)
        size_of = size[codes]
        to = np.cumsum(size_of)
        shift = ((np.cumsum(size) - size)[codes] - to + size_of).astype(np.int32)
        ids = pool[np.repeat(shift, size_of) + np.arange(to[-1] if len(to) else 0, dtype=np.int32)]
        at = np.cumsum(count) - count
        return ids, np.add.reduceat(size_of, at) if n_texts else count

    def _fill(self, raws: list[bytes | None], pieces: list[str], wanted: list[int]) -> None:
        """Put the ids of these pieces, which `alone` does not have, into raws."""
        new = []
        for i in wanted:
            raws[i] = self.joint.get(pieces[i])
            if raws[i] is None:
                new.append(i)
        if new:
            self._learn([pieces[i] for i in new])
            for i in new:
                raws[i] = self.alone.get(pieces[i]) or self.joint[pieces[i]]


def whole_tokens(processor) -> frozenset[str]:
    """Proof by trial: the strings of the vocabulary that, as a word of their own, are encoded as exactly that token."""
    names = [(i, processor.id_to_piece(i)) for i in range(processor.get_piece_size())]
    words = [(i, p[1:]) for i, p in names if p[:1] == "▁" and len(p) > 1 and "▁" not in p[1:]]
    encoded = processor.encode([w for _, w in words], num_threads=1)
    return frozenset(w for (i, w), ids in zip(words, encoded) if ids == [i])


class PieceCounter:
    """Token counts of a sentencepiece BPE model.

    No string of the vocabulary has its space mark after another character, so no merge crosses the start of a run of
    spaces, and a text's count is the sum over its words, each with the spaces before it. A word that `whole_tokens`
    has proved counts one without any merging; the library merges the rest.
    """

    def __init__(self, path: str, keep: int = 600_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("this vocabulary has strings that join words")
        self.alone = dict.fromkeys(whole_tokens(self.library), 1)
        self.keep, self.known = keep, dict(self.alone)

    def _words(self, text: str) -> list[str]:
        """Words without the one space mark that the library itself puts in front of them."""
        if "  " not in text and "▁" not in text and text[-1] != " ":
            words = text.split(" ")
            if not words[0]:
                words[:2] = [" " + words[1]]
            return words
        words = _SPACE_RUNS.findall(text.replace("▁", " "))
        return [words[0], *(w[1:] for w in words[1:])]

    def count(self, texts: list[str]) -> list[int]:
        split = [self._words(t) if t else [] for t in texts]
        wanted: set[str] = set()
        for words in split:
            wanted.update(words)
        new = [w for w in wanted if w not in self.known]
        if new:
            if len(self.known) + len(new) > self.keep:
                self.known = dict(self.alone)
                new = [w for w in wanted if w not in self.known]
            for w, ids in zip(new, self.library.encode(new, num_threads=1)):
                self.known[w] = len(ids) or 1  # a lone space mark is a token of its own
        get = self.known.__getitem__
        return [sum(map(get, words)) for words in split]


_MEMO: dict[tuple, object] = {}


def of_worker(kind, path: str):
    """One encoder for each Python worker: the memo serves all tasks that the worker runs."""
    if (kind, path) not in _MEMO:
        _MEMO[kind, path] = kind(path)
    return _MEMO[kind, path]


def in_groups(texts: list[str], chars: int = 1 << 20):
    """Consecutive groups of about so many characters, so that memory follows the group and not the batch."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group

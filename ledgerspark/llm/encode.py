"""Exact, cached encoding of whole texts with a ``tokenizers`` vocabulary.

Both byte-level and word-end BPE split texts before merging, and never across a
space that follows a non-space character. So a text is cut there into chunks,
each distinct chunk is encoded once per worker, and a text's ids are the joined
ids of its chunks. Ids are little-endian unsigned 32-bit integers throughout, so
joining, CRCs and Arrow buffers need no per-id work in Python.
"""

from __future__ import annotations

import os
import re
from array import array

from ledgerspark.llm.common import worker_cache

#: Bytes of chunks and of letter runs with their ids that a worker keeps, in each of two generations.
CHUNK_BYTES, RUN_BYTES = 36 << 20, 24 << 20
#: What an entry takes besides its characters and ids: two objects' headers and its place in the table.
ENTRY_BYTES = 180
#: White space, as a class of RE2 patterns.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Where a space is not simply between two words.
BESIDE_SPACE = f"^ |{WHITE} "
#: Where a comma or full stop may not be cut off, or a line end not after it.
MARK_AFTER_MARK = rf"(?:[^\pL\pN]|^)[.,]{WHITE}|\.\n{WHITE}"
#: Characters of text looked at together.
BATCH_CHARS = 2_000_000


class Encoder:
    """``encode(texts)`` gives each text's ids as an array of uint32.

    Equal to ``Tokenizer.encode(text, add_special_tokens=False)`` of the whole
    text. Texts that hold the string of an added token, in any case, are encoded
    as a whole. None and '' have no ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.special = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search
        #: What every added token's string begins with; few texts have it at all.
        self.mark = os.path.commonprefix(added)[:2] if added else "\0no added tokens"
        self.lowers = self.tok.normalizer is not None
        #: Byte-level pieces keep the space before a word, word-end pieces drop it.
        self.space = "" if self.lowers else " "
        self.chunks: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.chunk_bytes = self.run_bytes = 0
        self.before_word = re.compile(r"(?=(?<!\s) (?!\s))").split
        #: Letters below U+0100 are stable under NFC (and lower case here, where
        #: the vocabulary has no other); marks without apostrophes and line ends
        #: beside them are pieces of their own.
        letters = "[a-zß-öø-ÿ]+" if self.lowers else "[A-Za-zÀ-ÖØ-öø-ÿ]+"
        marks = r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"""
        self.word = re.compile(f"({self.space and ' ?'}{letters})({marks})?(?:(\n)({letters})({marks})?)?").fullmatch
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        # The public byte-to-character rule of byte-level BPE.
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _run(self, letters: str) -> bytes:
        """Ids of a letter run with the space before it, if any: one piece of the splitting pattern."""
        ids = self.old_runs.get(letters)
        if ids is None:
            if letters.isascii():
                piece = self.byte_chars[32] + letters[1:] if letters[0] == " " else letters
            else:
                piece = letters.encode().decode("latin-1").translate(self.byte_chars)
            ids = array("I", [t.id for t in self.tok.model.tokenize(piece)]).tobytes()
        self.runs[letters] = ids
        self.run_bytes += len(letters) + len(ids) + ENTRY_BYTES
        return ids

    def _tail(self, marks: str) -> bytes:
        """Ids of marks."""
        ids = self.tails.get(marks)
        if ids is None:
            ids = self._whole([marks])[0]
            if len(self.tails) < 10_000:
                self.tails[marks] = ids
        return ids

    def _known(self, names: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        if self.chunk_bytes > CHUNK_BYTES:
            self.old_chunks, self.chunks, self.chunk_bytes = self.chunks, {}, 0
        if self.run_bytes > RUN_BYTES:
            self.old_runs, self.runs, self.run_bytes = self.runs, {}, 0
        chunks, old = self.chunks, self.old_chunks
        word, run, tail, known = self.word, self._run, self._tail, self.runs.get
        out, odd, held, before = list(map(chunks.get, names)), [], 0, len(chunks)
        for i, ids in enumerate(out):
            if ids is not None:
                continue
            name = names[i]
            ids = old.get(name)
            if ids is None:
                m = word(name)
                if m is None:
                    odd.append(i)
                    continue
                a, b, line, c, d = m.groups()
                ids = known(a) or run(a)
                if b:
                    ids += tail(b)
                if line:
                    ids += tail(line) + (known(c) or run(c))
                    if d:
                        ids += tail(d)
            out[i] = chunks[name] = ids
            held += len(name) + len(ids)
        for i, ids in zip(odd, self._whole([names[i] for i in odd]), strict=True):
            out[i] = chunks[names[i]] = ids
            held += len(names[i]) + len(ids)
        self.chunk_bytes += held + ENTRY_BYTES * (len(chunks) - before)
        return out

    def _pieced(self, pieces) -> list:
        """Ids of texts given as a list array of their chunks."""
        import numpy as np

        offsets = pieces.offsets.to_numpy()
        coded = pieces.values.dictionary_encode()
        table = self._known(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat, begin = np.frombuffer(b"".join(table), "<u4"), np.cumsum(size) - size
        n = size[index]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin[index] - (ends - n), n) + np.arange(int(ends[-1]))]
        return np.split(ids, ends[offsets[1:-1] - 1])

    def encode(self, texts: list[str | None]) -> list:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out = [np.zeros(0, "<u4")] * len(texts)
        some = [i for i, text in enumerate(texts) if text]
        array_ = pa.array([texts[i] for i in some], pa.large_string())
        beside = pc.match_substring_regex(array_, BESIDE_SPACE).to_pylist() if self.space else [False] * len(some)
        tied = pc.match_substring_regex(array_, MARK_AFTER_MARK).to_pylist()
        plain, marked, cut = [], [], []
        for i, odd, kept in zip(some, beside, tied, strict=True):
            text = texts[i]
            if self.mark in text and self.special(text):
                out[i] = np.frombuffer(self._whole([text])[0], "<u4")
            elif odd or (self.space and "\0" in text):
                cut.append(i)
            else:
                plain.append(i)
                marked.append(self._marked(text, not kept))
        if plain:
            for i, ids in zip(plain, self._pieced(pc.split_pattern(pa.array(marked, pa.large_string()), "\0" if self.space else " ")), strict=True):
                out[i] = ids
        if cut:
            for i, ids in zip(cut, self._pieced(pa.array([self.before_word(texts[i]) for i in cut], pa.list_(pa.large_string()))), strict=True):
                out[i] = ids
        return out

    def _marked(self, text: str, alone: bool) -> str:
        """The text with its cuts marked: by NUL, or by spaces for word-end pieces.

        A comma or full stop that ends a word is a piece of its own, unless something
        else than a letter or digit stands before it (then ``alone`` is false). For word-end pieces case, and which white space
        parts words, make no difference."""
        if self.space:
            text = text.replace(" ", "\0 ")
            if alone:
                text = text.replace(",\0 ", "\0,\0 ").replace(".\0 ", "\0.\0 ").replace(".\n", "\0.\0\n\0")
            return text
        if alone:
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower().replace("\n", " ")


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, kept between its tasks."""
    cache = worker_cache()
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


def portions(texts: list[str | None], chars: int = BATCH_CHARS):
    """(from, to) of runs of texts of about so many characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)

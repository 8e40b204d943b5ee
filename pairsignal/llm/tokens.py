"""Encoding whole texts with the tokenizers library, a batch at a time, inside Arrow tasks.

The byte-level vocabulary splits a text into pieces before it merges bytes, and no merge crosses a piece. A piece is
therefore encoded once per worker and remembered: repeated words cost a look-up. A text with characters for which two
regular expression libraries might differ on the split goes to the tokenizer whole; the ids are the same either way.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 500_000  # pieces a worker keeps, some 100 MB: the first ones, which are the frequent ones
GROUP_BYTES = 16 << 20  # texts that are split together; places in their ids fit into 32 bits
PART_BYTES = 1 << 20  # of a batch's texts that are turned into strings and encoded together
TOGETHER = 64  # unknown pieces that are merged in one call
PIECE_CHARS = 1 << 20  # a longer text is split between two words, so that its pieces need little memory
SAFE = r"[\n\t\r\x20-\x7e¡-¬®-ɏ]*"  # characters whose classes are written out below
OTHER = r"[^\n\t\r\x20-\x7e¡-¬®-ɏ]|[ \n\t\r]{2}"
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r" \n\t\r"
# Fixed value: the vocabulary's published splitting rule, for these characters; once more without its rule for several
# spaces in a row, in the syntax of Arrow's expressions.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
SINGLE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, others from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTES = _byte_characters()


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as the library encodes them with add_special_tokens=False.

    The library gives the name of a special token inside a text that token's id; such texts go to it whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.named = re.compile(names or r"(?!)").search
        self.other = f"{OTHER}|{names}" if names else OTHER
        self.split = re.compile(SPLIT).findall
        self.safe = re.compile(SAFE).fullmatch
        self.between = re.compile(f"(?<=[{LETTER}])(?= [{LETTER}])").search
        with_zero = [(t, i) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if BYTES[0] in t]
        self.between_id = with_zero[0][1] if [t for t, _ in with_zero] == [BYTES[0]] else None
        self.known: dict[str, bytes] = {}

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; the unknown ones are encoded in one call."""
        found = list(map(self.known.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = [pieces[i] for i in missing]
            ids, ends = self._merged(new)
            for i, a, b in zip(missing, [0, *ends[:-1]], ends):
                found[i] = ids[a:b]
            room = REMEMBERED - len(self.known)
            self.known.update((p, found[i]) for p, i in zip(new[:room], missing) if room > 0)
        return found

    def _merged(self, new: list[str]) -> tuple[bytes, list[int]]:
        """The ids of pieces by the merges alone, for they are split already, and where those of each piece end.

        Where no merge holds the zero byte, which no piece has, pieces are put together with it between them.
        """
        one = self.tokenizer.model.tokenize
        if self.between_id is None:
            listed = [[t.id for t in one(p.encode().decode("latin-1").translate(BYTES))] for p in new]
            ids = np.fromiter(chain.from_iterable(listed), "<u4")
            ends = np.cumsum(np.fromiter(map(len, listed), np.int64, len(listed)))
        else:
            joined = ("\0".join([*new[i:i + TOGETHER], ""]) for i in range(0, len(new), TOGETHER))
            found = (one(p.encode().decode("latin-1").translate(BYTES)) for p in joined)
            ids = np.fromiter((t.id for t in chain.from_iterable(found)), "<u4")
            cuts = np.flatnonzero(ids == self.between_id)
            ids, ends = np.delete(ids, cuts), cuts - np.arange(len(cuts))
        return ids.tobytes(), (4 * ends).tolist()

    def _pieces(self, text: str) -> Iterator[list[str]]:
        at = 0
        while len(text) - at > PIECE_CHARS:
            cut = self.between(text, at + PIECE_CHARS)
            if cut is None:
                break
            yield self.split(text[at:cut.start()])
            at = cut.start()
        yield self.split(text[at:] if at else text)

    def _single(self, texts: list[str]) -> list[bytes]:
        """Texts without several spaces in a row: split by Arrow, so that only different pieces become Python strings."""
        marked = pc.replace_substring_regex(pa.array(texts, pa.large_string()), SINGLE, "\\0\0")
        split = pc.split_pattern(marked, "\0")
        coded = split.flatten().dictionary_encode()
        own = self._ids([p for p in coded.dictionary.to_numpy(zero_copy_only=False).tolist() if p])
        blank = pc.index(coded.dictionary, "").as_py()  # behind the last piece of a text
        if blank >= 0:
            own.insert(blank, b"")
        length = np.fromiter(map(len, own), np.int32, len(own)) >> 2
        first = np.cumsum(length, dtype=np.int32) - length
        pool, which = np.frombuffer(b"".join(own), "<u4"), coded.indices.to_numpy()
        count = length[which]
        until = np.cumsum(count, dtype=np.int32)
        at = np.repeat(first[which] - until + count, count)
        at += np.arange(len(at), dtype=np.int32)
        ids = pool[at].tobytes()
        ends = 4 * np.concatenate(([0], until)).astype(np.int64)[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _one(self, text: str) -> bytes:
        if not self.safe(text) or self.named(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for pieces in self._pieces(text):
            different = list(dict.fromkeys(pieces))
            ids = dict(zip(different, self._ids(different)))
            out.append(b"".join(map(ids.__getitem__, pieces)))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        group: list[int] = []
        size = 0
        # A character outside SAFE, several spaces in a row, or the name of a special token
        other = pc.match_substring_regex(pa.array(texts, pa.large_string()), self.other).to_pylist()
        for i, text in enumerate(texts):
            if len(text) > PIECE_CHARS or other[i]:
                out[i] = self._one(text)
                continue
            group.append(i)
            size += len(text)
            if size > GROUP_BYTES:
                for j, ids in zip(group, self._single([texts[j] for j in group])):
                    out[j] = ids
                group, size = [], 0
        for j, ids in zip(group, self._single([texts[j] for j in group]) if group else ()):
            out[j] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def parts(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have about `most` bytes: what a task makes of them stays small."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        run = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def encoded(path: str, batches: Iterator[pa.RecordBatch], end: int | None, most: int = PART_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each part of the batches with the ids of its column `text` (null: empty), followed by the end id if there is one."""
    tail = b"" if end is None else np.array([end], "<u4").tobytes()
    encode = encoder(path).encode
    for batch in parts(batches, most=most):
        texts = batch.column(batch.schema.names.index("text")).to_pylist()
        yield batch, [ids + tail for ids in encode([t or "" for t in texts])]

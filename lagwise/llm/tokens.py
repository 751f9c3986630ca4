"""Token ids of whole texts with a public tokenizer file, each distinct word encoded once per worker."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lagwise.llm.common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 2
#: Words held by a worker (some 100 MB) of either kind, and the longest word that is held.
HELD_WORDS = 800_000
WORD_CHARS = 48
#: Characters of new words encoded in one call.
CALL_CHARS = 100_000
#: Letters that have one lower-case form everywhere, and marks that form one token run after letters.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:*%#$&|]*)")


def _byte_signs() -> dict[int, str]:
    """For each Latin letter beyond ASCII the signs that stand for its UTF-8 bytes in a byte-level vocabulary: a printable
    byte is its own sign, the others are numbered from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    sign = {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(others)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(192, 256)}


_BYTE_SIGNS = _byte_signs()


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids as little-endian bytes, two per id where the vocabulary allows, else four.

    Only for tokenizers that treat any run of white space as a word border and drop it: the ids of a text are then
    those of its words in turn.  Many new words are encoded in one call, with a border word between them that has
    one id of its own; a word with the border's character is encoded by itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        kind = "H" if self.dtype.itemsize == 2 else "I"
        self.pack = lru_cache(maxsize=4096)(lambda n: struct.Struct(f"<{n}{kind}").pack)
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}
        probes = [(c, self._plain(f"a {c} a")) for c in "¶§†‡•"]
        a = self._plain("a")
        self.border, self.border_id = next((c, ids[1]) for c, ids in probes if len(ids) == 3 and ids[:1] == ids[2:] == a)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: Sequence[int]) -> bytes:
        return self.pack(len(ids))(*ids)

    def _encode_parts(self, parts: list[str]) -> None:
        ids = np.array(self._plain(f" {self.border} ".join(parts)), dtype=self.dtype)
        cuts = np.flatnonzero(ids == self.border_id)
        if len(cuts) != len(parts) - 1:
            raise AssertionError("a word holds the border")
        lo = np.concatenate(([0], cuts + 1)) * ids.itemsize
        hi = np.append(cuts, len(ids)) * ids.itemsize
        raw = ids.tobytes()
        for part, a, b in zip(parts, lo.tolist(), hi.tolist()):
            self.parts[part] = raw[a:b]

    def _learn(self, unknown: set[str]) -> list[str]:
        """Encode new words: letters and the marks after them apart, as the tokenizer does; returns words not to hold."""
        if len(self.parts) > HELD_WORDS:
            self.parts = {"": b""}
        cut, long, letters, match = [], [], set(), _PLAIN.fullmatch
        for word in unknown:
            if len(word) <= WORD_CHARS and (m := match(word)):
                part, marks = m.groups()
                part = part.lower()
                cut.append((word, part, marks))
                letters.add(part)
            elif len(word) > WORD_CHARS or self.border in word or not word.isprintable():
                self.words[word] = self._bytes(self._plain(word))
                long.append(word)
            else:
                cut.append((word, word, ""))
        tokenize = self.model.tokenize
        for part in letters - self.parts.keys():  # one token run that needs no splitting: straight to the model
            self.parts[part] = self._bytes([t.id for t in tokenize(part if part.isascii() else part.translate(_BYTE_SIGNS))])
        pending, chars = [], 0
        for part in {p for _, p, _ in cut}.union(p for _, _, p in cut) - self.parts.keys():
            pending.append(part)
            chars += len(part)
            if chars > CALL_CHARS:
                self._encode_parts(pending)
                pending, chars = [], 0
        if pending:
            self._encode_parts(pending)
        parts = self.parts
        self.words.update((word, parts[a] + parts[b]) for word, a, b in cut)
        return long

    def encode(self, texts: Sequence[str], end_id: int | None = END_ID) -> list[bytes]:
        """Ids of every text, each followed by ``end_id``."""
        end = b"" if end_id is None else self._bytes([end_id])
        split = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], type=pa.large_string()), " ")
        places = split.flatten().dictionary_encode()
        distinct = places.dictionary.to_numpy(zero_copy_only=False).tolist()
        unknown = set(distinct).difference(self.words)
        if len(self.words) + len(unknown) > HELD_WORDS:
            self.words = {"": b""}
            unknown = set(distinct)
        long = self._learn(unknown) if unknown else ()
        raw = pa.array(map(self.words.__getitem__, distinct), type=pa.large_binary(), size=len(distinct)).take(places.indices)
        for word in long:
            del self.words[word]
        starts = np.frombuffer(raw.buffers()[1], dtype=np.int64, count=len(raw) + 1)
        edges = starts[split.offsets.to_numpy()].tolist()
        ids = memoryview(raw.buffers()[2] or b"")
        return [bytes(ids[lo:hi]) + end for lo, hi in zip(edges, edges[1:])]


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, kept between its tasks."""
    return held(WordEncoder, path)


def slices(rows: Sequence[str], chars: int = 4_000_000) -> list[tuple[int, int]]:
    """Ranges of rows of about so many characters, so that few texts are split into words at a time."""
    cuts, held = [0], 0
    for i, text in enumerate(rows):
        if held and held + len(text) > chars:
            cuts.append(i)
            held = 0
        held += len(text)
    return list(zip(cuts, [*cuts[1:], len(rows)])) if rows else []

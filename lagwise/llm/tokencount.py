"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton gives, for every end in a word, the vocabulary pieces that end there, longest first; dynamic
programming carries the best score of the word so far and how many tokens it has.  Rules of the tokenizer that the
counts keep: a word starts at a space, which becomes its first sign; of equally good segmentations the one with the
longest last piece wins at every place; a character that is no piece of its own costs ten less than the lowest score;
a run of such characters is one piece, which counts its UTF-8 bytes where the vocabulary has byte pieces.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm.common import map_arrow, read, strings
from lagwise.llm.registry import query
from lagwise.llm.tokens import slices

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker holds, and the longest of them.
HELD_WORDS = 1_000_000
WORD_CHARS = 64


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """((piece, score) in id order, id of the unknown piece) of a sentencepiece file; control pieces cannot occur in a
    text and have the empty string here."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [("" if model.is_control(i) else model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    return pieces, model.unk_id()


class TokenCounter:
    """Counts by word; ``pieces`` are (piece, score), the piece at ``unknown`` stands for what no piece covers."""

    def __init__(self, pieces: Sequence[tuple[str, float]], unknown: int) -> None:
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if p}
        self.unknown = unknown
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), pieces[i][1], i == unknown))
        self.automaton.make_automaton()
        self.single = {p for p in self.ids if len(p) == 1}
        self.unknown_score = min(score for piece, score in pieces if piece) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in self.ids for b in range(256))
        self.words: dict[str, int] = {}

    def _run(self, run: str) -> int:
        """Tokens of a run of unknown characters."""
        if run in self.ids or not self.bytes:
            return 1
        return len(run.encode("utf-8", "surrogatepass"))

    def count_word(self, word: str) -> int:
        """Tokens of the best segmentation."""
        size = len(word)
        ending: list[list] = [[] for _ in range(size)]
        for end, match in self.automaton.iter(word):
            ending[end].append(match)
        score, count, run = [0.0] * (size + 1), [0] * (size + 1), [-1] * (size + 1)  # run: start of the unknown run that ends here
        settled = [0] * (size + 1)  # tokens before that run
        for end in range(1, size + 1):
            best, start, strange = None, 0, False
            for length, value, is_unknown in ending[end - 1]:
                reached = value + score[end - length]
                if best is None or reached > best:
                    best, start, strange = reached, end - length, is_unknown
            if word[end - 1] not in self.single:
                reached = self.unknown_score + score[end - 1]
                if best is None or reached > best:
                    best, start, strange = reached, end - 1, True
            score[end] = best
            if strange:
                run[end] = run[start] if run[start] >= 0 else start
                settled[end] = settled[start] if run[start] >= 0 else count[start]
                count[end] = settled[end] + self._run(word[run[end]:end])
            else:
                count[end] = count[start] + 1
        return count[size]

    def count(self, text: str) -> int:
        """Tokens of a text; the first word gets a space before it unless there is one."""
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0] and len(words) > 1:
            del words[0]
        held, total = self.words, 0
        try:
            return sum(map(held.__getitem__, words))
        except KeyError:
            pass
        if len(held) > HELD_WORDS:
            held.clear()
        for word in words:
            n = held.get(word)
            if n is None:
                n = self.count_word(SPACE + word)
                if len(word) <= WORD_CHARS:
                    held[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One per worker process."""
    return TokenCounter(*vocabulary(path))


_COUNTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def _count(stream: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    words = counter(path)
    for batch in stream:
        texts = strings(batch.column(1))
        for a, b in slices(texts):
            part = texts[a:b]
            yield pa.record_batch([
                batch.column(0).slice(a, b - a), pa.array([words.count(t) for t in part], type=pa.int64()),
                pa.array([len(t.encode("utf-8", "surrogatepass")) for t in part], type=pa.int64())], schema=_COUNTS_ARROW)


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_bytes; a null or empty text has 0 of both.

    ``model`` is a sentencepiece file, whose pieces and scores are read as a unigram vocabulary.
    """
    path = model or piece_model()
    return map_arrow(
        docs, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")], lambda it: _count(it, path), "doc_id long, n_tokens long, n_bytes long")


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))

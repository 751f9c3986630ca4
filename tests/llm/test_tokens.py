"""Token ids: packing, token files, counts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from lagwise.llm import langid, packing, tokencount, tokenfile
from lagwise.llm.common import held, shared_path
from lagwise.llm.tokens import WordEncoder, word_tokenizer


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(word_tokenizer())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def test_word_encoder_equals_the_tokenizer(plain):
    rng, words = random.Random(3), WordEncoder(word_tokenizer())
    signs = [*"aB1'́ \t\x0b\x1c\x1d\x85　 \n¶•§é中.,!sẞİΣς😀̀\r\x00", "<|endoftext|>", "'s", "a ", "Straße,", "THE!!", "don't"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["", "q" * 500]
    for text, raw in zip(texts, words.encode(texts)):
        assert np.frombuffer(raw, dtype=words.dtype).tolist() == plain(text).tolist(), repr(text)


def test_a_word_is_looked_up_once_a_call(plain):
    class Counted(dict):
        looked = 0

        def __getitem__(self, word):
            self.looked += 1
            return super().__getitem__(word)

    words = WordEncoder(word_tokenizer())
    words.words = Counted(words.words)
    texts = ["one two\ntwo  one " * 50, "", "two three"]
    assert [np.frombuffer(raw, dtype=words.dtype).tolist() for raw in words.encode(texts)] == [plain(t).tolist() for t in texts]
    assert words.words.looked == 4  # three words and the empty one


def test_a_worker_holds_one_object():
    encoder = held(WordEncoder, word_tokenizer())
    assert held(WordEncoder, word_tokenizer()) is encoder
    bundler = langid.bundler()
    assert langid.bundler() is bundler and held(WordEncoder, word_tokenizer()) is not encoder and langid.bundler() is not bundler


def test_learning_bundles_bounded_slices(monkeypatch):
    sizes, whole = [], langid.Bundler.bundle
    monkeypatch.setattr(langid.Bundler, "bundle", lambda self, keys, *rest: (sizes.append(len(keys)), whole(self, keys, *rest))[1])
    texts = ["some plain words " * 1000] * 60
    batch = pa.record_batch([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    (out,) = langid._bundle_languages(iter([batch]))
    assert out.num_rows == 1 and len(sizes) > 1 and max(sizes) <= langid.SLICE_CHARS


def test_hilbert_key_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        key = packing.hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("length", [4096, 64])
def test_pack(odd, documents, plain, length):
    for df in (odd, documents, odd.limit(0)):
        want = sorted(plain(r.text).tobytes() for r in df.collect())
        pieces = packing.pack(df, length=length)
        rows = pieces.collect()
        by_row, used = {}, {}
        for r in rows:
            by_row.setdefault(r.row, []).append(r)
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
            ids = np.frombuffer(r.ids, dtype="<u2").astype("<u4")
            assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        got = []
        for parts in by_row.values():
            parts.sort(key=lambda r: r.start)
            assert [p.start for p in parts] == np.cumsum([0, *[p.length for p in parts]])[:-1].tolist()
            assert {p.doc_tokens for p in parts} == {sum(p.length for p in parts)}
            got.append(b"".join(np.frombuffer(p.ids, dtype="<u2").astype("<u4").tobytes() for p in parts))
        assert sorted(got) == want
        sizes = []
        for parts in used.values():
            parts.sort()
            assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
            sizes.append(sum(n for _, n in parts))
        assert all(s == length or s & (s - 1) == 0 for s in sizes) and sorted(used) == list(range(len(used)))
        assert sorted(len(s.ids) // 2 for s in packing.sequences(pieces).collect()) == sorted(sizes)


def test_token_files_round_trip(spark, odd, documents, plain):
    for df in (odd, documents, odd.limit(0)):
        manifest = tokenfile.write_token_files(df, shared_path(spark, "tokens"), length=64)
        rows = sorted(tokenfile.read_token_files(manifest).collect(), key=lambda r: r.start)
        docs = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()))
        at = 0
        for r, (known, doc_id, text) in zip(rows, docs, strict=True):
            ids = plain(text)
            assert (r.doc_id, r.start, r.n_tokens) == (doc_id if known else None, at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids.tobytes()) and np.frombuffer(r.ids, dtype="<u2").tolist() == ids.tolist()
            at += len(ids)
        for f in manifest.collect():
            stream, masks = zip(*(tokenfile.sequence(f.folder, f.file, i) for i in range(f.sequences)))
            assert {len(s) for s in stream} == {64} and int(np.concatenate(masks).sum()) == f.tokens
            assert masks[-1][:f.tokens - 64 * (f.sequences - 1)].all()


def unigram(pieces, unknown, byte_fallback):
    t = Tokenizer(models.Unigram(list(pieces), unknown, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_tokenizer():
    pieces, unknown = tokencount.vocabulary(tokencount.piece_model())
    pieces = [(p or f"{i}", s) for i, (p, s) in enumerate(pieces)]
    counter, plain, rng = tokencount.TokenCounter(pieces, unknown), unigram(pieces, unknown, True), random.Random(1)
    signs = ["a", "b", "the", " ", "▁", "\n", "é", "中", "😀", "x1", "<unk>", "<0x0A>", "  ", "ﬁ", "\t", "--", "ing"]
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        assert counter.count(text) == plain(text), repr(text)


def test_counts_keep_the_tie_rule():
    """Small integer scores make ties frequent."""
    rng = random.Random(4)
    for _ in range(60):
        words = {"".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 3)) for _ in range(12)}
        pieces = [("<unk>", 0.0), *words.items()]
        counter, plain = tokencount.TokenCounter(pieces, 0), unigram(pieces, 0, False)
        for _ in range(40):
            text = "".join(rng.choice("aabbc d") for _ in range(rng.randint(0, 16)))
            assert counter.count(text) == plain(text), (pieces, text)


def test_count_tokens(odd):
    counter = tokencount.TokenCounter(*tokencount.vocabulary(tokencount.piece_model()))
    want = sorted(((r.doc_id, counter.count(r.text or ""), len((r.text or "").encode())) for r in odd.collect()), key=repr)
    assert sorted((tuple(r) for r in tokencount.count_tokens(odd).collect()), key=repr) == want
    assert tokencount.count_tokens(odd.limit(0)).count() == 0

"""Token stream files and sentence pieces: round trips against the libraries."""

import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from penstrata.llm import sentencepieces as sp  # noqa: E402
from penstrata.llm import token_stream as ts  # noqa: E402

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.text(alphabet=st.sampled_from("ab'sé1 .\n\t,<|>漢 　%"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words_encode_like_whole_texts(text):
    e = ts.encoder(BPE)
    assert list(np.frombuffer(e.encode(text), e.dtype)) == e.whole.encode(text, add_special_tokens=False).ids


def test_special_strings_go_to_the_library_whole():
    e = ts.encoder(BPE)
    for t in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z"):
        assert list(np.frombuffer(e.encode(t), e.dtype)) == e.whole.encode(t, add_special_tokens=False).ids


def test_stream_files_give_back_every_document(spark, docs, rows):
    whole = ts.encoder(BPE).whole
    shards = ts.write_stream_files(docs, BPE, seq_len=64, batch_rows=4)
    got = ts.read_digests(spark, shards).orderBy("start").collect()
    want, start = [], 0
    for i, t in sorted(((i, t) for i, t, _, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    # random access: equal-length sequences with masks, in place
    s = shards[0]
    reader = ts.StreamReader(ts.opened(f"{s['base']}.ids.arrows"))
    ids, masks = zip(*(reader.sequence(i) for i in range(reader.n_batches * reader.batch_rows)), strict=True)
    assert {len(x) for x in ids} == {64} and sum(sum(m.to_pylist()) for m in masks) == s["n_tokens"]
    last = reader.sequence(reader.n_batches * reader.batch_rows - 1)
    again = reader.sequence(reader.n_batches * reader.batch_rows - 1)
    assert (last[0] == again[0]).all()
    with pytest.raises(IndexError):
        reader.batch(reader.n_batches)


def test_empty_table_has_no_shards(spark, empty):
    assert ts.write_stream_files(empty, BPE) == []
    assert ts.read_digests(spark, []).count() == 0


def sequential(v, s):
    """Viterbi over all pieces, ties to the longer last piece."""
    best, back = [0] + [None] * len(s), [None] * (len(s) + 1)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - v.most), e):
            p = s[b:e]
            score = v.piece[p][1] if p in v.piece else v.unknown if e == b + 1 else None
            if score is not None and (best[e] is None or best[b] + score > best[e]):
                best[e], back[e] = best[b] + score, b
    out, e = [], len(s)
    while e:
        out.append(s[back[e] : e])
        e = back[e]
    return [i for p in reversed(out) for i in v.ids(p)]


PIECE_TEXTS = st.text(alphabet=st.sampled_from("the ing\n  ü漢.st"), max_size=90)


@settings(max_examples=150, deadline=None)
@given(PIECE_TEXTS)
def test_pieces_by_words_chunks_and_whole_agree(text):
    v = sp.pieces(PIECES)
    ids = v.encode(text)
    assert v.decode(ids) == text
    if not text:
        return
    s = sp.symbols(text)
    want = sequential(v, s)
    assert list(array("i", ids)) == want
    cs = sp.cut(s, 20, v.most - 1)
    done = sp.scan(np.stack([v.transfer(c, n) for _, n, c in cs]))
    starts = [np.array([0] + [sp.NONE] * (v.most - 1)), *done[:-1, 0]]
    state, got = 0, []
    for (_, n, c), a in list(zip(cs, starts, strict=True))[::-1]:
        _, back = v.forward(c, n, [(i, int(x)) for i, x in enumerate(a) if x != sp.NONE])
        ids, state = v.traced(c, back, n + state)
        got = ids + got
    assert state == 0 and got == want


def test_batches_of_words_like_single_ones():
    import random

    rng = random.Random(6)
    words = list({"▁" + "".join(rng.choice(["th", "e", "ing", "ü", "漢", "st", "a", "é", "q"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)})
    v = sp.Pieces(PIECES)
    v.learn(words)
    batch = dict(v.known)
    v.known.clear()
    assert all(batch[w] == v.word(w) for w in words) and list(array("i", batch[words[0]])) == sequential(v, words[0])


def test_scores_equal_the_librarys_best_path():
    """The same pieces and scores in the library, whose model type is turned to a unigram lattice in the file's header."""
    import sentencepiece

    data = open(PIECES, "rb").read()

    def varint(i):
        n = shift = 0
        while True:
            n, shift, i = n | (data[i] & 127) << shift, shift + 7, i + 1
            if data[i - 1] < 128:
                return n, i

    at = 0
    while at < len(data):
        key, i = varint(at)
        size, i = varint(i)
        if key >> 3 == 2:  # the trainer's part; its field 3 is the type
            j = i
            while j < i + size:
                k, j = varint(j)
                if k & 7 == 2:
                    n, j = varint(j)
                    j += n
                elif k & 7 == 5:
                    j += 4
                else:
                    if k >> 3 == 3:
                        data = data[:j] + b"\1" + data[j + 1 :]
                    _, j = varint(j)
        at = i + size
    lib = sentencepiece.SentencePieceProcessor()
    lib.load_from_serialized_proto(data)
    v = sp.pieces(PIECES)
    for w in ["the", "hested", "transformation", "über", "naïve", "a,b", "2024", "schlichung", "ciónmente"]:
        want = max(sum(lib.get_score(i) for i in ids) for ids in lib.nbest_encode_as_ids(w, 4))
        assert sum(lib.get_score(i) for i in array("i", v.encode(w))) == want


def test_products_are_associative():
    rng = np.random.default_rng(3)
    a, b, c = (np.where(rng.random((4, 4)) < 0.3, sp.NONE, rng.integers(-50, 0, (4, 4))) for _ in range(3))
    assert (sp.times(sp.times(a, b), c) == sp.times(a, sp.times(b, c))).all()


def test_giants_in_chunks_equal_whole_documents(docs, empty):
    whole = sorted(map(tuple, sp.encoded(docs, PIECES).collect()), key=str)
    cut = sorted(map(tuple, sp.encoded(docs, PIECES, giant=300, chunk=100).collect()), key=str)
    assert whole == cut and all(r[3] for r in whole) and len(whole) == docs.count()
    assert Counter(r[0] for r in whole)[3] == 2
    assert sp.encoded(empty, PIECES).count() == 0

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from llm_tables import docs, edge_rows, frame, words
from qtrail.llm import sentencepiece_codec as C
from qtrail.llm import token_counts as T
from qtrail.llm.unigram import BLANK, vocabulary

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The file as a unigram model of the library, and its path.  Its blank pieces
    score -1e9, which single precision cannot add to other scores; here they cost
    32000, so that the library's sums are exact."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        if piece.type == 1 and piece.score <= -1e9:
            piece.score = -32000.0
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return sentencepiece.SentencePieceProcessor(model_file=str(path)), str(path)


TEXTS = ["", " ", "  two  blanks ", "a\n\nb\t c", "日本語 テスト 🙂🙂", "\x00\x01", "x" * 500, "Hello, world! It's 3.14.", f"{BLANK}x {BLANK}y"]


def test_same_ids_as_the_library(unigram):
    library, path = unigram
    rng = random.Random(1)
    texts = TEXTS + [words(rng, 20, "etaoinshrdlu ,.ßé") for _ in range(200)]
    encoder, counter = C.Encoder(path), T.Counter(path)
    for text in texts:
        ids = np.frombuffer(encoder.encode(text), "<i4").tolist()
        assert ids == library.encode(text)
        assert counter.count(text)[1] == len(ids)


def brute(text, pieces, unknown):
    """(score, ids or None for unknown characters) by dynamic programming over the whole text."""
    best = [(0.0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            found = pieces.get(text[start:end])
            if found is None and end - start == 1:
                found = unknown, None
            if found and (best[end] is None or best[start][0] + found[0] > best[end][0]):
                best[end] = best[start][0] + found[0], best[start][1] + [(text[start:end], found[1])]
    return best[-1]


def test_streaming_commits_the_whole_texts_best_path():
    book = vocabulary(PIECES)
    rng = random.Random(4)
    for text in TEXTS + [words(rng, 30) for _ in range(10)]:
        prepared = BLANK + text.replace(" ", BLANK) if text else ""
        path = brute(prepared, book.pieces, book.unknown_score)[1]
        expected = [i for part, pid in path for i in ([pid] if pid is not None else [book.byte_ids[b] for b in part.encode()])]
        for size in (1, 7, 1000):
            groups = list(C.StreamingViterbi(book).encode([prepared[k:k + size] for k in range(0, len(prepared), size)]))
            assert [i for g in groups for i in g] == expected
        assert book.decode(expected) == text.replace(BLANK, " ")
    long = BLANK + BLANK.join(["word"] * 50)
    groups = list(C.StreamingViterbi(book).encode([long[k:k + 9] for k in range(0, len(long), 9)]))
    assert len(groups) > 10  # committed on the way, not at the end


def test_frames(spark):
    table = docs(spark, TEXTS).union(frame(spark, edge_rows()))
    given = sorted(((r.doc_id, r.text) for r in table.select("doc_id", "text").collect()), key=str)
    decoded = C.decode(C.encode(table, PIECES), PIECES)
    assert sorted(((r.doc_id, r.text) for r in decoded.collect()), key=str) == sorted(
        ((i, (t or "").replace(BLANK, " ")) for i, t in given), key=str)
    digest = {(r.doc_id, r.n_ids) for r in C.digests(table, PIECES).collect() if r.round_trip}
    counts = {(r.doc_id, r.n_tokens) for r in T.token_counts(table, PIECES).collect()}
    assert digest == counts and len(given) == table.count()
    for empty in (T.token_counts(frame(spark, []), PIECES), C.digests(frame(spark, []), PIECES), C.encode(frame(spark, []), PIECES)):
        assert empty.collect() == []


def test_a_long_part_is_encoded_in_a_window(spark, monkeypatch):
    """A text of a million characters without a blank: the same ids, and no list of scores as long as the text."""
    from qtrail.llm import sentencepiece_codec as S
    encoder = S.Encoder(PIECES)
    reach, most = encoder.words.longest, []
    advance = S.StreamingViterbi._advance
    monkeypatch.setattr(S.StreamingViterbi, "_advance", lambda self, text, score, back: (advance(self, text, score, back), most.append(len(score)))[0])
    rng = random.Random(4)
    part = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    whole = [i for group in S.StreamingViterbi(encoder.words).encode([part]) for i in group]
    most.clear()
    assert np.frombuffer(encoder[part], "<i4").tolist() == whole
    assert max(most) <= 50 * reach


def test_new_parts_of_a_batch_are_encoded_together(monkeypatch):
    """The lattice gives the ids of the streaming pass, also in blocks of few cells, and takes every short part of a batch."""
    rng = random.Random(9)
    texts = [words(rng, 40, "etaoinshrdlu ,.:;!\n\x1c\x85\u0338ßé日本🙂X9" + BLANK) for _ in range(300)] + TEXTS + ["", " a", "a ", "a  b", "a\n\n,b"]
    book = vocabulary(PIECES)
    whole = C.StreamingViterbi(book)
    expected = []
    for text in texts:
        prepared = BLANK + text.replace(" ", BLANK) if text else ""
        expected.append([i for g in whole.encode([prepared]) for i in g])
    for cells in (1, 500, C.CELLS):
        monkeypatch.setattr(C, "CELLS", cells)
        encoder, alone = C.Encoder(PIECES), []
        monkeypatch.setattr(encoder.viterbi, "encode", lambda chunks, of=encoder.viterbi.encode: (alone.append(chunks := list(chunks)), of(chunks))[1])
        found = encoder.encode_all(texts)
        assert [np.frombuffer(i, "<i4").tolist() for i in found] == expected
        assert all(sum(map(len, chunks)) > C.SHORT for chunks in alone)  # no short part went through the loop of its own
        ids = [i for e in expected for i in e]
        assert book.decode_all(np.array(ids, "<i4"), [len(e) for e in expected]) == [book.decode(e) for e in expected]
    with pytest.raises(IndexError):
        book.decode_all(np.array([1 << 20], "<i4"), [1])
    assert book.decode_all(np.array([], "<i4"), [0, 0]) == ["", ""]

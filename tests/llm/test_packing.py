import zlib

import numpy as np
import pytest

from fleetlens.llm import packing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_model_path())


def whole_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, docs, library, window):
    """Every id in one piece, sequences gapless and within the window; returns the padded tokens."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert sorted(by_doc, key=repr) == sorted({d for d, _ in docs}, key=repr)
    for doc, text in docs:
        want = np.array(whole_ids(library, text), "<u4").tobytes()
        own = sorted(by_doc[doc], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == want
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        assert all(p.doc_tokens == len(want) // 4 and p.length == len(p.ids) // 4 for p in own)
    padding = 0
    for pieces in by_sequence.values():
        own = sorted(pieces, key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        size = sum(p.length for p in own)
        assert size <= window
        padding += 0 if size & (size - 1) == 0 else window - size
    return padding


def texts():
    rng = np.random.Generator(np.random.PCG64(6))
    odd = ["", None, " \n ", "It's I'LL don't.", "<|endoftext|> a <|ENDOFTEXT|>. b<|startoftext|>c.", "H̱ É. İİ ẖ", "a\x1cb\x85c　d,",
           "x.. y., z.,", "1,000.50 a1.", "ΑΣ ΣΑΣ.", "한국 각.", "é,", ".,", "word." * 300, "é," * 50, "'s 's. s's, S'S."]
    words = ["hein", "The", "ofand", "was,", "then.", "naïve", "x1", "—", "日本"]
    return odd + [" ".join(rng.choice(words, int(rng.integers(1, 400)))) for _ in range(150)] + [" ".join(rng.choice(words, 9000))]


def test_every_id_lies_in_one_piece(spark, library):
    docs = list(enumerate(texts()))
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, start int, ids string")
    for parts, window, opened in ((1, 2048, 32), (5, 256, 3), (7, 64, 1)):
        packed = packing.pack(table.repartition(parts), queries.word_model_path(), window=window, open_windows=opened)
        padding = check(packed.collect(), docs, library, window)
        total = sum(len(whole_ids(library, t)) for _, t in docs)
        assert padding <= total * packing.MIN_PIECE / window
    assert packing.pack(table.limit(0), queries.word_model_path()).collect() == []
    with pytest.raises(ValueError):
        packing.pack(table, queries.word_model_path(), window=100)


def test_pieces_of_long_texts_have_the_ids_of_the_whole(monkeypatch, library):
    monkeypatch.setattr(packing, "PIECE_BYTES", 40)
    encoder = packing.WordIds(queries.word_model_path())
    for text in texts():
        got = b"".join(encoder.ids([p])[0] for p in packing._pieces((text or "").encode()))
        assert got == np.array(whole_ids(library, text)[:-1], "<u4").tobytes()


def test_forgotten_words_are_learnt_again(monkeypatch, library):
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 6)
    encoder = packing.WordIds(queries.word_model_path())
    for _ in range(3):
        for text in texts()[:40]:
            assert encoder.ids([(text or "").encode()])[0] == np.array(whole_ids(library, text)[:-1], "<u4").tobytes()
    assert len(encoder.older) < 2000


def test_the_fullest_window_is_emitted_when_none_fits():
    packer = packing.Packer(16, 2, 3)
    sizes = lambda windows: [[len(p[2]) // 4 for p in w] for w in windows]
    done = []
    for doc, n in enumerate([10, 12, 14, 4, 40, 15]):
        done += packer.add(doc, bytes(4 * n))
    # 14 fits nowhere: the window of 12 is topped up with 4; 10 of 14 remain and open a window; 4 goes beside the first 10.
    assert sizes(done[:1]) == [[12, 4]]
    assert sum(map(sum, sizes(done) + sizes(packer.rest()))) == 10 + 12 + 14 + 4 + 40 + 15
    assert len(packer.rest()) <= 2 and all(sum(w) in range(14, 17) for w in sizes(done))


def test_the_rest_is_cut_into_powers_of_two():
    assert packing.tail_edges(2048 + 1300, 2048) == [2048, 3072, 3328, 3344, 3348]
    assert packing.tail_edges(4096, 2048) == [4096] and packing.tail_edges(0, 2048) == [0]


def test_named_query_holds_digests_of_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_packing(spark, SF).collect()
    ids = {d: np.array(whole_ids(library, t), "<u4") for d, t in texts.items()}
    assert sum(r.length for r in rows) == sum(map(len, ids.values())) and {r.doc_id for r in rows} == set(ids)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])

"""Token counts, BPE coding, token files, fingerprints and languages against plain versions."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from metaloom.llm import ctph, ecoc, tokenfiles
from metaloom.llm.bpe import WordCoder, encode_decode, word_coder
from metaloom.llm.token_counts import merged_length, token_counts
from metaloom.llm.tokenids import Frame, library_encoder, read_token_files, write_token_files
from metaloom.scale import ensure_checkpoint_dir

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "a  b", "\n", " x", "x ", "a\nb", "a \n b", "It's 'S <|endoftext|> foo", "<|endoftext|>", "ΣΑΣ", "a\x1cb \x1f c", "é É", "日本語 123 ４５", " em  sp\xa0x\r\n", "İstanbul", "don't DON'T'S", "🙂🙂 x" * 3, "<|startoftext|>A", "a" * 300]


def texts():
    rnd = random.Random(1)
    return ODD + ["".join(rnd.choice("ab É1'.\n \t -śΣß") for _ in range(rnd.randrange(40))) for _ in range(400)]


@pytest.fixture(scope="module")
def docs(table):
    return table(list(enumerate(texts())))


def test_counts_equal_the_library(docs):
    t = Tokenizer.from_file(BYTE)
    want = {i: (len(x.encode()), len(n := t.encode(x, add_special_tokens=False).ids), len(n) > 5) for i, x in enumerate(texts())}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, BYTE, limit=5).collect()} == want


def test_merging_takes_the_lowest_rank_then_the_leftmost():
    merges = {1 << 20 | 1: 0 << 20 | 2, 2 << 20 | 1: 1 << 20 | 3}
    assert merged_length([1, 1, 1], merges) == 1
    assert merged_length([1, 1, 1, 1], merges) == 2
    assert merged_length([], merges) == 0 and merged_length([9], merges) == 1


def test_codes_equal_the_library_and_decode(docs):
    t = Tokenizer.from_file(WORD)
    for r in encode_decode(docs, WORD).collect():
        ids = t.encode(texts()[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes()
        assert r.decoded == t.decode(ids, skip_special_tokens=False) == word_coder(WORD).decode(bytes(r.ids))


def test_long_fragments_merge_alike():
    coder, t, rnd = word_coder(WORD), Tokenizer.from_file(WORD), random.Random(9)
    for n in (65, 200, 3000):
        for letters in ("a", "ab", "abcdeinorst"):
            word = "".join(rnd.choice(letters) for _ in range(n))
            ids = [i for fragment in coder.cuts(word) for i in coder._fragment(fragment)]
            assert ids == t.encode(word, add_special_tokens=False).ids
    start = time.time()
    coder.matches["a" * 1_000_000]
    assert time.time() - start < 60


def test_words_merge_side_by_side():
    coder, t, rnd = word_coder(WORD), Tokenizer.from_file(WORD), random.Random(4)
    words = ["a", "é", "x" * 64, "ab" * 33, "the" * 500, "thinthha"] + ["".join(rnd.choice("abcdehinorstéß日") for _ in range(rnd.randrange(1, 70))) for _ in range(2000)]
    for word, (ids, decoded) in zip(words, coder.together(words), strict=True):
        want = t.encode(word, add_special_tokens=False).ids
        assert (ids, decoded) == (np.array(want, "<u4").tobytes(), t.decode(want, skip_special_tokens=False))


def test_prepared_words_need_no_merges_of_their_own(monkeypatch):
    coder, t = WordCoder(WORD), Tokenizer.from_file(WORD)
    coder.words.limit = 1000
    given = [" ".join(f"word{i}x{j}, it's {i}" for j in range(200)) for i in range(3)]
    for i in range(3):
        coder.prepare(given[i : i + 1])
        monkeypatch.setattr(coder, "_fragment", None)
        ids = t.encode(given[i], add_special_tokens=False).ids
        assert coder.code(given[i]) == (np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False))
        monkeypatch.undo()


def test_cuts_fall_only_where_no_token_reaches_over():
    coder = word_coder(WORD)
    pieces = coder.cuts("qzxjkv")
    assert len(pieces) > 1 and sum(map(len, pieces)) == 6


def test_token_files_round_trip(spark, docs, tmp_path):
    target = f"file://{tmp_path}/ids"
    write_token_files(docs, target, BYTE)
    t, start = Tokenizer.from_file(BYTE), 0
    got = {r.doc_id: (r.start, bytes(r.ids)) for r in read_token_files(spark, target).collect()}
    for i, x in enumerate(texts()):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        assert got[i] == (start, np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("n", [1, 5, 4095, 4096, 4097, 9000])
def test_frames_round_trip(n):
    rnd = np.random.default_rng(n)
    for ids in (rnd.integers(0, 50257, n), rnd.zipf(1.3, n) % 50257, np.resize([1, 2, 3, 50256], n)):
        frame = tokenfiles.write_chunk([3, None, -9], [0, n - 1, 1], ids.astype(np.uint32))
        back = list(tokenfiles.read_chunk(frame))
        assert [b[0] for b in back] == [3, None, -9] and (np.concatenate([b[1] for b in back]) == ids).all()


def test_damage_is_found():
    frame = bytearray(tokenfiles.write_chunk([1], [500], np.arange(500, dtype=np.uint32) % 50))
    frame[-20] ^= 4
    with pytest.raises(ValueError, match="damaged"):
        list(tokenfiles.read_chunk(bytes(frame)))


def test_pieces_are_encoded_as_the_library_does():
    """Each distinct piece is spelt once in a frame and stands for all its ids."""
    rnd = random.Random(6)
    odd = ["it's 'sab x''s", "a.b1'2!? c", "l'été,Œuvre× ÷a", "это,да! Ä.", "a_b`c\ud7ff", "ÃƑ.×x"]
    given = texts() + odd + ["".join(rnd.choice("aé×÷.,'1 _Яß日\n") for _ in range(rnd.randrange(1, 40))) for _ in range(500)] + ["thinthhaned writerhedond, thinthha.\nedsherone againesti"] * 300
    encoder = library_encoder(BYTE)
    frame = Frame(encoder, 0)
    for at in range(0, len(given), 500):
        frame.add(list(range(at, min(at + 500, len(given)))), given[at : at + 500])
    payload = frame.payload()
    for (_, ids), text in zip(tokenfiles.read_chunk(payload), given, strict=True):
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0]
    repeated = Frame(encoder, 0)
    repeated.add(list(range(300)), given[-300:])
    symbols = tokenfiles.HEADER.unpack_from(repeated.payload())[3]
    assert symbols < 0.75 * repeated.held


def test_frames_are_small():
    ids = np.resize(np.arange(1000, dtype=np.uint32), 40_000)
    assert len(tokenfiles.write_chunk([1], [len(ids)], ids)) < len(ids)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_length_equals_dynamic_programming():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(20))] for _ in range(2))
        assert ctph.common_length(a, b) == common(a, b)


def test_next_document_comparison(table):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, "one two three " * 300), (901, "one two three " * 300), (950, "x" * 5000)]
    random.Random(5).shuffle(rows)
    got = {r.doc_id: r for r in ctph.compare_with_next(table(rows)).collect()}
    rows.sort()
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (ctph.fingerprint(text), ctph.fingerprint(changed))
        assert r.near_edited == pytest.approx(ctph.likeness(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(ctph.likeness(r.fingerprint, ctph.fingerprint(following)))


def test_likeness_bounds():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    a, b = " ".join(words[:1500]), " ".join(words[1500:])
    half = " ".join(words[:750] + words[2250:])
    assert ctph.likeness(ctph.fingerprint(a), ctph.fingerprint(a)) == 1.0
    assert ctph.likeness(ctph.fingerprint(a), ctph.fingerprint(b)) < 0.2 < 0.35 < ctph.likeness(ctph.fingerprint(a), ctph.fingerprint(half))


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = ecoc.identify_languages(docs).join(docs, "doc_id").select("doc_id", "held_out", "lang_pred", "score", "lang").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_output_codes_are_apart():
    for n in (2, 3, 4, 6, 12):
        code = ecoc.codewords(n).astype(int)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else 2)
        assert (abs(code.sum(axis=0)) < n).all()


def test_odd_rows(spark, table, odd_rows):
    docs, none = table(odd_rows), table([])
    assert token_counts(docs, BYTE).count() == encode_decode(docs, WORD).count() == ctph.compare_with_next(docs).count() == len(odd_rows)
    found = {r.doc_id: r for r in ecoc.identify_languages(docs).collect()}
    assert len(found) == 7 and found[2].lang_pred == found[3].lang_pred == found[4].lang_pred == "und" and found[2].score == 0
    assert token_counts(none, BYTE).count() == encode_decode(none, WORD).count() == ctph.compare_with_next(none).count() == ecoc.identify_languages(none).count() == 0
    alone = ctph.compare_with_next(table([(7, "abc def")])).first()
    assert alone.near_next == 1.0
    target = f"{ensure_checkpoint_dir(spark)}/odd-token-files"
    write_token_files(docs, target, BYTE)
    assert read_token_files(spark, target).count() == len(odd_rows)
    write_token_files(none, target + "-none", BYTE)
    assert read_token_files(spark, target + "-none").count() == 0

"""Operators 1, 2 and 8 against the tokenizer libraries."""
import hashlib
import random

import numpy as np
import pytest

from scorewright.llm import bpe, packed_files, packing, token_count, transducer
from scorewright.llm import queries as Q

from .helpers import odd_texts, table

SF = "/root/testdata/sf0.001"


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.tokenizer_file(name))


def random_texts(n=300):
    rng = random.Random(4)
    return ["".join(rng.choice("ab <|>endoftxs'é́İΣ日1 \n\t՘") for _ in range(rng.randint(0, 150))) for _ in range(n)]


def test_counts_match_the_library_on_random_and_odd_texts(spark):
    texts = [t or "" for _, t in odd_texts()] + random_texts()
    want = [len(e.ids) for e in library(Q.BYTE_FILE).encode_batch(texts, add_special_tokens=False)]
    assert token_count.Counter(Q.tokenizer_file(Q.BYTE_FILE))(texts) == want


def test_letters_newer_than_the_unicode_tables():
    text = "a՘b \U0003fc3bz1 \U00010d40"
    assert token_count.Counter(Q.tokenizer_file(Q.BYTE_FILE))([text]) == [len(library(Q.BYTE_FILE).encode(text, add_special_tokens=False).ids)]


def test_token_counts_of_odd_rows(spark):
    rows = odd_texts()
    got = token_count.count_tokens(table(spark, rows), Q.tokenizer_file(Q.BYTE_FILE), limit=100)
    lib = library(Q.BYTE_FILE)
    want = []
    for i, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 100))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert token_count.count_tokens(table(spark, []), Q.tokenizer_file(Q.BYTE_FILE)).collect() == []


def test_op1_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: len(e.ids) for d, e in zip(docs, library(Q.BYTE_FILE).encode_batch([d.text for d in docs], add_special_tokens=False))}
    got = Q.op1_token_counts(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_merging_handles_runs_and_empty_sequences():
    t = bpe.load_table(Q.tokenizer_file(Q.BYTE_FILE))
    lib = library(Q.BYTE_FILE)
    words = [b"", b"a", b"aaaaaaa", b"", b"zzzzzzzzzzzzzzzz", b"hello"]
    ids, n = bpe.merge_ragged(t, *t.symbols(words))
    want = [lib.encode(w.decode(), add_special_tokens=False).ids for w in words]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert bpe.merge_ragged(t, *t.symbols([]))[1].tolist() == []


def test_lookahead_is_sufficient_and_found_in_a_small_list(tmp_path):
    """Boundaries further left than the lookahead don't depend on what follows."""
    path = Q.tokenizer_file(Q.WORD_FILE)
    look, rng = bpe.load_lookahead(path), random.Random(2)
    assert 0 < look < 5000
    enc = transducer.Encoder(path)
    for _ in range(3):
        head = "".join(rng.choice("abcdefghinorst") for _ in range(look + 300))
        cuts = []
        for tail in ("a", "ing", "xq" * 20):
            ids = enc.streams([(head + tail).encode()])[0]
            ends = np.cumsum([len(enc.table.tokens[i].removesuffix("</w>")) for i in ids])
            cuts.append(ends[ends <= len(head) - look].tolist())
        assert cuts[0] == cuts[1] == cuts[2]


@pytest.mark.parametrize("step", [1, 50, 4096])
def test_long_words_stream_through_a_window(step):
    path, rng, lib = Q.tokenizer_file(Q.WORD_FILE), random.Random(3), library(Q.WORD_FILE)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for n in (1, 4000, 9000)] + ["a" * 6000]
    got = transducer.Encoder(path, step).streams([w.encode() for w in words])
    assert got == [lib.encode(w, add_special_tokens=False).ids for w in words]


def test_codec_matches_the_library(spark):
    path, lib = Q.tokenizer_file(Q.WORD_FILE), library(Q.WORD_FILE)
    texts = [t or "" for _, t in odd_texts()] + random_texts()
    for t in texts:
        ids = transducer.encode_ids([t], path)[0]
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert transducer.decode_ids(ids, path, plain=False) == lib.decode(ids, skip_special_tokens=False)


def test_plain_decoding_is_a_round_trip_and_incremental():
    path = Q.tokenizer_file(Q.WORD_FILE)
    text = "naïve 日本語 \U0001f600 words"
    ids = transducer.encode_ids([text], path)[0]
    assert transducer.decode_ids(ids, path).split() == text.split()
    d = transducer.Decoder(path)
    assert d.feed(ids[:3]) + d.feed([]) + d.feed(ids[3:]) + d.finish() == transducer.decode_ids(ids, path)
    lone = [i for i, t in d.table.tokens.items() if t == "Ã"]  # the first byte of a character
    assert transducer.decode_ids(lone, path) == "�"


def test_encode_documents_of_odd_rows(spark):
    rows, lib, path = odd_texts(), library(Q.WORD_FILE), Q.tokenizer_file(Q.WORD_FILE)
    got = transducer.encode_documents(table(spark, rows), path).collect()
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False), transducer.decode_ids(ids, path))]
        want.append((i, len(ids), *sha))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert transducer.encode_documents(table(spark, []), Q.tokenizer_file(Q.WORD_FILE), with_ids=True).collect() == []


def brute_best_fit(sizes, capacity):
    room, out = [], []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            # any sequence with the least room will do
            k = max(j for j, r in enumerate(room) if r == min(fits))
        else:
            k = len(room)
            room.append(capacity)
            out.append([])
        room[k] -= sizes[i]
        out[k].append(i)
    return sorted(sum(sizes[i] for i in s) for s in out)


def test_best_fit_decreasing_matches_brute_force():
    rng = random.Random(6)
    for capacity in (1, 7, 64, 100):
        for _ in range(30):
            sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
            got = packing.best_fit(sizes, capacity)
            assert sorted(i for s in got for i in s) == list(range(len(sizes)))
            fill = sorted(sum(sizes[i] for i in s) for s in got)
            assert fill == brute_best_fit(sizes, capacity) and all(f <= capacity for f in fill)


def test_packing_is_lossless(spark):
    path, lib = Q.tokenizer_file(Q.BYTE_FILE), library(Q.BYTE_FILE)
    rows = [(i, t) for i, t in {i: (i, t) for i, t in odd_texts()}.values() if i is not None]
    packed = packing.pack_documents(table(spark, rows), path, capacity=96)
    back = {r.doc_id: np.frombuffer(bytes(r.ids), "<u2").tolist() for r in packing.documents_back(packed).collect()}
    want = {i: lib.encode(t, add_special_tokens=False).ids for i, t in rows if t}
    assert back == want
    for r in packed.collect():
        assert len(r.ids) == 96 * 2 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 96
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.doc_offsets) == len(r.cu_seqlens) - 1
    assert packed.select("seq_id").distinct().count() == packed.count()
    assert packing.pack_documents(table(spark, []), path).collect() == []
    assert packing.pack_documents(table(spark, [(1, None), (2, "")]), path).collect() == []


def plain(rows):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else tuple(x) if isinstance(x, list) else x for x in r) for r in rows), key=lambda r: r[0])


@pytest.mark.parametrize("group", [3, 8192])
def test_packed_files_give_the_rows_back(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(packed_files, "ROWS", group)
    path = Q.tokenizer_file(Q.BYTE_FILE)
    capacity = 99  # not a whole number of bytes of bits
    packed = packing.pack_documents(table(spark, odd_texts(), parts=1), path, capacity=capacity)
    out = packed_files.write_packed(packed, str(tmp_path / "packed"), capacity, packing.id_width(path))
    want = plain(packed.collect())
    assert any(None in r[5] for r in want) and plain(packed_files.read_packed(spark, out).collect()) == want

    manifest = packed_files.read_manifest(spark, out).collect()
    assert sum(m.n_rows for m in manifest) == len(want) and sum(m.n_tokens for m in manifest) == sum(r[1] for r in want)
    assert sum(m.n_segments for m in manifest) == sum(len(r[5]) for r in want) and max(m.n_rows for m in manifest) <= group
    by_seq = {r[0]: r for r in want}
    for m in manifest:  # the files read without the library
        ids = np.fromfile(f"{out}/{m.name}.ids", "<u2").reshape(-1, capacity)
        bits = np.unpackbits(np.fromfile(f"{out}/{m.name}.resets", np.uint8).reshape(len(ids), -1), axis=1, bitorder="little")
        cu, at = np.fromfile(f"{out}/{m.name}.cu", "<i4").tolist(), 0
        for row, bit, (seq, n, segments) in zip(ids, bits, np.fromfile(f"{out}/{m.name}.rows", "<i8").reshape(-1, 3).tolist(), strict=True):
            r = by_seq[seq]
            assert row.tobytes() == r[2] and tuple(cu[at : at + segments + 1]) == r[3] and n == r[1]
            at += segments + 1
            assert np.flatnonzero(bit).tolist() == [*r[4], *[n] * (n < capacity)]
        assert at == len(cu)


def test_packed_files_odd_cases(spark, tmp_path):
    path = Q.tokenizer_file(Q.BYTE_FILE)
    none = packing.pack_documents(table(spark, []), path, capacity=64)
    assert packed_files.read_packed(spark, packed_files.write_packed(none, str(tmp_path / "none"), 64, 2)).collect() == []
    some = packing.pack_documents(table(spark, [(1, "one two three")]), path, capacity=64)
    with pytest.raises(Exception, match="id rows are not"):
        packed_files.write_packed(some, str(tmp_path / "wide"), 64, 4)
    out = packed_files.write_packed(some, str(tmp_path / "some"), 64, 2)
    name = packed_files.read_manifest(spark, out).first().name
    (tmp_path / "some" / f"{name}.cu").write_bytes(b"1234")
    with pytest.raises(Exception, match="is not the file of the manifest"):
        packed_files.read_packed(spark, out).collect()


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocks_change_nothing(block):
    path, lib = Q.tokenizer_file(Q.WORD_FILE), library(Q.WORD_FILE)
    texts = [t or "" for _, t in odd_texts()] + random_texts(120) + ["ΟΔΟΣ ΑΣ\u0301 \u0301x", " a", "a "]
    for text, (n, *_, ids) in zip(texts, transducer.run_streams(texts, path, keep=True, block=block), strict=True):
        assert ids == lib.encode(text, add_special_tokens=False).ids and n == len(ids)


def test_a_text_of_ten_megabytes_needs_little_memory_beside_it():
    import tracemalloc

    path, lib = Q.tokenizer_file(Q.WORD_FILE), library(Q.WORD_FILE)
    rng = random.Random(6)
    text = " ".join(rng.choice("the quick brown fox jumps naïve 日本 over".split()) + str(rng.randrange(50)) for _ in range(1_400_000))
    assert len(text.encode()) > 10_000_000
    list(transducer.run_streams(["warm up " * 10], path))
    tracemalloc.start()
    (n, ids_sha, shown_sha, _), = transducer.run_streams([text], path, block=1 << 16)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40_000_000  # the ids alone would be more than 100 MB
    ids = lib.encode(text, add_special_tokens=False).ids
    assert n == len(ids) and ids_sha == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert shown_sha == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_latin_texts_are_split_as_others():
    rng = random.Random(5)
    every, some = "".join(map(chr, range(256))), "a'stre mvld\x1c\x1d\n\x85\xa0²½é_9-"
    for i in range(2000):
        text = "".join(rng.choices(every if i % 2 else some, k=rng.randint(0, 60)))
        assert bpe.is_latin(text) and bpe.latin_splitter().findall(text) == bpe.splitter(bpe.WORD_PATTERN).findall(text)
    assert not bpe.is_latin("a日")


def test_streams_of_one_window_give_what_stepwise_ones_give():
    path = Q.tokenizer_file(Q.WORD_FILE)
    wide, narrow = transducer.Encoder(path), transducer.Encoder(path)
    narrow.window = narrow.lookahead + max(map(len, narrow.table.tokens.values())) + 2
    words = [w.encode() for w in ["", "a", "unbelievable", "é" * 9, "x" * 300, "the", ("anthropology" * narrow.window)[: narrow.window + 60]]]
    assert narrow.window < max(map(len, words)) <= wide.window
    assert wide.streams(words) == narrow.streams(words) and wide.streams([]) == []

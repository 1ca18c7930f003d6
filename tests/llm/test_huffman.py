import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import huffman as H
from tessera.llm.vocabulary import byte_bpe
from tessera.storage import shared_path


@pytest.mark.parametrize("limit", [4, 6, 20])
def test_code_lengths(limit):
    rng = np.random.default_rng(limit)
    counts = np.zeros(40, np.int64)
    counts[rng.choice(40, 14, replace=False)] = 2 ** rng.integers(0, 18, 14)
    lengths = H.code_lengths(counts, limit)
    used = counts > 0
    assert (lengths[used] >= 1).all() and (lengths[used] <= limit).all() and not lengths[~used].any()
    assert (0.5 ** lengths[used]).sum() <= 1
    if limit == 20:  # as good as plain Huffman
        heap = sorted(counts[used].tolist())
        cost = 0
        while len(heap) > 1:
            a, b, *heap = heap
            cost += a + b
            heap = sorted([*heap, a + b])
        assert (counts * lengths).sum() == cost


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 5000])
def test_round_trip_of_a_block(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.02, n), 399).astype(np.uint32)
    code = H.Code.of(H.code_lengths(np.bincount(ids, minlength=400), 12))
    payload, checkpoints = H.encode_block(code, ids)
    assert np.array_equal(H.decode_block(code, payload, checkpoints, n), ids)


ODD = ["", None, " ", "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext", "Ünï cödé 漢字 🎉‍", "a" * 30000, "\n\n  \t", "it's we'LL I'd", "�\x00\x85  z"]


def test_same_ids_as_the_tokenizers_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ODD:
        assert byte_bpe().ids(text, 7).tolist() == [*byte_bpe().encode(text or ""), 7]
        assert byte_bpe().encode(text or "") == library.encode(text or "", add_special_tokens=False).ids


def test_files_hold_what_was_written(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_TOKENS", 5000)
    rows = [(i * 3 - 10, t) for i, t in enumerate(ODD)] + [(5000 - r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    path = shared_path(spark, "t")
    H.write_tokens(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int").repartition(3), path)
    got = H.with_global_start(spark, H.read_tokens(spark, path, H._crc, "ids_crc32 long"), path).orderBy("doc_id").collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    for r, (doc, text) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_table_repeated_and_null_ids(spark):
    path = shared_path(spark, "t")
    H.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert H.read_tokens(spark, path, H._crc, "c long").count() == 0
    path = shared_path(spark, "t")
    H.write_tokens(spark.createDataFrame([(7, "b c"), (7, "b c"), (None, "a"), (7, "zz")], "doc_id long, text string"), path)
    got = H.with_global_start(spark, H.read_tokens(spark, path, H._crc, "c long"), path).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == [(-1, 2), (7, 2), (7, 3), (7, 3)]
    assert sorted(r["start"] for r in got)[0] == 0

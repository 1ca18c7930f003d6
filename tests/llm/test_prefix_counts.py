import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import prefix_counts as C

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", " ", "a", "<|endoftext|>", "x  <|endoftext|> y<|endoftext", "Ünï cödé 漢字 🎉‍", "a" * 300, "\n\n  \t", "it's we'RE we're I'd they'll 've", "a   b", "a \n\n b\n c　　d", "x==========y  !!  'll", "  z  "]


def library_counts(text):
    return [len(LIBRARY.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def prefix_counts(texts):
    counts, bounds = C.prefix_counter().counts(texts)
    out = []
    for k, text in enumerate(texts):
        own, at, mine = counts[bounds[k] : bounds[k + 1]], 0, [0]
        for ch in text:
            at += len(ch.encode())
            mine.append(int(own[at]))
        assert len(own) == len(text.encode()) + 1
        out.append(mine)
    return out


def test_every_prefix_of_odd_texts():
    for text, got in zip(ODD, prefix_counts(ODD), strict=True):
        assert got == library_counts(text), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeéthesTiou'rlvse  \n\t1!<|endoftext>　漢"), max_size=30), max_size=4))
def test_every_prefix_of_drawn_texts(texts):
    assert prefix_counts(texts) == [library_counts(t) for t in texts]


def test_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"], "n") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(-1, None, "n"), (-2, "z" * 3000, "n")]
    got = C.prefix_token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), budget=100).collect()
    want = {i: (t or "") for i, t, _ in rows}
    for r in got:
        text = want[r["doc_id"]]
        assert r["n_tokens"] == len(LIBRARY.encode(text, add_special_tokens=False).ids)
        assert r["n_bytes"] == len(text.encode())
        head = text.encode()[: r["fit_bytes"]].decode()
        assert len(LIBRARY.encode(head, add_special_tokens=False).ids) <= 100
        if len(head) < len(text):
            assert len(LIBRARY.encode(text[: len(head) + 1], add_special_tokens=False).ids) > 100


@pytest.mark.parametrize("keep", [False, True])
def test_empty_table(spark, keep):
    out = C.prefix_token_counts(spark.createDataFrame([], "doc_id long, text string"), keep_table=keep)
    assert out.count() == 0 and "n_tokens" in out.columns


def test_long_words_are_counted_at_speed():
    """Words of thousands of bytes: ids of the library at every prefix that is drawn, and a bounded time for a byte."""
    import random
    import time

    draw = random.Random(1)
    counter = C.prefix_counter()
    chinese = "".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(20_000))
    for text in (chinese, "a" * 60_000, " " * 30_000, "xyz" * 20_000):
        began = time.process_time()
        counts, bounds = counter.counts([text])
        assert time.process_time() - began < 10 * len(text.encode()) / 1e6 + 1  # seconds, under a loaded machine
        raw = text.encode()
        for n in [draw.randrange(len(text)) for _ in range(3)] + [len(text)]:
            assert counts[len(text[:n].encode())] == len(counter.bpe.encode(text[:n]))
        assert bounds.tolist() == [0, len(raw) + 1]

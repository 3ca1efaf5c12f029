"""The encoders against the tokenizers library, streamed and whole, and the decoder's way back."""

import hashlib
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from kinmerge.llm import bpe, repair, units

PATH = bpe.default_path()
LIBRARY = Tokenizer.from_file(PATH)
POOLS = ["".join(map(chr, range(0x20, 0x250))), "abc's'tred'ml lv!\"  \n", "aé'’ß½\x1c<|> ", "ae", "'", "!!'", "\u0301\u0302ab ", "가각\u11a8각", "क्षि ka", "<|endoftext|>", "𝔸a1Ⅷ²ﷺ漢字カ", "İΣσ Ωǅ"]


def limited(coder, chunk, entries=1):
    """An encoder over small chunks, with a table of its own."""
    return units.UnitEncoder(coder.units, coder.long, coder.merges.special if isinstance(coder, bpe.Coder) else coder.special, chunk, units.table_for(chunk, entries))


def ids_of(encoder, texts):
    out, own = [], []
    for ids, closed in encoder.stream(None if t is None else t.encode() for t in texts):
        own += ids.tolist()
        if closed:
            out.append(own)
            own = []
    assert not own
    return out


def want(texts):
    return [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(params=["transducer", "library"])
def coder(request):
    return bpe.Coder(PATH) if request.param == "transducer" else repair.Library(PATH)


def test_every_code_point(coder):
    # beyond the tables' planes every tenth
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 10 == 0)]
    texts = [" ".join(f"{c} a{c}B" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    got = ids_of(coder.encoder(), texts)
    assert [i for i, (g, w) in enumerate(zip(got, want(texts))) if g != w] == []


def test_random_texts_whole_and_in_chunks(coder):
    r = random.Random(5)
    texts: list = [None, ""]
    for _ in range(1500):
        x = "".join(r.choice("".join(r.sample(POOLS, 3))) for _ in range(r.randint(0, 60)))
        texts.append(x[:10] + r.choice(["", "", "<|endoftext|>", "<|startoftext|><|endoftext|>", "<|endof"]) + x[10:])
    assert ids_of(coder.encoder(), texts) == want(texts)
    assert ids_of(limited(coder, 64), texts) == want(texts)
    if isinstance(coder, bpe.Coder):
        coder.transducer.window = coder.merges.lookahead + 8
    long = []
    for _ in range(150):
        pool = "".join(r.sample(POOLS, 2)).replace(" ", "")
        x = "".join(r.choice(pool) for _ in range(r.randint(100, 900)))
        long += [x, x[:300] + r.choice(["<|endoftext|>", "'re", "''s", " ", "\n "]) + x[300:]]
    for chunk in (64, 150):
        assert ids_of(limited(coder, chunk), long) == want(long)


def test_tables_start_anew():
    # a table with room for one chunk only, and hashes that all clash
    c = bpe.Coder(PATH)
    texts = [" ".join(f"word{i * 7 + k}" for k in range(40)) for i in range(300)]
    assert ids_of(limited(c, 600), texts) == want(texts)
    real = units.polynomial_hashes
    units.polynomial_hashes = lambda low, starts, ends, value_of: real(low, starts, ends, value_of) & np.uint64(3)
    try:
        assert ids_of(limited(c, 600), texts[:20]) == want(texts[:20])
    finally:
        units.polynomial_hashes = real


def test_memory_of_a_long_word():
    import tracemalloc

    c = bpe.Coder(PATH)
    ids_of(limited(c, 4096), ["warm up"])
    sizes = []
    for n in (1 << 13, 1 << 15):
        text = (b"ab0!" * n)[:n]
        tracemalloc.start()
        encoder = limited(c, 4096)
        total = sum(len(x) for x, _ in encoder.stream([text]))
        sizes.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert total > n // 8
    assert sizes[1] < sizes[0] + (1 << 17)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base = [(i, "".join(r.choice(POOLS[i % len(POOLS)] + " ") for _ in range(r.randint(0, 200)))) for i in range(60)]
    return [*base, (60, None), (61, ""), (None, "Lost words"), (5, base[5][1]), (5, "another"), (62, "long " * 60_000 + "x" * 300_000)]


def test_digests_and_ids(spark, rows):
    docs = spark.createDataFrame([(i, t, [7], "extra") for i, t in rows], "doc_id bigint, text string, ids array<int>, n_tokens string").repartition(3)
    wanted = {}
    for (i, _), ids in zip(rows, want([t for _, t in rows])):
        shown = LIBRARY.decode(ids, skip_special_tokens=False)
        plain = re.sub("</w>", " ", shown) if i is None else None
        wanted.setdefault(i, []).append((ids, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest(), plain))
    got = bpe.digests(docs).collect()
    assert sorted((r[0], *r[1:4]) for r in got if r[0] is not None) == sorted((i, *w[1:4]) for i, all_ in wanted.items() if i is not None for w in all_)
    coded = bpe.encode(docs)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids"]
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in coded.collect()) == sorted((i or -1, w[0]) for i, all_ in wanted.items() for w in all_)
    empty = spark.createDataFrame([], docs.schema)
    assert bpe.digests(empty).count() == bpe.encode(empty).count() == 0


def test_decoder_in_steps():
    c = bpe.coder(PATH)
    for text, plain in (("Crème brûlée, 2 go", "crème brûlée , 2 go "), ("漢字 ok", "漢字 ok "), ("", "")):
        ids = want([text])[0]
        whole = bpe.Decoder(c.tables)
        shown, out = whole.feed(ids)
        assert shown.decode() == LIBRARY.decode(ids, skip_special_tokens=False) and out + whole.end() == plain
        steps = bpe.Decoder(c.tables)
        parts = [steps.feed([i]) for i in ids]
        assert b"".join(p[0] for p in parts) == shown and "".join(p[1] for p in parts) + steps.end() == plain
    broken = bpe.Decoder(c.tables)  # half a character, then the end
    half = [i for i, t in enumerate(c.tables[1]) if t == b"\xe6"][0]
    assert broken.feed([half])[1] == "" and broken.end() == "\ufffd"


def test_random_access(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    shards = repair.write(docs, shard_tokens=500)
    asked = spark.createDataFrame([(5,), (7,), (61,), (999,), (7,)], "doc_id bigint")
    got = sorted((r["doc_id"], r["ids"]) for r in repair.lookup(shards, asked).collect())
    assert got == sorted((i, ids + [2]) for (i, _), ids in zip(rows, want([t for _, t in rows])) if i in (5, 7, 61))
    empty = repair.write(docs.limit(0))
    assert repair.read_digests(empty).count() == repair.read(empty).count() == repair.lookup(empty, asked).count() == 0

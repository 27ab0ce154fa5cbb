"""Token files: codes, random access, order, and the library's own encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from docloom.llm.pieces import encoder
from docloom.llm.tokenbin import Dac, TokenFile, dac_write, read_files, write_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
KINDS = "doc_id long, text string, part string, seq int, file string"


def test_codes():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 511, 512, 513, 5000):
        ids = np.where(rnd.random(n) < 0.5, rnd.integers(0, 256, n), rnd.integers(0, 1 << rnd.integers(1, 33), n)).astype(np.uint64)
        dac = Dac(memoryview(dac_write(ids)))
        assert (dac.access(np.arange(n)) == ids).all()
        at = rnd.integers(0, n, 3 * n) if n else np.zeros(0, int)
        assert (dac.access(at) == ids[at]).all()


def test_pieces_are_the_library():
    rnd = random.Random(1)
    parts = list("abS tT'sred ve ll'm'  \n\n\t 12.,!?«é–ñ 　中\x1c\x85'’²½_-") + ["'s", "'re", "'ll", " '", "<|endoftext|>", "\U0001f600", "x́", "'S", "\x00"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(8000)]
    e = encoder(PATH)
    ids, sizes = e.encode(texts)
    at = 0
    for t, q, n in zip(texts, e.lib.encode_batch(texts, add_special_tokens=False), sizes):
        assert ids[at : at + n].tolist() == q.ids, repr(t)
        at += n
    assert at == len(ids)


def test_long_texts_are_cut(monkeypatch):
    from docloom.llm import pieces

    monkeypatch.setattr(pieces, "LONG", 40)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["ab", "C", "1", " ", " ", "  ", "\n", "'s", "é", "<|endoftext|>"]) for _ in range(rnd.randint(0, 200))) for _ in range(400)] + ["x" * 500, " " * 300]
    e = encoder(PATH)
    ids, sizes = e.encode(texts)
    want = [q.ids for q in e.lib.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [x for q in want for x in q]
    assert max(len(pieces.chunks(t)) for t in texts) > 3


def test_other_tokenizers_go_to_the_library(tmp_path):
    import json

    for change in ({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"normalizer": {"type": "Lowercase"}}):
        with open(PATH, encoding="utf-8") as f:
            data = json.load(f) | change
        path = str(tmp_path / "t.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(data, f)
        from docloom.llm.pieces import PieceEncoder

        texts = ["Some Text 12", "", "MORE  text"]
        ids, sizes = PieceEncoder(path).encode(texts)
        want = [x for t in texts for x in Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids]
        assert ids.tolist() == want and sizes.sum() == len(want)


def test_files(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(f"word{rnd.randrange(99)}" for _ in range(rnd.randint(0, 60)))) for i in rnd.sample(range(10**6), 150)]
    rows += [(5, None), (6, ""), (7, "long text " * 20_000), (None, "no id"), (8, "twice"), (8, "twice"), (8, "other"), (-3, "<|endoftext|> é")]
    files = write_files(spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], KINDS), PATH, file_tokens=500).cache()
    got = sorted(read_files(files).collect(), key=lambda r: r.start)
    lib = Tokenizer.from_file(PATH)
    start, seen = 0, []
    for r in got:
        assert r.start == start
        start += r.n_tokens
        seen.append(r.doc_id)
    assert seen == sorted(seen, key=lambda x: (x is not None, x or 0))
    crc = lambda t: (lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))(lib.encode(t or "", add_special_tokens=False).ids + [0])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), *crc(t)) for d, t in rows)
    texts = dict(rows)
    for row in files.collect():
        f = TokenFile(bytes(row.file))
        for i, d in enumerate(f.doc_ids):
            if d not in (8, None):
                want = lib.encode(texts[d] or "", add_special_tokens=False).ids + [0]
                assert f.tokens(i).tolist() == want and f.tokens(i, 2, 5).tolist() == want[2:5]
    assert read_files(write_files(spark.createDataFrame([], KINDS), PATH)).collect() == []

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import samples
from veriflate.llm import packing as M

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(M.VOCABULARY))


def ids(text):
    return np.array([*(TOKENIZER.encode(text, add_special_tokens=False).ids if text else []), 0], "<u4")


def test_units_give_the_same_ids():
    rng, encoder, letters = samples.random.Random(5), M.Encoder(), " \t\n  \x1c\x85ab'sTé😀1.,!　"
    for i in range(2000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(30))) + (" <|endoftext|>x" if i % 40 == 0 else "")
        assert encoder.encode(t) + bytes(4) == ids(t).tobytes()


def test_pieces(spark):
    pairs = [p for p in samples.odd() if p[0] != 4] + [(4, "One"), (4, "One")] + samples.texts(2, 300)
    out = M.pack(samples.frame(spark, pairs, 5)).collect()
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= M.LENGTH
    # Null ids and repeated rows share their pieces' keys, so that all others are checked one by one.
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    for i, t in pairs:
        if i in (None, 4):
            continue
        want, at = ids(t), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(want[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(want)
    total = sum(len(ids(t)) for _, t in pairs)
    assert sum(r.length for r in out) == total
    assert total / (len(sequences) * M.LENGTH) > 0.97


def test_empty(spark):
    assert M.pack(samples.frame(spark, [])).count() == 0


def test_windows_stay_bounded():
    packer, rng = M.Packer(), samples.random.Random(1)
    for i in range(3000):
        packer.add(i, bytes(4 * rng.randrange(1, 1500)))
        assert len(packer.open) <= M.OPEN
    assert all(sum(p[2] for p in w) == M.LENGTH for w in packer.full)

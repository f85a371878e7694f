import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from assay.llm import packing
from tests.llm.cases import awkward, empty


def check(docs, window, **how):
    tok = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.packed(docs, window=window, **how).collect()
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append([*tok.encode(r.text or "", add_special_tokens=False).ids, 2])
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(want)
    for doc, texts in want.items():
        ids = np.array(texts[0], "<u4")
        spans = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[doc])
        covered = sorted(x for s, n, _, _ in spans for x in range(s, s + n))
        assert covered == sorted(x for t in texts for x in range(len(t)))
        for s, n, crc, total in spans:
            assert crc == zlib.crc32(ids[s : s + n].tobytes()) and total == len(ids)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == window or at & (at - 1) == 0 and at < window  # nothing is padded
    return sequences


def test_every_id_in_one_piece_without_padding(spark):
    docs = awkward(spark, extra=True)
    for window, open_windows in ((16, 2), (64, 3), (4096, 16)):
        check(docs.repartition(3), window, open_windows=open_windows, merge_fan=2)


def test_given_documents(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 3000"), 4096)


def test_empty_table(spark):
    assert packing.packed(empty(spark)).count() == 0


def test_words_encode_as_the_whole_tokenizer():
    tok = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.encoder(packing.tokenizer_path())
    words = ["Don't", "ΣΑΣ", "naïve", "étude", "<|endoftext|>x", "日本語", "a\x1cb", "İstanbul", "x" * 300, "½²", "''s"]
    for w in words:
        assert encode.word(w) == tuple(tok.encode(w, add_special_tokens=False).ids), w

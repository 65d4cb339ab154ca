import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from iocscan.llm import packing
from iocscan.llm.packing import best_fit, pack_documents

from .helpers import empty, odd_rows, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_best_fit_takes_the_fullest_bin_that_fits():
    assert best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
    assert best_fit([], 10) == []
    assert best_fit([10, 10], 10) == [[0], [1]]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rows = odd_rows() + [(400, "text <|endoftext|> inside"), (401, "漢字 и кириллица"), (402, "ab " * 2047), (403, "tail")] * 2
    found = pack_documents(table(spark, rows).repartition(7), tokenizer=PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r.sequence].append((r.offset, r.length))
        pieces[r.id].append((r.piece, r.start, r.length, r.crc))
    expected, total = defaultdict(list), 0
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[doc].append((n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 2


def test_all_bins_reach_the_end(spark, monkeypatch):
    """Nothing fits together and groups pass on one bin at most: every piece must still be packed."""
    monkeypatch.setattr(packing, "PASSED_ON", 1)
    monkeypatch.setattr(packing, "LOCAL_PIECES", 4)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rows = [(i, "hello " * 1200) for i in range(40)]
    found = pack_documents(table(spark, rows, clash=False).repartition(6), tokenizer=PATH).collect()
    assert sorted(r.id for r in found) == list(range(40))
    assert len({r.sequence for r in found}) == 40


def test_empty(spark):
    assert pack_documents(empty(spark), tokenizer=PATH).collect() == []


def test_large_and_small_of_different_partitions_meet(spark, monkeypatch):
    """Long texts in one partition, short ones in the other, and more bins than go to one group: a long and a short one fill a sequence."""
    monkeypatch.setattr(packing, "PASSED_ON", 50)
    rows = [(i, "hello " * (1210 if i < 300 else 810)) for i in range(600)]
    found = pack_documents(table(spark, rows, clash=False).repartitionByRange(2, "doc_id"), tokenizer=PATH).collect()
    assert sorted(r.id for r in found) == list(range(600))
    assert len({r.sequence for r in found}) <= 320

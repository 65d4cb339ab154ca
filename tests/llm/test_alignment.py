import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from iocscan.llm import alignment
from iocscan.llm.alignment import galloping_ranks, overlaps, token_links

from .helpers import empty, odd_rows, table

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """Every pair of tokens of every text, by the two programs alone."""
    a_side = Tokenizer.from_file(BYTES)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    docs = []
    for doc, text in rows:
        a, b = [], []
        if text:
            a = a_side.encode(" " + text, add_special_tokens=False).ids
            b = b_side.encode(text)
        a_bytes = [bytes(byte_of[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            docs.append((doc, [], [], [], []))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        links, first = [], 0
        for i, end in enumerate(a_ends):
            start = a_ends[i - 1] if i else 0
            while first and b_ends[first - 1] > start:
                first -= 1
            while b_ends[first] <= start:
                first += 1
            j = first
            while j < len(b) and (b_ends[j - 1] if j else 0) < end:
                links.append((a[i], b[j]))
                j += 1
        groups, i, j = [], 0, 0
        at_a, at_b = ({end: k + 1 for k, end in enumerate(ends)} for ends in (a_ends, b_ends))
        for end in sorted(set(a_ends) & set(b_ends)):
            to_a, to_b = at_a[end], at_b[end]
            groups.append(f"{','.join(map(str, a[i:to_a]))}|{','.join(map(str, b[j:to_b]))}")
            i, j = to_a, to_b
        docs.append((doc, a, b, links, groups))
    held = Counter(pair for d in docs for pair in set(d[3]))
    highest = defaultdict(int)
    for (a, _), n in held.items():
        highest[a] = max(highest[a], n)
    return Counter((
        doc, len(a), len(b), len(groups), len(links), sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links),
        ";".join(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc, a, b, links, groups in docs)


def odd_texts():
    return [
        (700, "<|endoftext|> and <s> or </s> <unk> <0x41>"), (701, "a▁b"), (702, "   three  spaces\n\n\ttabs   "), (703, "日本語のテキスト と English"),
        (704, "🙂🙃 emoji‍👩‍👩‍👧"), (705, "\u0000nul \x1f \x85 \xa0 nbsp"), (706, "ſ K İ ß ﬁ ① ²"), (707, "don't we'll I'm it's"), (708, "α β γ Привет мир"),
        (709, "é é ́"), (710, " "), (711, "\n"), (712, "𝔘𝔫𝔦𝔠𝔬𝔡𝔢"), (713, "x" * 300 + "1234567890" * 30)]


def flat(rows):
    return Counter((r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups, r.groups_sha256) for r in rows)


def test_same_as_brute_force(spark):
    rows = [r for r in odd_rows() if len(r[1] or "") < 20_000] + odd_texts()
    rng = random.Random(12)
    signs = "abc é ü 漢 🙂 \n\t,.!?'0123 ABC ﬁ Ж <|>"
    rows += [(1000 + i, "".join(rng.choice(signs) for _ in range(rng.randrange(40)))) for i in range(150)]
    expected = brute(rows)
    assert flat(token_links(table(spark, rows), BYTES, PIECES).collect()) == expected
    assert sum(1 for e in expected if e[1]) > 150 and any(e[0] == 701 and not e[1] for e in expected)


def test_many_pairs_are_joined_by_a_shuffle(spark, monkeypatch):
    rows = odd_rows()[:8] + odd_texts()
    monkeypatch.setattr(alignment, "BROADCAST_IDS", 10)
    assert flat(token_links(table(spark, rows), BYTES, PIECES).collect()) == brute(rows)


def test_very_long_text_and_empty_table(spark):
    rows = [r for r in odd_rows() if len(r[1] or "") >= 20_000]
    assert len(rows) >= 2 and flat(token_links(table(spark, rows), BYTES, PIECES).collect()) == brute(rows)
    assert token_links(empty(spark), BYTES, PIECES).collect() == []


@pytest.mark.parametrize("block", [1, 3, 256])
def test_galloping(monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng = np.random.default_rng(block)
    for _ in range(60):
        total = int(rng.integers(1, 150))
        short, long = (np.append(np.sort(rng.choice(np.arange(1, total + 1), int(rng.integers(0, total)), replace=False)), total + 1) for _ in "ab")
        ranks, common = galloping_ranks(short, long)
        assert np.array_equal(ranks, np.searchsorted(long, short)) and np.array_equal(common, np.isin(short, long))
        first, count = overlaps(ranks, common)
        for i in range(len(short)):
            begin, end = short[i - 1] if i else 0, short[i]
            met = [j for j in range(len(long)) if (long[j - 1] if j else 0) < end and long[j] > begin]
            assert (met[0], len(met)) == (first[i], count[i])


def test_query(spark, tmp_path):
    from iocscan.llm.queries import op12
    rows = odd_texts() + [(800, None), (801, "")]
    table(spark, rows, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    found = op12(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == Counter((*e[:7], e[8]) for e in brute(rows))

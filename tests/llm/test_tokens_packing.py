import zlib

import numpy as np
import public_tokenizers
import pytest
from support import ODD, documents
from tokenizers import Tokenizer

from treegauge.llm import pieces as pc
from treegauge.llm.packing import best_fit, lower_bound, pack, packed_documents, pieces, sequences
from treegauge.llm.token_counts import safe_pieces, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_counts_are_those_of_the_library(spark):
    plain = Tokenizer.from_file(BYTES)
    got = token_counts(documents(spark), BYTES).collect()
    assert "text" not in got[0].asDict() and got[0]["deal"] == "deal"
    want = sorted((str(i), len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids))
                  for i, t in ODD)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts(documents(spark, []), BYTES).collect() == []


@pytest.mark.parametrize("t", ["a  b", " a", "a ", "\n", "a\x85b c", "'s 's", "a \xa0b", "!\x1c !\x1d", "a\n\n b\t\tc"])
def test_pieces_are_cut_where_the_tokenizer_cuts(t):
    plain = Tokenizer.from_file(BYTES)
    own, feeds = safe_pieces(t)
    count = lambda x: len(plain.encode(x, add_special_tokens=False).ids)
    assert sum(map(count, own)) + feeds == count(t)


def test_a_full_memory_keeps_the_first_pieces(monkeypatch):
    monkeypatch.setattr(pc, "REMEMBERED", 50)
    monkeypatch.setattr(pc, "KEPT", 10)
    known, plain = pc.PieceTokens(WORDS, True), Tokenizer.from_file(WORDS)
    for start in range(0, 300, 40):
        own = ["word%d" % i for i in range(start, start + 40)] + ["word0"]
        want = [i for w in own for i in plain.encode(w, add_special_tokens=False).ids]
        assert known.flat(known.numbers(own)).tolist() == want


def test_packing_places_every_piece_once(spark):
    docs = documents(spark)
    rows = packed_documents(docs, capacity=256).collect()
    plain = Tokenizer.from_file(WORDS)
    want = []
    for i, t in ODD:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(str(i), n, s, len(ids[s:s + 256]), zlib.crc32(ids[s:s + 256].tobytes()))
                 for n, s in enumerate(range(0, len(ids), 256))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) == -(-sum(w[3] for w in want) // 256)
    assert packed_documents(documents(spark, [])).collect() == []


def test_exchange_between_partitions_and_whole_sequences(spark, monkeypatch):
    from treegauge.llm import packing

    monkeypatch.setattr(packing, "PARTITION_PIECES", 40)
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 101, 400).tolist()
    frame = spark.createDataFrame([(i, n, i) for i, n in enumerate(lengths)], "doc_id bigint, length bigint, deal bigint")
    rows = pack(frame, 100).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(400))
    used = len({r["sequence_id"] for r in rows})
    alone = sum(len(best_fit(np.array(lengths[i::10]), 100)[2]) for i in range(10))
    assert lower_bound(np.array(lengths), 100) <= used < alone


def test_sequences_hold_the_ids(spark):
    found = pieces(documents(spark), WORDS, 64, 1, with_ids=True)
    made = sequences(pack(found, 64), 64).collect()
    assert sum(len(r["ids"]) for r in made) == sum(r["length"] for r in found.collect())
    assert all(0 < len(r["ids"]) <= 64 for r in made)


def test_bounds_and_best_fit():
    assert lower_bound(np.array([60, 60, 60]), 100) == 3      # threshold function
    assert lower_bound(np.array([34, 34, 34, 34]), 100) == 2  # rounding function
    bins, offsets, fill = best_fit(np.array([50, 30, 70, 50]), 100)
    assert sorted(fill.tolist()) == [100, 100] and bins[0] == bins[3] and bins[1] == bins[2]
    assert offsets.min() == 0

"""Cross-tokenizer alignment against its definition, token by token."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from support import ODD, documents, text

import public_tokenizers
from treegauge.llm import alignment as A

PATH_A, PATH_B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
HARD = [(20, "<|endoftext|> inside <s> x</s>  two\n\nlines\t \n end "), (21, " leading"), (22, "\n"), (23, " "),
        (24, "a▁b is ambiguous"), (25, "nul \0 byte, nul\0 again"), (26, "tab\tcr\r\nx　y z \x1c q"),
        (27, "Zx9" * 900), (28, text(4, 700)), (29, text(4, 700)), (None, "twice"), (None, "twice"),
        (31, "émoji 🙂🙂 ﬁ²"), (32, "\r\r x ();\r\n")]


def by_definition(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    letters = {chr(i): i for i in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + k): i for k, i in enumerate(i for i in range(256) if i not in letters.values())}
    docs = []
    for doc_id, t in rows:
        groups = []
        if t:
            ids_a = a.encode(" " + t, add_special_tokens=False).ids
            ids_b = b.encode(t)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else
                       b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
                begin_a = begin_b = 0
                for cut in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
                    i, j = int(np.searchsorted(ends_a, cut)) + 1, int(np.searchsorted(ends_b, cut)) + 1
                    groups.append((ids_a[begin_a:i], ids_b[begin_b:j]))
                    begin_a, begin_b = i, j
        docs.append((doc_id, groups, Counter((x, y) for g, h in groups for x in g for y in h)))
    counts = Counter(p for _, _, links in docs for p in links)
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for doc_id, groups, links in docs:
        written = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc_id, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups),
                    sum(links.values()), sum(n for p, n in links.items() if counts[p] == most[p[0]]),
                    sum(n * counts[p] for p, n in links.items()),
                    hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket, part, links", [(A.BUCKET, A.PART, A.LINKS), (300, 500, 64)])
def test_like_the_definition(spark, rows, monkeypatch, bucket, part, links):
    """Also with many buckets and shares, and with groups too large to write out."""
    for name, value in (("BUCKET", bucket), ("PART", part), ("LINKS", links)):
        monkeypatch.setattr(A, name, value)
    given = ODD + HARD
    assert rows(A.alignment(documents(spark, given), PATH_A, PATH_B)) == by_definition(given)


def test_the_query(spark, rows, tmp_path):
    given = ODD + HARD[:4]
    documents(spark, given).write.parquet(str(tmp_path / "documents.parquet"))
    found = A.op12_alignment(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(found) == by_definition(given)


def test_no_rows(spark, rows):
    assert rows(A.alignment(documents(spark, []), PATH_A, PATH_B)) == []


def test_lockstep_merge_meets_every_common_end():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = [int(n) for n in rng.integers(1, 60, rng.integers(1, 9))]
        ends_a, ends_b, first_a, first_b, last_a = [], [], [], [], []
        at = 0
        for n in lengths:
            a = np.flatnonzero(rng.random(n) < 0.5) + 1
            b = np.flatnonzero(rng.random(n) < 0.5) + 1
            first_a.append(len(ends_a))
            first_b.append(len(ends_b))
            ends_a += [at + e for e in sorted({*a.tolist(), n})]
            ends_b += [at + e for e in sorted({*b.tolist(), n})]
            last_a.append(len(ends_a))
            at += n
        cut_a, cut_b = A.merged(*map(np.array, (ends_a, ends_b, first_a, first_b, last_a)))
        common = sorted(set(ends_a) & set(ends_b))
        assert [ends_a[i] for i in cut_a] == [ends_b[i] for i in cut_b] == common


def test_packed_numbers_come_back():
    for values in (np.zeros(0, np.int64), np.array([0, 1, 2**40, 2**62])):
        assert A.unpacked(A.packed(values)).tolist() == values.tolist()

"""Token counts: texts are cut where the tokenizer cuts anyway, encoded in batches of equal
bytes inside an Arrow function, and only lengths come back."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches, texts_of
from .pieces import loaded

#: White space next to a space or line feed; without it, both always stand alone.
_RUN = re.compile(r"\s[ \n]|[ \n]\s")
#: A byte-level pattern with an optional leading space never reaches over these places:
#: no alternative that takes a visible character takes white space after it.
_EDGE = re.compile(r"(?<=\S)(?=[ \t\r\n])")


def safe_pieces(text: str) -> tuple[list[str], int]:
    """Pieces whose tokens are those of the whole text, and line feeds that stand beside them.

    Every piece begins before white space that follows a visible character, so
    it is a word with the white space before it.  A text that is one endless
    word stays one piece: nothing inside it is safe to cut.
    """
    if _RUN.search(text):
        return _EDGE.split(text), 0
    return text.replace(" ", "\n ").split("\n"), text.count("\n")


def token_counts(docs: DataFrame, path: str, text: str = "text", counted: str = "n_tokens",
                 size: str = "n_bytes") -> DataFrame:
    """`docs` without `text`, with the UTF-8 bytes and the number of tokens of the text.

    No begin, end or added tokens, no truncation; special strings inside a
    text are one token, as the library's default has it.  Null and empty texts
    count 0 and 0.  Rows are never merged or dropped: repeated rows repeat.
    Columns of `docs` named like a result are left out.  `path` is a
    byte-level vocabulary whose pattern keeps a space with the word after it.
    """
    kept = [c for c in docs.columns if c not in (text, counted, size)]
    schema = docs.select(*kept).schema
    ddl = ", ".join("`%s` %s" % (f.name.replace("`", "``"), f.dataType.simpleString())
                    for f in schema)
    ddl = (ddl + ", " if ddl else "") + "`%s` bigint, `%s` bigint" % (size, counted)

    def work(columns: dict, known) -> dict:
        texts = texts_of(columns[text])
        pieces: list[str] = []
        sizes, feeds = [], []
        for t in texts:
            own, lines = safe_pieces(t)
            pieces += own
            sizes.append(len(own))
            feeds.append(lines)
        counts = known.lengths_of(pieces + ["\n"])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.concatenate([[0], np.cumsum(counts[:-1])])
        tokens = sums[edges[1:]] - sums[edges[:-1]] + np.array(feeds, np.int64) * counts[-1]
        n_bytes = [len(t) for t in columns[text].cast(pa.binary()).fill_null(b"").to_pylist()]
        return {**{c: columns[c] for c in kept}, size: n_bytes, counted: tokens}

    return batches(docs.select(*kept, text), work, ddl, lambda: loaded(path), text)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn(
        "over_limit", F.col("n_tokens") > 1024)

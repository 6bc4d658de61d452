"""Chunks, vectors and semantic search.  Vectors are keyed on content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F

from .. import Refused
from ..functions import text as X
from ..functions.vectors import cosine_to
from ..joins import lookup
from ..schemas import VECTORS

CHUNKING = "%d/%d" % (X.CHUNK_CHARS, X.CHUNK_OVERLAP)

# Query matrices up to this many bytes travel with each task.
QUERY_BLOCK_BYTES = 8 << 20


def _readable(content: DataFrame) -> DataFrame:
    return content.filter(F.col("text").isNotNull() & F.col("sha256").isNotNull())


def _one_path(content: DataFrame) -> DataFrame:
    """One path per distinct content, from narrow columns only."""
    return _readable(content).groupBy("sha256").agg(F.min("path").alias("path"))


def chunks(content: DataFrame) -> DataFrame:
    """`sha256, ord, chunk`: one set per distinct content, blanks not counted.

    Which copy speaks for a hash is decided on (hash, path); the text is then
    picked by a semi-join and never grouped.
    """
    texts = _readable(content).join(_one_path(content), ["sha256", "path"], "left_semi")
    return texts.select("sha256", F.posexplode(X.chunk_pieces("text")).alias("ord", "chunk"))


def chunk_keys(content: DataFrame) -> DataFrame:
    """`sha256, ord` wanted by the content, without moving any text."""
    sized = (_readable(content)
             .select("sha256", F.size(X.chunk_pieces("text")).alias("n"))
             .groupBy("sha256").agg(F.max("n").alias("n")).filter(F.col("n") > 0))
    return sized.select("sha256", F.explode(F.sequence(F.lit(0), F.col("n") - F.lit(1)))
                        .alias("ord"))


def maintenance(wanted: DataFrame, have: DataFrame, same_chunking: bool = True) -> DataFrame:
    """`sha256, ord, action`: embed, keep or drop.

    When the chunk boundaries changed, a key that still exists names another
    text, so every vector is dropped and every wanted key embedded again.
    """
    w = wanted.select("sha256", "ord", F.lit(True).alias("w"))
    if not same_chunking:
        return (w.select("sha256", "ord", F.lit("embed").alias("action"))
                .unionByName(have.select("sha256", "ord", F.lit("drop").alias("action"))))
    h = have.select("sha256", "ord", F.lit(True).alias("h"))
    return w.join(h, ["sha256", "ord"], "full_outer").select(
        "sha256", "ord", F.when(F.col("h").isNull(), F.lit("embed"))
        .when(F.col("w").isNull(), F.lit("drop")).otherwise(F.lit("keep")).alias("action"))


def maintenance_tally(actions: DataFrame) -> DataFrame:
    return actions.agg(
        F.count_if(F.col("action") == "embed").alias("embedded"),
        F.count_if(F.col("action") == "keep").alias("reused"),
        F.count_if(F.col("action") == "drop").alias("removed"),
        F.count_if(F.col("action") != "drop").alias("chunks"))


def encode(pieces: DataFrame, load_model: Callable[[], Callable[[str], list[float]]],
           dim: int) -> DataFrame:
    """`sha256, ord, vector` for `sha256, ord, chunk`.

    `load_model` runs once per task and returns a function from one chunk to
    one vector; chunks are encoded one at a time on purpose.
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            vectors = [list(map(float, model(piece))) for piece in batch["chunk"]]
            for vector in vectors:
                if len(vector) != dim:
                    raise ValueError("the model gives %d values, not %d"
                                     % (len(vector), dim))
            yield pd.DataFrame({"sha256": batch["sha256"], "ord": batch["ord"],
                                "vector": vectors})

    return pieces.select("sha256", "ord", "chunk").mapInPandas(run, VECTORS)


def hashing_model(dim: int = 384) -> Callable[[], Callable[[str], list[float]]]:
    """A deterministic stand-in where no trained model is at hand.

    Words are hashed to signed dimensions and the sum is normalised.
    """
    def load():
        import hashlib
        import math
        import re

        def encode_one(piece: str) -> list[float]:
            out = [0.0] * dim
            for word in re.findall(r"\w+", piece.lower()):
                digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
                slot = int.from_bytes(digest, "little")
                out[(slot >> 1) % dim] += 1.0 if slot & 1 else -1.0
            norm = math.sqrt(sum(v * v for v in out)) or 1.0
            return [v / norm for v in out]
        return encode_one
    return load


def update_vectors(content: DataFrame, vectors: DataFrame, load_model, dim: int,
                   same_chunking: bool = True) -> DataFrame:
    """The next vector layer: kept ones plus new ones, orphans gone."""
    if not same_chunking:
        return encode(chunks(content), load_model, dim)
    keys = ["sha256", "ord"]
    wanted = chunk_keys(content)
    kept = vectors.join(wanted, keys, "left_semi")
    todo = wanted.join(vectors.select(*keys), keys, "left_anti")
    # On a second run almost nothing is left to do, and then the texts to
    # read are picked by a small side before any of them moves.
    owners = _one_path(content).join(todo.select("sha256").distinct(), "sha256", "left_semi")
    texts = _readable(content).join(owners, ["sha256", "path"], "left_semi")
    pieces = (texts.select("sha256", F.posexplode(X.chunk_pieces("text"))
                           .alias("ord", "chunk"))
              .join(todo, keys, "left_semi"))
    return kept.select(*keys, "vector").unionByName(encode(pieces, load_model, dim))


def coverage(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """`embedded, expected` chunks."""
    h = have.select("sha256", "ord").distinct().withColumn("h", F.lit(True))
    return wanted.join(h, ["sha256", "ord"], "left").agg(
        F.count("h").alias("embedded"), F.count(F.lit(1)).alias("expected"))


def check_dim(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of another width; comparing them would be meaningless."""
    return vectors.filter(F.size("vector") != dim)


def check_model(recorded: dict[str, str], model: str, dim: int) -> None:
    """Refuse a store that was embedded by something else."""
    if recorded.get("embed_model") not in (None, "", model):
        raise Refused("the vectors come from %s, not %s"
                      % (recorded["embed_model"], model))
    if recorded.get("embed_dim") not in (None, "", str(dim)):
        raise Refused("the vectors have %s dimensions, the model gives %d"
                      % (recorded["embed_dim"], dim))


def best_chunks(vectors: DataFrame, query: list[float]) -> DataFrame:
    """`sha256, score, ord`: the best chunk of each content, lowest on ties."""
    return (vectors.select("sha256", "ord", cosine_to(F.col("vector"), query).alias("score"))
            .groupBy("sha256").agg(F.max("score").alias("score"),
                                   F.min_by("ord", F.struct(-F.col("score"), "ord"))
                                   .alias("ord")))


def search(vectors: DataFrame, content: DataFrame, query: list[float],
           limit: int = 10) -> DataFrame:
    """Exact cosine over all vectors: `path, score, ord`, best first."""
    paths = content.filter(F.col("sha256").isNotNull()).select("sha256", "path")
    return (lookup(paths, best_chunks(vectors, query), ["sha256"], "inner")
            .select("path", "score", "ord")
            .orderBy(F.desc("score"), "path").limit(limit))


def search_many(vectors: DataFrame, queries: DataFrame, depth: int = 50) -> DataFrame:
    """`qid, sha256, score`: at least the `depth` best contents per query.

    `queries(qid, vector)`.  A block of queries of bounded size travels with
    each task, one matrix product per batch.  A task keeps its best `depth`
    rows per query (all rows equal to the last one included), so a pair that
    can be among the best is never lost and all others never leave the task.
    Query sets beyond one block take one pass per block.
    """
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    parts = []
    for ids, matrix in _query_blocks(queries):
        shared = spark.sparkContext.broadcast((ids, matrix))

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, wanted = shared.value
            kept_sha, kept = [np.array([], dtype=object)] * len(ids), \
                [np.array([], dtype="f8")] * len(ids)
            for batch in batches:
                if not len(batch):
                    continue
                block = np.stack(batch["vector"].to_numpy()).astype("f8")
                norms = np.sqrt((block * block).sum(1))
                block = np.divide(block, norms[:, None], out=np.zeros_like(block),
                                  where=norms[:, None] > 0)
                scores = block @ wanted.T
                shas = batch["sha256"].to_numpy()
                for q in range(len(ids)):
                    s = np.concatenate([kept[q], scores[:, q]])
                    names = np.concatenate([kept_sha[q], shas])
                    # Chunks of one content count once, at their best.
                    order = np.argsort(-s, kind="stable")
                    _, first = np.unique(names[order].astype(str), return_index=True)
                    pick = order[np.sort(first)]
                    s, names = s[pick], names[pick]
                    if len(s) > depth:
                        keep = s >= s[depth - 1]
                        s, names = s[keep], names[keep]
                    kept[q], kept_sha[q] = s, names
            for q, qid in enumerate(ids):
                if len(kept[q]):
                    yield pd.DataFrame({"qid": qid, "sha256": kept_sha[q], "score": kept[q]})

        parts.append(vectors.select("sha256", "vector").mapInPandas(
            score, "qid bigint, sha256 string, score double"))
    if not parts:
        return spark.createDataFrame([], "qid bigint, sha256 string, score double")
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    return best.groupBy("qid", "sha256").agg(F.max("score").alias("score"))


def _query_blocks(queries: DataFrame):
    """Query vectors in blocks of bounded size, streamed to the driver."""
    import numpy as np

    ids, rows, used = [], [], 0
    for row in queries.select("qid", "vector").orderBy("qid").toLocalIterator():
        ids.append(row["qid"])
        rows.append(row["vector"])
        used += 8 * len(row["vector"])
        if used >= QUERY_BLOCK_BYTES:
            yield ids, _unit(np.asarray(rows, dtype="f8"))
            ids, rows, used = [], [], 0
    if ids:
        yield ids, _unit(np.asarray(rows, dtype="f8"))


def _unit(matrix):
    import numpy as np

    norms = np.sqrt((matrix * matrix).sum(1))[:, None]
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

"""Groups of near copies by SimHash, linked through BK-trees.

1. Each text's fingerprint: one Arrow pass, nothing shuffled but 16 bytes a text.
2. Distinct fingerprints, so that any number of exact copies is one node of the search.
3. Two fingerprints that differ in at most r bits agree on at least one of r + 1 blocks of bits. Every
   fingerprint therefore goes to r + 1 shards, dealt by block and block value, and a shard's BK-tree has all
   partners that agree on that block. Shards hold a bounded number of fingerprints. Where one block value
   alone has more, its fingerprints are dealt over several trees, and each tree is searched for those of the
   others a bounded number at a time.
   The trees are met by their queries through this shuffle and are not broadcast from the driver: together
   they grow with the input.
4. A shard returns a spanning forest of the links it found, not the pairs. The links of all shards give
   connected components, and each component the smallest id of its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tillroll.llm.bktree import BITS, BKTree
from tillroll.llm.components import connected
from tillroll.llm.texts import identified, map_batches, raw_texts, spread
from tillroll.session import stored

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
SHARD = 4096
_ROWS = 255  # rows of bits that a byte can count


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of size words joined by spaces; of the whole sequence where it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; zero without hashes."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 256 * _ROWS):
        part = hashes[start : start + 256 * _ROWS].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // _ROWS * _ROWS
        if whole:
            sums = np.add.reduce(bits[:whole].reshape(-1, _ROWS, BITS), axis=1, dtype=np.uint8)
            counts += sums.sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints_of(column: pa.Array, shingle_words: int) -> pa.Array:
    """Signed 64-bit fingerprints of an Arrow column of texts."""
    found = [simhash(shingle_hashes(raw.lower().split(), shingle_words)) for raw in raw_texts(column)]
    return pa.array(np.array(found, np.uint64).view(np.int64))


def with_fingerprints(docs: DataFrame, text: str, name: str, shingle_words: int) -> DataFrame:
    """docs with one more column, the fingerprint of the text as a long."""
    at = docs.columns.index(text)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column(name, fingerprints_of(batch.column(at), shingle_words))

    return map_batches(docs, step, docs.select("*", F.lit(0).cast("long").alias(name)).schema)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """The first bit and the width of each of radius + 1 blocks."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _forest(values: np.ndarray, members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints linked within the radius of a member: the fingerprint and the first of its group.

    The members are a tree. The others look for them; where there are no others, the members do.
    """
    tree = BKTree(values[members], radius)
    place = np.flatnonzero(members)
    asking = place if members.all() else np.flatnonzero(~members)
    parent = np.arange(len(values))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for asked, nodes in tree.search(values[asking]):
        a, b = asking[asked], place[nodes]
        while True:
            up_a, up_b = parent[a], parent[b]
            if (up_a == a).all() and (up_b == b).all():
                break
            a, b = up_a, up_b
        apart = a != b
        for x, y in np.unique(np.stack([a[apart], b[apart]], axis=1), axis=0).tolist():
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(values))], np.int64)
    linked = np.flatnonzero(roots != np.arange(len(values)))
    return values[linked], values[roots[linked]]


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links that connect all fingerprints (column fp, each once) within the radius of each other."""
    count = distinct.count()
    shards = spread(distinct.sparkSession, count * (radius + 1), shard)
    value: list[Column] = [
        F.struct(
            F.lit(i).alias("block"),
            F.shiftrightunsigned("fp", first).bitwiseAND((1 << width) - 1).alias("value"),
        )
        for i, (first, width) in enumerate(_blocks(radius))
    ]
    keyed = distinct.select("fp", F.explode(F.array(*value)).alias("k")).select("fp", "k.block", "k.value")
    # Where one value has more than a shard, a fingerprint is in the tree of its own piece and asks the others'.
    crowded = keyed.groupBy("block", "value").count().where(F.col("count") > shard)
    crowded = crowded.select("block", "value", F.ceil(F.col("count") / shard).cast("int").alias("pieces"))
    keyed = keyed.join(crowded, ["block", "value"], "left")
    alone = F.col("pieces").isNull()
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.coalesce("pieces", F.lit(1))).cast("int")
    digest = F.xxhash64("block", "value")
    dealt = keyed.select(
        "fp",
        F.when(alone, F.pmod(digest, F.lit(shards))).otherwise(digest).alias("shard"),
        own.alias("own"),
        F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("other"),
    )
    # Links go both ways, so that of two pieces the later one asks the earlier one's tree.
    asked = dealt.select(
        "fp",
        "shard",
        F.least("own", "other").alias("tree"),
        F.greatest("own", "other").alias("asking"),
        (F.col("own") <= F.col("other")).alias("member"),
    )

    def search(key, table):
        table = table.group_by("fp").aggregate([("member", "max")])
        values = table["fp"].to_numpy()
        member = table["member_max"].to_numpy(zero_copy_only=False).astype(bool)
        # A piece whose tree is empty here has nobody to link.
        a, b = _forest(values.view(np.uint64), member, radius) if member.any() else (values[:0], values[:0])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return asked.groupBy("shard", "tree", "asking").applyInArrow(search, "a long, b long")


def near_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    shard: int = SHARD,
) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    A null or empty text has fingerprint zero, and links like any other. Rows with equal ids each appear.
    component_id is the smallest id in reach, null ids left out; it is null where only null ids are in reach.
    Texts of any length are read whole. An empty table gives an empty table.
    """
    source = identified(docs, doc_id, text)
    prints = stored(with_fingerprints(source, "text", "fp", shingle_words).select("doc_id", "fp"), "fingerprints")
    return grouped(prints, radius, shard)


def grouped(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp)."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected(links(distinct.select("fp"), radius, shard)).withColumnRenamed("node", "fp")
    # Only linked fingerprints have a root; the others are their own component.
    linked = distinct.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = linked.select("fp", "root").join(least, "root").select("fp", "component_id", F.lit(True).alias("linked"))
    every = distinct.join(known, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id")
    )
    return prints.join(every, "fp").select("doc_id", "fp", "component_id")


def first_of_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
) -> DataFrame:
    """One row of docs for each component, with the columns of docs.

    It is the row with the smallest id; a row with a null id stays only where its component has no other. Of
    several rows with that id, the smallest fingerprint, then the smallest text stays.
    """
    mark = "fp_" + "_".join(docs.columns)  # no column has this name
    prints = stored(with_fingerprints(docs, text, mark, shingle_words), "documents")
    groups = grouped(prints.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(mark).alias("fp")), radius)
    # One row of few bytes for each component. Its null id sorts last.
    first = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("first")
    )
    first = first.select(F.col("first.doc_id").alias("first_id"), F.col("first.fp").alias("first_fp"))
    chosen = F.col(f"`{doc_id}`").eqNullSafe(F.col("first_id")) & (F.col(mark) == F.col("first_fp"))
    kept = prints.join(first, chosen, "left_semi")
    same = Window.partitionBy(mark, f"`{doc_id}`").orderBy(F.col(f"`{text}`"))
    row = "row_" + mark
    return kept.withColumn(row, F.row_number().over(same)).where(F.col(row) == 1).drop(mark, row)

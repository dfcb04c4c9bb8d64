"""The near-duplicate operator for a similarity of 0.8 or more on five-word shingles: SimHash blocks and MinHash bands propose, the shingles themselves decide.

SimHash at a few bits reaches near copies of a similarity of 0.95 and more. At 0.8 two fingerprints differ in 9.7 of 64 bits on average: pigeonhole blocks of 16
bits would need 92 keys a text for a recall of 0.999, each shared by one in 65,536 of all texts, which no large corpus bears. So a second proposer
stands beside the fingerprints, and both are verified.

Texts of equal shingle sets are one node from the start. Fingerprints propose the links of ``simhash.links``, one node for each fingerprint, and its other nodes to that one. A node is also dealt
out under ``BANDS`` keys of ``ROWS`` minima each: a pair of similarity s shares one with a chance of 1 - (1 - s**5)**20, which is 0.9996 at 0.8. Within a key nodes
are first verified against one of them, those only that share ``ALIKE`` keys with it. This settles groups of near copies at a row for each member.

What is then open, nodes whose keys hold nodes that verified links do not connect yet, goes through an exact set-similarity join over shingles: rarest shingles first, by
how many of the open nodes have them, prefix, length and positional filters, then verification. Texts of one template that are less similar than asked share their
common shingles only, so they do not meet: a key costs no pairs for its size, and no pair above the threshold is left out.

Texts are lower-cased (A-Z). One of five words or fewer is a single shingle; null and texts without words are equal to each other. Texts are taken whole, their minima
in bounded pieces. Rows without an id stay. Repeated rows are one node, and as their ids are equal all of them stay or go. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import materialise, slices, utf8
from kerbside.llm.simhash import SEED, components, links as simhash_links, without_later

SHINGLE, NUM, DEN = 5, 4, 5
BANDS, ROWS = 20, 5
_drawn = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
TIMES, PLUS = _drawn[0] | np.uint64(1), _drawn[1]
#: Keys that two nodes share from which on they are verified at once; others wait for the join. Two of a similarity of 0.8 share 6.6 on average.
ALIKE = 4
#: Buckets of shingles whose frequency among open nodes is counted: a table of fixed size, a byte each in the tasks.
BUCKETS = 1 << 20
#: Shingles whose minima are taken at once; bounds memory for very long texts.
HASHED_AT_ONCE = 1 << 11


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, one at least."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and exactly \x20 \x09-\x0D
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = len(words) - SHINGLE + 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())), np.uint64, n))


def node_of(found: np.ndarray) -> int:
    """A shingle set's hash."""
    return xxhash.xxh3_64_intdigest(found.tobytes())


def fingerprint_of(found: np.ndarray) -> int:
    """The SimHash of a shingle set: bit i is set if it is set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), HASHED_AT_ONCE):
        some = found[at : at + HASHED_AT_ONCE]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(found), bitorder="little").tobytes(), "little")


def band_keys(found: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), HASHED_AT_ONCE):
        least = np.minimum(least, (found[at : at + HASHED_AT_ONCE] * TIMES + PLUS).min(axis=1))
    return [xxhash.xxh3_64_intdigest(x.tobytes()) for x in least.reshape(BANDS, ROWS)]


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, node, fp, bands): h is a hash of the text, fp the fingerprint."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t) for t in utf8(part.column(1)).to_pylist()]
                keys = _signed([k for s in sets for k in band_keys(s)])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), keys)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), _signed([node_of(s) for s in sets]), _signed([fingerprint_of(s) for s in sets]), bands], names=["id", "h", "node", "fp", "bands"])

    return docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"), F.xxhash64(docs[f"`{text_col}`"]).alias("h")).mapInArrow(run, "id long, h long, node long, fp long, bands array<long>")


def shingle_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(node, found: its sorted shingles as signed longs) of the nodes wanted (node), written."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t) for t in utf8(part.column(0)).to_pylist()]
                cuts = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32())
                yield pa.RecordBatch.from_arrays([_signed([node_of(s) for s in sets]), pa.ListArray.from_arrays(cuts, _signed(np.concatenate(sets)))], names=["node", "found"])

    needed = nodes.join(wanted.distinct(), "node").select(F.col("h").alias("__h"))
    texts = docs.select(docs[f"`{text_col}`"].alias("text"), F.xxhash64(docs[f"`{text_col}`"]).alias("__h")).join(needed, "__h").groupBy("__h").agg(F.first("text").alias("text"))
    return materialise(texts.select("text").mapInArrow(run, "node long, found array<long>"), "minhash-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingles have the similarity asked for."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    same = both.withColumn("same", F.size(F.array_intersect("x", "y")))
    return same.filter(F.col("same") * DEN >= (F.size("x") + F.size("y") - F.col("same")) * NUM).select("a", "b")


def _octaves(sets: DataFrame) -> np.ndarray:
    """For each bucket of shingles the octave of how often its shingles stand in the sets."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False) & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    counts = sets.select("found").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    few = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("octave")).agg(F.collect_list("bucket").alias("buckets"))
    out = np.zeros(BUCKETS, np.uint8)
    for octave, buckets in few.collect():  # BUCKETS numbers at most
        out[buckets] = octave
    return out


def prefix_join(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b), a > b: pairs of nodes of different roots (node, root) that may have the similarity asked for; sets: (node, found)."""
    held = sets.sparkSession.sparkContext.broadcast(_octaves(sets))

    def prefixes(batches):
        octaves = held.value
        for batch in batches:
            for part in slices(batch):
                nodes, at, token, size = part.column(0).to_numpy(), [], [], []
                for found in part.column(1):
                    s = found.values.to_numpy(zero_copy_only=False)
                    n = len(s)
                    rare = np.lexsort((s, octaves[s & (BUCKETS - 1)]))[: n - -(-n * NUM // DEN) + 1]
                    token.append(s[rare])
                    at.append(np.arange(len(rare)))
                    size.append(n)
                many = [len(x) for x in token]
                columns = [np.repeat(nodes, many), np.repeat(size, many), np.concatenate(at), np.concatenate(token)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "n", "pos", "token"])

    rows = materialise(sets.mapInArrow(prefixes, "node long, n long, pos long, token long").join(roots, "node"), "minhash-prefixes")
    x, y = rows.alias("x"), rows.alias("y")
    c = F.col
    overlap = F.ceil((c("x.n") + c("y.n")) * NUM / (NUM + DEN))
    condition = (
        (c("x.token") == c("y.token"))
        & ((c("x.n") < c("y.n")) | (c("x.n") == c("y.n")) & (c("x.node") < c("y.node")))  # the shorter one is indexed by its shorter prefix
        & (c("x.n") * DEN >= c("y.n") * NUM)
        & (c("x.pos") < c("x.n") - F.ceil(c("x.n") * (2 * NUM) / (NUM + DEN)) + 1)
        & (F.least("x.pos", "y.pos") + F.least(c("x.n") - c("x.pos"), c("y.n") - c("y.pos")) >= overlap)
        & (c("x.root") != c("y.root"))
    )
    return x.join(y, condition).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def first_pairs(nodes: DataFrame, dealt: DataFrame) -> DataFrame:
    """(a, b), a > b: of each key's nodes those that share ``ALIKE`` keys with its first, and the links of fingerprints."""
    near = dealt.filter("node <> first").groupBy(F.col("node").alias("a"), F.col("first").alias("b")).agg(F.count("*").alias("n")).filter(F.col("n") >= ALIKE)
    by_print = nodes.groupBy("fp").agg(F.min("node").alias("b"))
    links = simhash_links(by_print.select(F.col("b").alias("node"), "fp"))
    same = nodes.join(by_print, "fp").filter("node <> b").select(F.col("node").alias("a"), "b")
    every = near.select("a", "b").unionByName(links.select("a", "b")).unionByName(same)
    return every.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, component_id (smallest id reachable over links), text_hash."""
    rows = materialise(keyed(docs, id_col, text_col), "minhash-rows")
    nodes = materialise(rows.groupBy("node").agg(F.min("id").alias("low"), F.min("h").alias("h"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "minhash-nodes")
    dealt = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = dealt.groupBy("band", "key").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    dealt = materialise(dealt.join(shared, ["band", "key"]), "minhash-dealt")
    tried = materialise(first_pairs(nodes, dealt), "minhash-first")
    links = materialise(verified(tried, shingle_sets(ends(tried), nodes, docs, text_col)), "minhash-links")
    roots = components(links, "minhash-stars")
    rooted = materialise(dealt.join(roots, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("root")), "minhash-rooted")
    parted = rooted.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band", "key")
    left = materialise(rooted.join(parted, ["band", "key"]).select("node", "root").distinct(), "minhash-open")
    if left.count():
        sets = shingle_sets(left.select("node"), nodes, docs, text_col)
        cross = materialise(prefix_join(sets, left).join(tried, ["a", "b"], "left_anti"), "minhash-others")
        links = materialise(links.unionByName(verified(cross, sets)), "minhash-all")
        roots = components(links, "minhash-components")
    members = nodes.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = members.groupBy("root").agg(F.min("low").alias("component_id"))
    known = members.join(lowest, "root").select("node", "component_id")
    return rows.join(known, "node").select(F.col("id").alias(id_col), "component_id", F.col("h").alias("text_hash"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """docs without the rows whose component has a smaller id; rows without an id stay. Columns pass through, whatever their names."""
    return without_later(docs, similar(docs, id_col, text_col), id_col, text_col, broadcast_rows)

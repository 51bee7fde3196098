"""Near-duplicate documents by min-max hashing, links confirmed on the word sets themselves.

1. A document's set of 5-word shingles, from keyed 128-bit hashes of its words, becomes a fingerprint of the whole set, and under each of 80
   permutations its minimum and its maximum: 160 values from 80 hash evaluations a shingle.
2. Documents of one fingerprint form a class; its smallest id stands for it from here on, so
   thousands of copies are one row.
3. 40 bands of two minima and two maxima: at similarity s a pair meets in a band with s^4, so at
   0.75 all bands miss it once in 4 million pairs. Pairs that meet in a band are candidates; no estimate decides about one.
4. Star: each member of a bucket is paired with the bucket's smallest id only. Pairs whose set sizes allow a
   link are verified on their texts: sets of word tuples, without any hash. Links are contracted.
5. The rest, without a cap: where the buckets of a component still hold several components, their members
   are compared in blocks of bounded size, those of like set sizes only, and there those that share a band. What is linked already is not
   compared, and only links that join components leave a block, fewer than it has members.

Hash joins and aggregates carry narrow rows; a hot bucket's join is split by adaptive execution.
No step collects documents, links or components to the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import fresh, materialize, slices
from tracewell.llm.words import IS_SPACE, mix

SHINGLE = 5
PERMUTATIONS, BANDS = 80, 40
#: Ids, and bytes of text, in a block of stage 5 (a longer text is a block of its own); two blocks are in memory at once.
BLOCK, BLOCK_BYTES = 250, 2 << 20

_RNG = np.random.Generator(np.random.PCG64(20_240_229))
_KEY = _RNG.bytes(32)
_PLACE = _RNG.integers(0, 2**63, (SHINGLE, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 2**63, (BANDS, 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 20
_SALT = _RNG.integers(0, 2**63, (2, 3), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of raw begins, and its keyed 128-bit hash as two 64-bit lanes.

    A word of up to 16 bytes is two whole numbers, mixed with the key; a longer one goes through BLAKE2b first.
    """
    data = np.frombuffer(raw.lower() + bytes(16), np.uint8)
    inside = ~IS_SPACE[data]
    inside[-16:] = False
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = ends - starts
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the 8 bytes from each place on
    one, two = eight[starts] & _MASK[np.minimum(size, 8)], eight[starts + 8] & _MASK[np.clip(size - 8, 0, 8)]
    long = np.flatnonzero(size > 16)
    if len(long):
        whole = b"".join(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=16, key=_KEY).digest() for k in long)
        one[long], two[long] = np.frombuffer(whole, "<u8").reshape(-1, 2).T
    lanes = np.empty((len(starts), 2), np.uint64)
    for k in (0, 1):
        lanes[:, k] = mix(mix(mix(one + _SALT[k, 0]) ^ (two + _SALT[k, 1])) + size.astype(np.uint64) * _SALT[k, 2])
    return starts, lanes


def split_words(raw: bytes) -> list[bytes]:
    """Words end at space and tab to carriage return; A-Z are lower-cased. bytes.lower and bytes.split do just that."""
    return raw.lower().split()


def _chunks(raw: bytes):
    """raw in parts of about _CHUNK bytes that end at white space."""
    at = 0
    while at < len(raw):
        stop = min(at + _CHUNK, len(raw))
        while stop < len(raw) and not IS_SPACE[raw[stop]]:
            stop += 1
        yield raw[at:stop]
        at = stop


def _shingles(words: np.ndarray) -> tuple[np.ndarray, bytes | None]:
    """words: lanes of a text's words. Its distinct shingles as sorted 64-bit hashes, made of both lanes, and a 128-bit fingerprint of the set."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), None
    k, m = (n, 1) if n < SHINGLE else (SHINGLE, n - SHINGLE + 1)
    total = words[:m] * _PLACE[0]
    for i in range(1, k):
        total += words[i : i + m] * _PLACE[i]
    total += np.uint64(k)
    distinct = np.unique(mix(total[:, 0] ^ mix(total[:, 1])))
    return distinct, hashlib.blake2b(distinct.tobytes(), digest_size=16, key=_KEY).digest()


def hashed_sets(texts: list[str | None]) -> list[tuple[np.ndarray, bytes | None]]:
    """Of each text: its distinct shingles as sorted 64-bit hashes, and the fingerprint of the set."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = []
    for i, j in slices(list(map(len, raw)), _CHUNK):
        if j == i + 1:
            parts = [word_hashes(part)[1] for part in _chunks(raw[i])]
            out.append(_shingles(np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)))
            continue
        starts, lanes = word_hashes(b" ".join(raw[i:j]))
        first = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw[i:j])]))
        out += [_shingles(lanes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def word_set(text: str | None) -> set[tuple[bytes, ...]]:
    """The set itself: distinct tuples of five words, or the whole sequence if it has fewer."""
    w = split_words((text or "").encode("utf-8", "surrogatepass"))
    if len(w) < SHINGLE:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(SHINGLE))))


def linked(one: set, two: set, percent: int) -> bool:
    """Empty sets are linked with nothing."""
    common = len(one & two)
    return common > 0 and 100 * common >= percent * (len(one) + len(two) - common)


def min_max(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation: row 0 and row 1."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 2048):
        turned = shingles[at : at + 2048, None] * _TURN
        np.minimum(low, turned.min(0), out=low)
        np.maximum(high, turned.max(0), out=high)
    return np.stack([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key per band of the minima and maxima of two permutations."""
    four = values.reshape(2, BANDS, 2).transpose(1, 0, 2).reshape(BANDS, 4)
    return mix((mix(four) * _BAND).sum(axis=1, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (size of the set), fp (128 bits of the whole set), bands (40 keys); the last two null for an empty set."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for i, j in slices([len(t or "") for t in texts], _CHUNK):
                sets = hashed_sets(texts[i:j])
                n, fp = [len(s) for s, _ in sets], [f for _, f in sets]
                bands = [band_keys(min_max(s)) if len(s) else None for s, _ in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "fp", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id long, n long, fp binary, bands array<long>")


def _confirm(percent: int):
    """Over rows a, text of a, b, text of b: the pairs (a, b) whose word sets are alike. Rows come by b, whose set is kept."""

    def run(batches):
        held, kept = None, set()
        for batch in batches:
            a, ta, b, tb = (batch.column(k) for k in range(4))
            keep = []
            for k in range(batch.num_rows):
                key = (b[k].as_py(), tb[k].as_py())
                if key != held:
                    held, kept = key, word_set(key[1])
                keep.append(linked(word_set(ta[k].as_py()), kept, percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose word sets overlap by at least percent of their union. sizes: id, n; texts: id, text."""
    left, right = (sizes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    able = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent  # no smaller set can share so much
    near = materialize(pairs.join(left, "a").join(right, "b").where(able).select("a", "b"), "near")
    left, right = (texts.select(F.col("id").alias(c), F.col("text").alias(f"t_{c}")) for c in "ab")
    return near.join(left, "a").join(right, "b").select("a", "t_a", "b", "t_b").mapInArrow(_confirm(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in edges (a, b): root is the smallest id reachable.

    Each round every id that has a smaller neighbour takes the smallest as parent, chains of parents
    are halved until all point at roots, and the edges are redrawn between roots. At least half of the
    non-isolated roots go in a round, so rounds grow with the logarithm of the largest component.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    parents = []
    while not edges.isEmpty():
        up = materialize(edges.groupBy("a").agg(F.min("b").alias("p")), "parents")
        while True:
            over = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
            up = materialize(up.join(over, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "parents")
            if up.where("moved").isEmpty():
                break
            up = up.select("a", "p")
        up = up.select("a", "p")
        parents.append(up)
        one, two = up.toDF("a", "ra"), up.toDF("b", "rb")
        redrawn = edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).where("x <> y")
        edges = materialize(redrawn.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    out = nodes.select("id", F.col("id").alias("root"))
    for up in parents:
        out = out.join(up.toDF("root", "r"), "root", "left").select("id", F.coalesce("r", "root").alias("root"))
    return materialize(out, "roots")


def _links_in_block(rows: list[tuple], i: int, j: int, percent: int):
    """rows: id, root, block, n, bands, text. Links between blocks i and j that join different roots.

    Pairs that share a band and whose sizes allow it are compared on their word sets. Whatever is linked already, by roots or by a link
    found here, is not, so what comes out is a forest: fewer links than rows.
    """
    ids, blocks, sizes = (np.array([r[k] for r in rows]) for k in (0, 2, 3))
    names, own = np.unique([r[1] for r in rows], return_inverse=True)
    group = np.arange(len(names))
    keys = np.stack([r[4] for r in rows])
    sets: dict[int, set] = {}

    def of(k: int) -> set:
        if k not in sets:
            sets[k] = word_set(rows[k][5])
        return sets[k]

    one, two = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    for x in one:
        ys = two[ids[two] > ids[x]] if i == j else two
        ys = ys[group[own[ys]] != group[own[x]]]
        able = np.minimum(sizes[ys], sizes[x]) * 100 >= np.maximum(sizes[ys], sizes[x]) * percent
        ys = ys[able]
        for y in ys[(keys[ys] == keys[x]).any(axis=1)]:
            if (a := group[own[x]]) != (c := group[own[y]]) and linked(of(x), of(y), percent):
                group[group == c] = a
                yield max(ids[x], ids[y]), min(ids[x], ids[y])
        if i != j:
            sets.pop(x, None)


def _compare(percent: int):
    """Over rows sorted by (region, i, j): the links that each such group adds."""

    def run(batches):
        held: list[tuple] = []
        now = None

        def batch():
            found = list(_links_in_block(held, now[1], now[2], percent)) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for region, i, j, *row, bands, text in zip(*(b.column(c).to_pylist() for c in range(9)), strict=True):
                if (region, i, j) != now:
                    if held:
                        yield batch()
                    held, now = [], (region, i, j)
                held.append((*row, np.array(bands, np.int64), text))
        if held:
            yield batch()

    return run


def _size_class(n, percent: int):
    """Sets that can be alike are of one class or of neighbours."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("long") if percent < 100 else n.cast("long")


def unresolved_links(buckets: DataFrame, roots: DataFrame, mine: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of ids of different roots that share a bucket (key, id, pivot): as many as it takes to join what they join.

    The members of all buckets whose pivots have one root make a region, with each id in it once. Regions with
    one root are done. The others fall into classes by set size, and these into blocks of BLOCK ids or BLOCK_BYTES by hash. Every pair of blocks of a class,
    or of neighbouring ones, is compared in a task group of its own. Only links leave a group. mine: id, n, bands; texts: id, text.
    """
    named = buckets.join(roots, "id", "left").select("id", "pivot", F.coalesce("root", "id").alias("root"))
    pivots = roots.select(F.col("id").alias("pivot"), F.col("root").alias("r"))
    rows = named.join(pivots, "pivot", "left").select(F.coalesce("r", "pivot").alias("region"), "id", "root").distinct()
    rows = materialize(rows, "members")
    open_ = rows.groupBy("region").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("root").alias("c")).where("r0 <> r1 and c > 2")
    rows = rows.join(open_.select("region"), "region").join(mine.select("id", "n", "bands"), "id").withColumn("c", _size_class(F.col("n"), percent))
    rows = materialize(rows.join(texts, "id"), "open")
    blocks = rows.groupBy("region", "c").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).alias("nb"))
    blocks = materialize(blocks, "blocks")
    code = lambda c, k: F.shiftleft(c, 32) + k
    rows = rows.join(blocks, ["region", "c"]).withColumn("own", code(F.col("c"), F.pmod(F.xxhash64("id"), "nb")))
    near = blocks.select("region", F.col("c").alias("c2"), F.col("nb").alias("nb2"), F.explode(F.array(F.col("c") - 1, "c", F.col("c") + 1)).alias("c"))
    rows = rows.join(near, ["region", "c"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb2") - 1))).withColumn("other", code(F.col("c2"), F.col("block")))
    rows = rows.select("region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "root", "own", "n", "bands", "text")
    rows = rows.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j")
    return rows.mapInArrow(_compare(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id, kept.

    Words end at white space (space, tab to carriage return) and are compared with A-Z lower-cased. With under five words the
    whole sequence is one shingle; without words or text the set is empty and linked with
    nothing. component_id is the smallest id reachable over links; the row that has it is kept. Rows that repeat an id
    are one node with all their links. A row with a null id is never linked: component_id null, kept.
    Other columns are not read. An empty table gives an empty result.
    """
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sk = materialize(sketches(docs, id_col, text_col), "sketches")
    classes = materialize(sk.where("id is not null and fp is not null").groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    mine = sk.where("fp is not null").join(classes.select(F.col("rep").alias("id"), F.col("fp").alias("f")), "id").where("fp = f").select("id", "n", "bands")
    mine = materialize(mine, "reps")
    bands = mine.select("id", F.explode("bands").alias("key"))
    pivots = bands.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot <> last")
    pivots = materialize(pivots.select("key", "pivot"), "pivots")  # so that the join may split a hot bucket
    buckets = materialize(bands.join(pivots, "key"), "buckets")
    star = buckets.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    texts = text.join(buckets.select("id").distinct(), "id", "left_semi")
    links = materialize(verified(star, mine.select("id", "n"), texts, percent), "links")
    roots = components(links)
    more = materialize(unresolved_links(buckets, roots, mine, text, percent), "links")
    if not more.isEmpty():
        roots = components(links.union(more))
    final = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("fp").alias("f"), F.coalesce("root", "rep").alias("component_id"))
    # repeated ids with different texts are one node
    again = sk.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    rows = sk.select("id", "n", "fp").join(materialize(final, "final"), F.col("fp") == F.col("f"), "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    out = rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
    if not again:
        out = _one_node_per_id(out, id_col)
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _one_node_per_id(rows: DataFrame, id_col: str) -> DataFrame:
    """Ids that stand in several components join them."""
    key = F.col(id_col)
    ties = rows.where(key.isNotNull()).select(key.alias("a"), F.col("component_id").alias("b"))
    joined = components(ties.union(ties.select("b", "a"))).toDF("c", "root")
    out = rows.join(joined, rows["component_id"] == joined["c"], "left")
    return out.select(id_col, "n_shingles", F.coalesce("root", "component_id").alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """docs, all columns, with one document of each group: that of the smallest id."""
    gone = near_duplicates(docs, id_col, text_col, percent).where(~F.col("kept")).select(F.col(id_col).alias(key := fresh(docs, "gone_id"))).distinct()
    return docs.join(gone, docs[id_col] == gone[key], "left_anti")


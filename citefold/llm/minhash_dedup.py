"""Near-duplicate classes by an inverted join of MinHash signature coordinates, confirmed on full shingle sets.

1. Every text becomes its set of word shingles; texts with equal sets are one node.
2. A node's signature has M coordinates; coordinate and value together are a token, and a document is posted under its
   tokens. Two sets of the asked similarity share at least ``need`` tokens but for a chance of about one in a hundred thousand at the threshold, so a
   node with fewer than ``need`` tokens that anyone shares is done (most texts end here).
3. Prefix: two token sets that share ``need`` of M tokens share one among the M - need + 1 rarest of each. Only those
   are posted, rarest first; tokens of a common line or passage stay outside.
4. Skip: a short list is merged pair by pair, but counting stops where the remaining coordinates cannot reach ``need``,
   and a pair is reported by its first common list alone. Nodes on long lists are compared in blocks: the groups that
   long lists connect are cut into blocks of bounded size, each pair of blocks is one task, and a task only reports
   links that join two classes not joined before, so a large group of near copies yields few rows.
5. Pairs are confirmed on the full sets; classes are the connected components of confirmed links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.llm.batches import WHITE, mix, slices, windows_of, words
from citefold.llm.components import components
from citefold.session import stage

M = 48           # signature coordinates
NEED = 24        # coordinates that must agree: 5.2 standard deviations below the mean at similarity 0.8
LONG_LIST = 64   # postings from which a list is compared in blocks
BLOCK = 256      # nodes of a block: two blocks of sets and one matrix of counts are all that a task holds
SHINGLE = 4
SEEDS = mix(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all rows end to end, and the rows' bounds."""
    found = words(texts, WHITE)
    hashes = found.hashes()
    starts, bounds = windows_of(found.bounds, width)
    with np.errstate(over="ignore"):
        value = np.full(len(starts), width, np.uint64)
        for k in range(width):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[starts + k])
        counts = np.diff(found.bounds)
        short = np.flatnonzero((counts > 0) & (counts < width))
        extra = []
        for row in short.tolist():
            whole = np.uint64(counts[row])
            for h in hashes[found.bounds[row]:found.bounds[row + 1]]:
                whole = mix(np.array([whole * np.uint64(0x9E3779B97F4A7C15) + h], np.uint64))[0]
            extra.append(whole)
    rows = np.r_[np.repeat(np.arange(len(counts)), np.diff(bounds)), short]
    value = np.r_[value, np.array(extra, np.uint64)]
    order = np.lexsort((value, rows))
    rows, value = rows[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (value[1:] != value[:-1])
    rows, value = rows[new], value[new]
    return value, np.searchsorted(rows, np.arange(len(counts) + 1)).astype(np.int64)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Least 32-bit hash of every set under each of M functions; rows of empty sets hold zeros."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, M), np.uint32)
    if len(full):
        with np.errstate(over="ignore"):
            for k in range(M):
                hashed = ((values ^ (values >> np.uint64(29))) * SEEDS[k]) >> np.uint64(32)
                out[full, k] = np.minimum.reduceat(hashed.astype(np.uint32), bounds[:-1][full])
    return out


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, bounds = shingle_sets(batch.column("text"), width)
            signs, sizes = signatures(values, bounds), np.diff(bounds)
            digest = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None
                      for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_shingles": pa.array(sizes),
                "digest": pa.array(digest, pa.binary()),
                "signature": pa.array([s.tobytes() if n else None for s, n in zip(signs, sizes)], pa.binary())})

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, node) for every coordinate: the coordinate's number above its value."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            signs = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, M)
            token = (np.arange(M, dtype=np.int64) << 32)[None, :] + signs.astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "token": pa.array(token.reshape(-1)),
                "node": pa.array(np.repeat(part.column("node").to_numpy(zero_copy_only=False), M))})


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, bounds = shingle_sets(batch.column("text"), width)
            digest = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None
                      for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_pydict({
                "digest": pa.array(digest, pa.binary()),
                "members": pa.array([values[a:b].view(np.int64) for a, b in zip(bounds[:-1], bounds[1:])],
                                    pa.list_(pa.int64()))})

    return run


def _merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the short lists that agree in NEED coordinates; rows come sorted by token.

    A pair is reported by the first list that both are posted in, and not at all where both stand in one group of long
    lists, which compares them anyway.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def merged(rows: pa.Table) -> pa.RecordBatch:
        token, node, group = (rows.column(c).to_numpy() for c in ("token", "node", "g"))
        signs = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(-1, M)
        firsts, seconds = [], []
        for distance in range(1, LONG_LIST):
            at = np.flatnonzero(token[distance:] == token[:-distance])
            if not len(at):
                break
            firsts.append(at)
            seconds.append(at + distance)
        if not firsts:
            return pa.RecordBatch.from_pylist([], schema)
        one, two = np.concatenate(firsts), np.concatenate(seconds)
        apart = (group[one] < 0) | (group[one] != group[two])
        one, two = one[apart], two[apart]
        agree = np.zeros(len(one), np.int64)
        for k in range(0, M, 8):  # skip pairs that cannot reach NEED any more
            agree += (signs[one, k:k + 8] == signs[two, k:k + 8]).sum(1)
            alive = agree + (M - k - 8) >= NEED
            one, two, agree = one[alive], two[alive], agree[alive]
        prefixes = rows.column("prefix").to_pylist()
        kept = [i for i, (x, y) in enumerate(zip(one.tolist(), two.tolist()))
                if min(set(prefixes[x]).intersection(prefixes[y])) == token[x]]
        return pa.RecordBatch.from_arrays([pa.array(node[one[kept]]), pa.array(node[two[kept]])], schema=schema)

    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            rows = pa.Table.from_batches([batch.slice(at, 2000)])
            held = rows if held is None else pa.concat_tables([held, rows])
            token = held.column("token").to_numpy()
            whole = int(np.searchsorted(token, token[-1]))  # the last list may go on in the next rows
            if whole:
                yield merged(held.slice(0, whole))
                held = held.slice(whole)
    if held is not None:
        yield merged(held)


def _block_pair(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Links between the nodes of two blocks (or inside one), as few as join what they join."""
        i, j = key[1].as_py(), key[2].as_py()
        side = np.array(table.column("block").to_pylist())
        nodes = table.column("node").to_numpy()
        members = table.column("members").combine_chunks()
        flat, edges = members.values.to_numpy(), members.offsets.to_numpy() - members.offsets[0].as_py()
        sizes = np.diff(edges)
        rows = np.repeat(np.arange(len(nodes)), sizes)
        shared = np.zeros((len(nodes), len(nodes)), np.float32)
        distinct, column = np.unique(flat, return_inverse=True)
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        for at in range(0, len(distinct), 4096):  # counts are sums over stretches of the shingles
            lo, hi = np.searchsorted(column, (at, at + 4096))
            part = np.zeros((len(nodes), min(4096, len(distinct) - at)), np.float32)
            part[rows[lo:hi], column[lo:hi] - at] = 1
            shared += part @ part.T
        union = sizes[:, None] + sizes[None, :] - shared
        linked = 100 * shared >= percent * union
        linked &= np.tri(len(nodes), k=-1, dtype=bool)
        if i != j:
            linked &= side[:, None] != side[None, :]
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a_out, b_out = [], []
        for x, y in zip(*(v.tolist() for v in np.nonzero(linked))):
            p, q = root(x), root(y)
            if p != q:
                parent[p] = q
                a_out.append(nodes[x])
                b_out.append(nodes[y])
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Sets are of ``width``-word shingles over lower-cased (A-Z) words between white space; a text of fewer words is one
    shingle, one without words (or null) has an empty set and is linked with nothing. Rows are linked at
    100 * intersection >= ``percent`` * union; component_id is the least doc_id reachable, kept marks the row whose
    doc_id that is. Rows that share a doc_id are separate rows; rows without doc_id form no class of their own
    (component_id null, kept false) unless linked. Other columns are ignored; an empty table gives no rows.
    """
    if percent < 80:
        raise ValueError("the signature is dimensioned for a similarity of 0.8 or more")
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = stage(source.mapInArrow(_sketch(width), "doc_id long, n_shingles long, digest binary, signature binary"),
                 "sketches")
    nodes = stage(rows.filter("digest is not null").groupBy("digest")
                  .agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature"))
                  .withColumn("node", F.monotonically_increasing_id()), "nodes")
    posted = nodes.select("signature", "node").mapInArrow(_tokens, "token long, node long")
    lists = stage(posted.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "lists")
    prefix_length = F.col("shared") - F.lit(NEED - 1)  # M - NEED + 1 less the tokens that nobody shares
    prefixes = stage(
        posted.join(lists, "token").groupBy("node")
        .agg(F.count("*").alias("shared"), F.array_sort(F.collect_list(F.struct("n", "token"))).alias("lists"))
        .filter(F.col("shared") >= NEED)
        .select("node", F.slice("lists", F.lit(1), prefix_length.cast("int")).alias("lists")), "prefixes")
    posts = prefixes.select(
        "node", F.transform(F.filter("lists", lambda x: x.n <= LONG_LIST), lambda x: x.token).alias("prefix"),
        F.transform(F.filter("lists", lambda x: x.n > LONG_LIST), lambda x: x.token).alias("hot"))
    # sets of the nodes that are left, computed again from one text each rather than stored for all
    left = stage(posts.join(nodes.select("node", "least", "signature", "digest"), "node"), "candidates")
    wanted = left.select(F.col("least").alias("doc_id"), F.col("digest").alias("of"), "node")
    # both sides grow with the table, so the plan is a merge join at every size
    ids = wanted.select("doc_id").distinct().hint("merge")
    found = (source.join(ids, source.doc_id.eqNullSafe(ids.doc_id), "left_semi")
             .select("text").mapInArrow(_sets(width), "digest binary, members array<long>")
             .filter("digest is not null"))
    sets = stage(found.join(wanted.select(F.col("of").alias("digest"), "node").hint("merge"), "digest")
                 .dropDuplicates(["node"]).select("node", "members"), "sets")

    # groups that long lists connect; each list hangs on the next one of the same node
    steps = left.filter("size(hot) > 0").select(F.explode(F.expr(
        "transform(hot, (t, i) -> struct(t as a, coalesce(get(hot, i + 1), t) as b))")).alias("e")).select("e.*").distinct()
    groups = stage(components(steps), "list-groups")
    grouped = stage(left.filter("size(hot) > 0").select("node", F.get("hot", F.lit(0)).alias("token"))
                    .join(groups.select(F.col("node").alias("token"), F.col("component").alias("g")), "token")
                    .select("node", "g"), "grouped")
    blocks = grouped.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = (grouped.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .join(sets, "node"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "members")
    linked = met.groupBy("g", "i", "j").applyInArrow(_block_pair(percent), "a long, b long")

    short = (left.join(grouped, "node", "left").select(
        F.explode("prefix").alias("token"), "node", "prefix", "signature", F.coalesce("g", F.lit(-1)).alias("g"))
        .repartition("token").sortWithinPartitions("token", "node"))
    pairs = short.mapInArrow(_merge_lists, "a long, b long")
    confirmed = (pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
                 .join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
                 .withColumn("both", F.size(F.array_intersect("x", "y")))
                 .filter(F.col("both") * 100 >= percent * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b"))

    classes = components(stage(confirmed.unionByName(linked), "links"))
    named = nodes.select("node", "digest", "least").join(classes, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_digest = named.join(least, "component").select("digest", "component_id")
    joined = rows.select("doc_id", "n_shingles", "digest").join(of_digest, "digest", "left")
    return joined.select(
        "doc_id", "n_shingles",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))

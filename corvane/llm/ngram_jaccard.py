"""N-gram Jaccard join: prefix trees over globally ordered shingle sets.

Two texts link when 100 * |A and B| >= 75 * |A or B| over their distinct 5-word
shingles.  No sketch decides anything, nothing is sampled or capped.  Shingles and
sets go by 64-bit hashes that are not compared as text: n different sets hold about
n * n / 2**65 false pairs of equal names.

Plan
1. Each map task hashes its texts to shingle sets and deals (shingle, set) to
   hash buckets in packed cells.  Copies are one set, named by a 64-bit digest.
2. A bucket sees every set that holds a shingle, so it knows document
   frequencies.  Shingles held by one set can link nothing and are only
   counted.  Shingles held by exactly the same sets behave as one weighted
   element; the digest of their posting list names it.
3. Per set, elements are ordered globally: rarest first, then by name.  A set of
   n shingles must share one of its first n - ceil(0.75 n) + 1 with any partner,
   and sets whose shared shingles weigh too little drop out.  Only elements in
   that prefix carry the set on.
4. Sets that share a prefix element meet in a group.  Elements that the same members
   hold become one; then the group stores the ordered lists in a trie and carries
   all sets down the tree together: partial overlaps are shared along common
   prefixes, and a subtree is left by the sets whose remaining weight, or its own,
   can't reach the bound.  A group reports a spanning forest of its links, not
   all pairs.
   Copies of one text share most prefix elements, so groups are formed in three
   rounds: each set under its rarest element only; under elements whose sets are
   not one component yet, a set per component; and at last all sets of the
   elements that are still mixed.  The first two only save work, the last one
   makes the join exact: two sets of different components that share a prefix
   element always meet.
5. Connected components of the links; the smallest doc_id names one.

A group is split above BLOCK sets.  In the last round sets are dealt to parts of that size, and parts meet in groups of their own, so no task holds an unbounded
group: the largest component of a key against the others, and the others among
themselves.  m sets of one component and s others ship (2 m s + s s) / BLOCK lists.

Edge cases: null, empty and blank texts have no shingles and link with nothing;
texts under five words are one shingle; repeated rows give repeated results; a
null doc_id stays null; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import (
    U64, UnionFind, batches_of, bucket_count, connected_components, deal, joined, materialise, mix64, pack, plan_bytes, release, runs, shingle_sets,
)

BLOCK = 512
HELD = 1 << 21  # shingles a map task holds before it deals them
BUCKET_BYTES = 8 << 20  # input per bucket: wide buckets hold several shingles of a text, which then share its name
LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 22
_POSTING, _SIDE = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)


def _digest(shingles: np.ndarray) -> np.uint64:
    return mix64(mix64(shingles ^ _SIDE).sum(dtype=U64, keepdims=True) + U64(len(shingles)))[0]


def shingle_digests(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, and the digest of the shingle set (null without one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            sets = list(shingle_sets(batch.column("text"), words))
            n = np.array([len(s) for s in sets], np.int64)
            digest = np.array([_digest(s) if len(s) else 0 for s in sets], U64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(digest, mask=n == 0)], names=["doc_id", "n_shingles", "digest"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest long")


def _dealt_shingles(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """Packed (shingle, set) pairs by shingle bucket; sets: one entry per set in the cell, with its size and its shingles' count there."""

    def cell_rows(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        digests = np.fromiter(held, U64, len(held))
        counts = np.array([len(s) for s in held.values()])
        shingles = np.concatenate(list(held.values()))
        owner = np.repeat(np.arange(len(held)), counts)
        bucket = (shingles >> U64(40)) % U64(buckets)
        order = np.lexsort((owner, bucket))
        bucket, owner, shingles = bucket[order], owner[order], shingles[order]
        heads = runs(bucket, owner)
        parts = deal(bucket[heads], {"sets": digests[owner[heads]], "sizes": counts[owner[heads]].astype(np.uint32), "counts": np.diff(np.append(heads, len(owner))).astype(np.uint32)})
        low = deal(bucket, {"low": shingles.astype(np.uint32), "mid": (shingles >> U64(32)).astype(np.uint16)})
        return pa.RecordBatch.from_arrays([*parts.columns, *low.columns[1:]], names=["bucket", "sets", "sizes", "counts", "low", "mid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches_of(batches):
            for s in shingle_sets(batch.column("text"), words):
                if len(s) and (d := int(_digest(s))) not in held:
                    held[d] = s
                    n += len(s)
            if n >= HELD:
                yield cell_rows(held)
                held, n = {}, 0
        if held:
            yield cell_rows(held)

    return docs.select("text").mapInArrow(run, "bucket long, sets binary, sizes binary, counts binary, low binary, mid binary")


def _elements(buckets: int):
    """Per shingle bucket: weighted elements (shingles with equal posting lists) of each set, dealt by set."""
    schema = "bucket long, sets binary, sizes binary, posts binary, dfs binary, weights binary"

    def run(table: pa.Table) -> pa.Table:
        counts = joined(table["counts"], np.uint32)
        sets, sizes = np.repeat(joined(table["sets"], U64), counts), np.repeat(joined(table["sizes"], np.uint32), counts)
        shingles = joined(table["mid"], np.uint16).astype(U64) << U64(32) | joined(table["low"], np.uint32)  # 48 bits within a bucket
        order = np.lexsort((sets, shingles))
        sets, sizes, shingles = sets[order], sizes[order], shingles[order]
        once = runs(shingles, sets)
        sets, sizes, shingles = sets[once], sizes[once], shingles[once]
        heads = runs(shingles)
        df = np.diff(np.append(heads, len(shingles)))
        post = mix64(np.add.reduceat(mix64(sets ^ _POSTING), heads, dtype=U64) + df.astype(U64)) if len(heads) else heads.astype(U64)
        df, post = np.repeat(df, df).astype(np.uint32), np.repeat(post, df)
        shared = df > 1
        sets, sizes, df, post = sets[shared], sizes[shared], df[shared], post[shared]
        order = np.lexsort((post, sets))
        sets, sizes, df, post = sets[order], sizes[order], df[order], post[order]
        heads = runs(sets, post)
        weight = np.diff(np.append(heads, len(sets))).astype(np.uint32)
        sets = sets[heads]
        return pa.Table.from_batches([deal(mix64(sets) % U64(buckets), {"sets": sets, "sizes": sizes[heads], "posts": post[heads], "dfs": df[heads], "weights": weight})])

    return run, schema


def _prefixes(percent: int):
    """Per set bucket: the sets that can have a partner, with their prefix keys and their whole ordered element lists."""
    names = ["set", "size", "keys", "elements", "weights"]

    def run(table: pa.Table) -> pa.Table:
        sets, sizes, posts = joined(table["sets"], U64), joined(table["sizes"], np.uint32).astype(np.int64), joined(table["posts"], U64)
        df, weight = joined(table["dfs"], np.uint32), joined(table["weights"], np.uint32).astype(np.int64)
        order = np.lexsort((posts, sets))
        sets, sizes, posts, df, weight = (x[order] for x in (sets, sizes, posts, df, weight))
        heads = runs(sets, posts)
        weight = np.add.reduceat(weight, heads) if len(heads) else weight
        sets, sizes, posts, df = sets[heads], sizes[heads], posts[heads], df[heads]
        # the global order: rarest first, then by the posting list's name
        element = np.minimum(df, 0xFFFF).astype(U64) << U64(48) | posts >> U64(16)
        order = np.lexsort((element, sets))
        sets, sizes, weight, element = (x[order] for x in (sets, sizes, weight, element))
        out: list[tuple] = []
        heads = runs(sets)
        for a, b in zip(heads.tolist(), np.append(heads, len(sets))[1:].tolist(), strict=True):
            w, n = weight[a:b], int(sizes[a])
            shared, need = int(w.sum()), -(-percent * n // 100)
            if shared >= need:
                before = np.cumsum(w) - w
                keys = element[a:b][n - shared + before <= n - need]
                if len(keys):
                    out.append((int(sets[a : a + 1].astype(np.int64)[0]), n, keys.astype(np.int64).tolist(), pack(element[a:b]), pack(w.astype(np.uint32))))
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run, "set long, size long, keys array<long>, elements binary, weights binary"


class Trie:
    """Ordered element lists as a prefix tree; links() carries all lists down the tree at once.

    The lists are sorted, so a node is a range of them that agree up to a depth, and it is opened only when some list
    gets there.  members are global numbers in list order; inside the tree they are 0..m-1 in that order.
    """

    def __init__(self, members: list[int], lists: dict[int, np.ndarray], weights: dict[int, np.ndarray], sizes: list[int]):
        self.members, self.lists = members, [lists[m] for m in members]
        self.size = np.array([sizes[m] for m in members], np.int64)
        # holders of each element and its weight, element by element
        flat, owner = np.concatenate(self.lists), np.repeat(np.arange(len(members)), [len(x) for x in self.lists])
        order = np.argsort(flat, kind="stable")
        self.holder, self.weight = owner[order], np.concatenate([weights[m] for m in members])[order]
        self.at = np.searchsorted(flat[order], np.arange(int(flat.max(initial=-1)) + 2))
        self.left = [np.append(np.cumsum(weights[m][::-1])[::-1], 0) for m in members]  # weight of a list from a depth on

    def held(self, elements: np.ndarray, who: np.ndarray) -> np.ndarray:
        """What these elements weigh together in each of these lists."""
        first, n = self.at[elements], self.at[elements + 1] - self.at[elements]
        place = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return np.bincount(self.holder[place], self.weight[place], len(self.members)).astype(np.int64)[who]

    def links(self, percent: int, sets: UnionFind) -> Iterator[tuple[int, int]]:
        """Pairs of members that link and weren't in one component of sets, which is kept up."""
        root = np.array([sets.find(m) for m in self.members])
        total = np.array([x[0] for x in self.left])
        stack = [(0, len(self.members), 0, np.arange(len(self.members)), np.zeros(len(self.members), np.int64))]
        while stack:
            lo, hi, depth, who, overlap = stack.pop()
            if hi - lo == 1:  # a single list is left: the rest of its path at once
                rest = self.lists[lo][depth:]
                yield from self._meet(lo, who, overlap + self.held(rest, who), percent, sets, root)
                continue
            while lo < hi and len(self.lists[lo]) == depth:
                yield from self._meet(lo, who, overlap, percent, sets, root)
                lo += 1
            while lo < hi:
                e, end = self.lists[lo][depth], lo + 1
                while end < hi and self.lists[end][depth] == e:
                    end += 1
                got = overlap + self.held(np.array([e]), who)
                rest = max(int(self.left[i][depth + 1]) for i in range(lo, end))
                able = (who > lo) & ((100 + percent) * (got + np.minimum(total[who] - got, rest)) >= percent * (self.size[who] + self.size[lo:end].min()))
                if end - lo == 1:
                    able &= root[who] != root[lo]
                if able.any():
                    stack.append((lo, end, depth + 1, who[able], got[able]))
                lo = end

    def _meet(self, y: int, who: np.ndarray, overlap: np.ndarray, percent: int, sets: UnionFind, root: np.ndarray) -> Iterator[tuple[int, int]]:
        good = (who > y) & ((100 + percent) * overlap >= percent * (self.size[who] + self.size[y])) & (root[who] != root[y])
        for x in who[good].tolist():
            if sets.union(self.members[x], self.members[y]):
                yield self.members[x], self.members[y]


def condensed(members: list[int], elements: list[np.ndarray], weights: list[np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """The members' ordered lists for one group: elements that the same members hold become one, those of a single member go."""
    counts = [len(elements[m]) for m in members]
    el, w, who = np.concatenate([elements[m] for m in members]), np.concatenate([weights[m] for m in members]).astype(np.int64), np.repeat(np.arange(len(members)), counts)
    order = np.argsort(el, kind="stable")
    el, w, who = el[order], w[order], who[order]
    heads = runs(el)
    held = np.diff(np.append(heads, len(el)))
    name = np.add.reduceat(mix64(np.arange(1, len(members) + 1, dtype=U64))[who], heads, dtype=U64)
    shared = np.flatnonzero(held > 1)
    if not len(shared):
        return {m: np.zeros(0, np.int64) for m in members}, {m: np.zeros(0, np.int64) for m in members}
    _, first, own = np.unique(name[shared], return_index=True, return_inverse=True)
    total = np.bincount(own, w[heads[shared]]).astype(np.int64)
    order = np.argsort(first, kind="stable")  # by their first element: still the global order
    at, n = heads[shared[first[order]]], held[shared[first[order]]]
    place = np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)
    holder, rank, weight = who[place], np.repeat(np.arange(len(n)), n), np.repeat(total[order], n)
    by = np.argsort(holder, kind="stable")
    cuts = np.cumsum(np.bincount(holder, minlength=len(members)))[:-1]
    return dict(zip(members, np.split(rank[by], cuts), strict=True)), dict(zip(members, np.split(weight[by], cuts), strict=True))


def _block_links(percent: int):
    """Per bucket of groups: a spanning forest of the links among the sets of each group; sets with one label are linked already."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["grp", "set", "size", "label"]).to_pydict()
        place: dict[int, int] = {}
        own = [place.setdefault(x, len(place)) for x in rows["set"]]
        first = [own.index(i) for i in range(len(place))] if len(place) < 64 else np.unique(own, return_index=True)[1].tolist()
        cell = {c: table[c].combine_chunks() for c in ("elements", "weights")}
        names, sizes = list(place), [rows["size"][i] for i in first]
        elements = [np.frombuffer(cell["elements"][i].as_buffer(), U64) for i in first]
        weights = [np.frombuffer(cell["weights"][i].as_buffer(), np.uint32) for i in first]
        sets, links = UnionFind(len(names)), []
        labels: dict[int, int] = {}
        for x, label in zip(own, rows["label"], strict=True):
            sets.union(x, labels.setdefault(label, x))
        groups: dict[int, set[int]] = {}
        for x, grp in zip(own, rows["grp"], strict=True):
            groups.setdefault(grp, set()).add(x)
        for members in groups.values():
            if len({sets.find(m) for m in members}) < 2:
                continue
            lists, own_weights = condensed(sorted(members), elements, weights)
            members = sorted((m for m in members if 100 * own_weights[m].sum() >= percent * sizes[m]), key=lambda m: lists[m].tolist())
            if len({sets.find(m) for m in members}) < 2:
                continue
            links += [(names[x], names[m]) for x, m in Trie(members, lists, own_weights, sizes).links(percent, sets)]
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run, "a long, b long"


def set_links(docs: DataFrame, percent: int = 75, words: int = 5, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between digests of distinct shingle sets; they span each component."""
    buckets = max(LEAST_BUCKETS, min(plan_bytes(docs) // BUCKET_BYTES, MOST_BUCKETS))
    wide = bucket_count(docs)
    out = _dealt_shingles(docs, words, buckets)
    for run, schema in (_elements(buckets), _prefixes(percent)):
        out = out.groupBy("bucket").applyInArrow(run, schema)
    sets = materialise(out, "prefix-sets")
    del out
    release(docs.sparkSession)
    run, schema = _block_links(percent)

    def linked(members: DataFrame) -> DataFrame:
        """members: grp, set, label."""
        rows = members.join(sets.drop("keys"), "set").select(F.expr(f"pmod(grp, {wide})").alias("bucket"), "grp", "set", "size", "label", "elements", "weights")
        found = materialise(rows.groupBy("bucket").applyInArrow(run, schema), "set-links")
        del rows
        release(docs.sparkSession)
        return found

    def labelled(links: DataFrame) -> DataFrame:
        """(key, set, label) under every key whose sets aren't one component yet."""
        roots = connected_components(links).withColumnsRenamed({"node": "set", "root": "label"})
        held = sets.select("set", F.explode("keys").alias("key")).join(roots, "set", "left").select("key", "set", F.coalesce("label", "set").alias("label"))
        who = F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("who")
        mixed = held.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), who).where("low <> high")
        mixed = mixed.groupBy("who", "n").agg(F.min("key").alias("key"))  # keys of the same sets are one
        return held.join(mixed.select("key", "n"), "key")

    spread = F.expr(f"xxhash64(key, pmod(xxhash64(set), greatest(1, cast(ceil(n / {block}) AS int))))")
    # each set under its rarest key only; then a set per component under each mixed key; then all sets of keys that stay mixed
    counted = sets.select("set", F.col("keys")[0].alias("key"))
    counted = counted.join(counted.groupBy("key").agg(F.count("*").alias("n")), "key").where("n > 1")
    links = linked(counted.select(spread.alias("grp"), "set", F.col("set").alias("label")))
    chosen = labelled(links).groupBy("key", "label").agg(F.min("set").alias("set"), F.max("n").alias("n"))
    links = links.unionByName(linked(chosen.select(spread.alias("grp"), "set", "label")))
    mixed = materialise(labelled(links), "mixed-keys")
    small = mixed.where(f"n <= {block}").select(F.col("key").alias("grp"), "set", "label")
    # in a large key the sets of its largest component meet the other sets only, and those meet each other
    large = mixed.where(f"n > {block}")
    per_label = large.groupBy("key", "label").agg(F.count("*").alias("n"))
    sides = per_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).selectExpr(
        "key", "top.label AS big", f"cast(ceil(top.n / {block}) AS int) AS big_parts", f"cast(ceil((n - top.n) / {block}) AS int) AS small_parts"
    )
    rows = large.join(sides, "key").withColumn("is_big", F.col("label") == F.col("big")).withColumn("own", F.expr("pmod(xxhash64(set, 1), if(is_big, big_parts, small_parts))"))
    across = rows.select("*", F.explode(F.expr("sequence(0, if(is_big, small_parts, big_parts) - 1)")).alias("other"))
    across = across.select(F.expr("xxhash64(key, 'across', if(is_big, own, other), if(is_big, other, own))").alias("grp"), "set", "label")
    among = rows.where("NOT is_big").select("*", F.explode(F.expr("sequence(0, small_parts - 1)")).alias("other"))
    among = among.select(F.expr("xxhash64(key, 'among', least(own, other), greatest(own, other))").alias("grp"), "set", "label")
    links = links.unionByName(linked(small.unionByName(across).unionByName(among)))
    release(docs.sparkSession, sets, mixed)
    return links


def ngram_components(docs: DataFrame, percent: int = 75, words: int = 5, block: int = BLOCK) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    own = materialise(shingle_digests(docs, words), "shingle-sets")
    reached = connected_components(set_links(docs, percent, words, block)).withColumnsRenamed({"node": "digest"})
    classes = own.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least")).join(reached, "digest", "left").selectExpr("digest", "least", "coalesce(root, digest) AS root")
    classes = materialise(classes, "set-classes")
    roots = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(roots, "root").select("digest", "component_id")
    return own.join(named, "digest", "left").selectExpr("doc_id", "n_shingles", "coalesce(component_id, doc_id) AS component_id")

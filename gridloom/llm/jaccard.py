"""N-gram Jaccard join over a matrix of tokens and groups of sets: all links of 75 % and more, as connected components.

Level one. Each block of documents sends the shingles of its different sets to the shards of the token space. A shard
counts for each document the tokens that occur twice, in documents of any block; no union of a block is stored. A
document can only be linked if three quarters of its shingles occur elsewhere, so the count bounds it, and most are done. (Tokens are cut to 40 bits here, which can only loosen the bound.)

Level two, over the different shingle sets that are left. Similar sets are put into groups: sets with the same smallest
hash, under either of two hash functions, are compared with the first few of their kind, and what links is one group.
Again a set is bounded by what the unions of other groups have of it, now exactly, and few are left. Those are put into
bundles of similar sets, linked or not: the same smallest hash among the tokens that other groups have. They look up the
matrix of tokens and bundles, which has prefix tokens only and no unions, by their prefix: of the t tokens that other groups have, the t - ceil(0.75 n) + 1 rarest,
of which any linked set shares one. They go to the bundles that they meet there, their own too, if the sizes and the
tokens left from there on allow a link with another group; a bundle whose union covers three quarters of the set is
opened, and its members are compared exactly. A link that joins what the bundle's links have joined already is not
written. Bundles over LARGE sets are several. Tokens that the very same sets have, such as those of one passage, are one
column of the matrix.

Two texts with the same set are one node, so copies are never paired. Defined cases: null and empty texts have no
shingles and link with nothing; repeated rows and ids are rows of their own; a null doc_id counts for no minimum; a
very long text is one piece of its block (exchange.py says what it takes) and its set one array in a row. Other columns,
also those named like results, are not read. Words and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import exchange, tokens
from gridloom.llm.common import settled, written
from gridloom.llm.components import components

#: Sets that others with the same smallest hash are compared with at once. What they miss, level two finds.
LEADERS = 16
#: Sets beyond which the join that fetches their texts shuffles the texts: the bound on what is broadcast, some 20 MB as built.
BROADCAST_SETS = 200_000
#: Sets with the same smallest hash beyond which they are dealt to more than one task.
LARGE = 2_000


def _signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.mix(h ^ np.uint64(0x5DEECE66D)))])
    return tokens.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))


def _questions(shards: int):
    def run(table: pa.Table) -> Iterator[tuple[int, exchange.Arrays]]:
        h, at = tokens.shingle_sets(tokens.words(table["text"].combine_chunks()))
        sizes, signs = np.diff(at), _signatures(h, at)
        first = np.zeros(len(sizes), np.uint8)
        first[np.unique(signs, return_index=True)[1]] = 1
        doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        mine = first[doc] > 0
        order = np.argsort(h[mine])
        h, doc = h[mine][order], doc[mine][order]
        parts = dict(exchange.runs(exchange.shard_of(h, shards)))
        head = [*exchange.ids_array(table["doc_id"]), sizes.astype(np.uint32), signs, first]
        home = int(signs[0] % np.uint64(shards))
        for s in sorted(parts.keys() | {home}):
            part = parts.get(s, slice(0, 0))
            yield s, [exchange.steps(h[part] >> np.uint64(24)), doc[part], *(head if s == home else [])]

    return run


def _reply(asked: list[exchange.Arrays]) -> Iterator[exchange.Arrays]:
    keys = [exchange.total(x[0]) for x in asked]
    every = np.sort(np.concatenate(keys))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    for key, (_, doc, *head) in zip(keys, asked, strict=True):
        live = np.zeros(0, np.uint32)
        if len(twice) and len(key):
            at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            live = np.bincount(doc[twice[at] == key]).astype(np.uint32)
        yield [live, *head]


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, pieces in exchange.met(batches):
        for _, _, got in pieces:
            (head,) = [x[1:] for x in got[0] if len(x) > 1]
            ids, null, sizes, signs, first = head
            live = np.zeros(len(ids), np.int64)
            for x in got[0]:
                live[: len(x[0])] += x[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids, mask=null.astype(bool)), pa.array(sizes.astype(np.int64)), pa.array(signs.view(np.int64)), pa.array(live, mask=first == 0)], [x.split()[0] for x in BOUNDS.split(", ")])


BOUNDS = "block long, doc_id long, n_shingles long, sign long, live long"


def shingle_bounds(docs: DataFrame) -> DataFrame:
    """BOUNDS of docs: block of documents, sign (of the set) and live, how many of the shingles may occur elsewhere; null where another document of the piece has the same set."""
    shards = exchange.shards_of(docs)
    asked = exchange.ask(docs, _questions(shards), 0, shards)
    return written(exchange.together(exchange.answer(asked, shards, _reply)).mapInArrow(_bounds, BOUNDS), "shingle-bounds")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, at = tokens.shingle_sets(tokens.words(batch.column("text")))
        signs = _signatures(h, at)
        sizes = np.diff(at)
        keep = np.flatnonzero(sizes > 0)
        if not len(keep):
            continue
        sets = [(h[at[i] : at[i + 1]] >> np.uint64(1)).view(np.int64) for i in keep]
        other = [int((tokens.mix(x.view(np.uint64)) >> np.uint64(1)).min()) for x in sets]
        yield pa.RecordBatch.from_arrays([pa.array(signs[keep].view(np.int64)), pa.array(sizes[keep]), pa.array([int(x[0]) for x in sets]), pa.array(other), pa.array(sets, pa.list_(pa.int64()))], ["sign", "n", "low", "low2", "tokens"])


def _link_leaders(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders = None, []
        for batch in batches:
            a, b = [], []
            values = batch.column("tokens")
            for k, (key, salt, sign) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "salt", "sign")), strict=True)):
                x = values[k].values.to_numpy()
                if (key, salt) != now:
                    now, leaders = (key, salt), []
                for other, y in leaders:
                    small, large = sorted((len(x), len(y)))
                    if 100 * small >= share * large:
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * common >= share * (small + large - common):
                            a.append(sign)
                            b.append(other)
                            break
                else:
                    if len(leaders) < LEADERS:
                        leaders.append((sign, x))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _dealt(sets: DataFrame, key: str, to: str) -> DataFrame:
    """sets with the number of the task, among those of its key, that a set is dealt to: one for each LARGE sets. The keys with more are counted first; AQE splits theirs in the join."""
    counts = sets.groupBy(key).count().filter(F.col("count") > LARGE).select(key, F.ceil(F.col("count") / LARGE).alias("_ways"))
    return sets.join(counts, key, "left").withColumn(to, F.pmod(F.xxhash64("sign", F.lit(key)), F.coalesce("_ways", F.lit(1)))).drop("_ways")


def _similar(sets: DataFrame, key: str, share: int) -> DataFrame:
    dealt = _dealt(sets, key, "salt").select(F.col(key).alias("key"), "salt", "sign", "n", "tokens")
    return dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "sign").mapInArrow(_link_leaders(share), "a long, b long")


class _Bundle:
    """A bundle's members, for each token of its union who has it, and which groups its links have joined so far."""

    def __init__(self, signs: list[int], groups: list[int], sizes: list[int], sets: list[np.ndarray]) -> None:
        self.signs, self.n = np.array(signs, np.int64), np.array(sizes, np.int64)
        names, self.group = np.unique(np.array(groups, np.int64), return_inverse=True)
        self.places = {int(g): k for k, g in enumerate(names)}
        self.joined = np.arange(len(names))
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.union, self.of = every[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]

    def linked(self, x: np.ndarray, n: int, share: int) -> np.ndarray:
        """Members that have share percent of the union with a set of n tokens, of which x may occur in other groups."""
        low, high = np.searchsorted(self.union, x, "left"), np.searchsorted(self.union, x, "right")
        met = high > low
        if 100 * met.sum() < share * n:
            return np.zeros(0, np.int64)
        sizes = (high - low)[met]
        ends = np.cumsum(sizes)
        common = np.bincount(self.of[np.repeat(low[met] - (ends - sizes), sizes) + np.arange(ends[-1])], minlength=len(self.n))
        return np.flatnonzero(100 * common >= share * (self.n + n - common))

    def join(self, group: int, found: np.ndarray) -> list[int]:
        """Of the members found for a set of a group, one for each part that wasn't joined with it before."""
        if (mine := self.places.setdefault(group, len(self.joined))) == len(self.joined):
            self.joined = np.append(self.joined, mine)
        parts, first = np.unique(self.joined[self.group[found]], return_index=True)
        new = parts != self.joined[mine]
        if new.any():
            self.joined[np.isin(self.joined, parts[new])] = self.joined[mine]
        return self.signs[found[first[new]]].tolist()


def _open_bundles(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, bundle = None, [], None
        for batch in batches:
            a, b = [], []
            values = batch.column("tokens")
            for k, (other, part, asks, sign, group, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("other", "part", "asks", "sign", "group", "n")), strict=True)):
                if (other, part) != now:
                    now, held, bundle = (other, part), [], None
                x = values[k].values.to_numpy()
                if not asks:
                    held.append((sign, group, n, x))
                    continue
                bundle = bundle or _Bundle(*map(list, zip(*held, strict=True)))
                if len(found := bundle.linked(x, n, share)):
                    new = bundle.join(group, found)
                    a += [sign] * len(new)
                    b += new
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _need(n: Column, share: int) -> Column:
    return F.ceil(n * share / 100)


def linked(docs: DataFrame, share: int = 75, stable: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of docs (doc_id, text): the smallest doc_id that links lead to. share: percent of the union that a link has in common."""
    docs = settled(docs.select("doc_id", "text"), "jaccard-docs", stable)
    bounds = shingle_bounds(docs)
    nodes = bounds.filter("n_shingles > 0").groupBy("sign").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("live").alias("live"))
    open_ = written(nodes.filter(F.col("live") >= _need(F.col("n"), share)).select("rep", "sign"), "open-sets")
    few = open_.count() <= BROADCAST_SETS
    # each id once, so that a row comes once, however many texts share its id; of their sets, the open ones stay
    reps = open_.select("rep").distinct()
    found = docs.join(F.broadcast(reps) if few else reps, docs["doc_id"].eqNullSafe(reps["rep"])).select("text").mapInArrow(_sets, "sign long, n long, low long, low2 long, tokens array<long>")
    signs = open_.select("sign")
    sets = written(found.dropDuplicates(["sign"]).join(F.broadcast(signs) if few else signs, "sign", "left_semi"), "shingle-sets")

    edges = written(_similar(sets, "low", share).unionAll(_similar(sets, "low2", share)), "links")
    groups = components(edges)
    grouped = sets.select("sign", "n", "tokens").join(groups.select(F.col("node").alias("sign"), F.col("component").alias("found")), "sign", "left").withColumn("group", F.coalesce("found", "sign")).drop("found")
    # a set can only be linked to another group if three quarters of its tokens are in the unions of other groups
    every = grouped.select("sign", "n", "group", F.explode("tokens").alias("token"))
    # a token that very many sets have is aggregated before the exchange, and AQE splits it in the join
    facts = every.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("times"), F.bit_xor(F.xxhash64("sign")).alias("held")).filter("low <> high")
    spread = every.join(facts, "token")
    # rare tokens first, so that a prefix has few partners; tokens that the same sets have stand together
    need = _need(F.col("n"), share)
    outer = spread.groupBy("sign", "n", "group").agg(F.array_sort(F.collect_list(F.struct("times", "held", "token"))).alias("x")).filter(F.size("x") >= need)
    outer = outer.select("sign", "n", "group", F.transform("x", lambda x: x["token"]).alias("tokens"), F.transform(F.slice("x", F.lit(1), (F.size("x") - need + 1).cast("int")), lambda x: x["held"]).alias("prefix"))
    outer = written(_dealt(written(outer.withColumn("bundle", F.array_min("tokens")), "outer-sets"), "bundle", "part"), "outer-tokens")
    # of the tokens that the same sets have, one stands for all; rest: how many of the set's tokens come from it on
    held = outer.select("sign", "n", "group", "bundle", "part", "prefix", F.size("tokens").alias("t"), F.explode(F.array_distinct("prefix")).alias("held"))
    held = held.select("sign", "n", "group", "bundle", "part", "held", (F.col("t") - F.array_position("prefix", F.col("held")) + 1).alias("rest"))
    matrix = held.groupBy("held", F.col("bundle").alias("other"), "part").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("other_rest"))
    sized = (100 * F.col("most") >= share * F.col("n")) & (share * F.col("least") <= 100 * F.col("n")) & ((100 + share) * F.least("rest", "other_rest") >= share * (F.col("n") + F.col("least")))
    others = (F.col("low") != F.col("group")) | (F.col("high") != F.col("group"))
    wanted = written(held.drop("bundle", "part").join(matrix, "held").filter(others & sized).select("sign", "other", "part").distinct(), "wanted")
    members = outer.select(F.col("bundle").alias("other"), "part", F.lit(0).alias("asks"), "sign", "group", "n", "tokens")
    asking = wanted.join(outer.select("sign", "group", "n", "tokens"), "sign").select("other", "part", F.lit(1).alias("asks"), "sign", "group", "n", "tokens")
    more = members.unionAll(asking).repartition("other", "part").sortWithinPartitions("other", "part", "asks").mapInArrow(_open_bundles(share), "a long, b long")
    edges = edges.unionAll(written(more, "links"))

    label = components(edges).join(nodes.select(F.col("sign").alias("node"), "rep"), "node")
    least = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_sign = nodes.join(label.join(least, "component").select(F.col("node").alias("sign"), F.col("component_id").alias("far")), "sign", "left").select("sign", F.coalesce("far", "rep").alias("near"))
    # a set comes back once to each block that has it, so that copies don't meet in one task
    key = ["block", "sign"]
    near = bounds.filter("n_shingles > 0").select(*key).distinct().join(of_sign, "sign")
    return bounds.join(near, key, "left").select("doc_id", "n_shingles", F.coalesce("near", "doc_id").alias("component_id"))

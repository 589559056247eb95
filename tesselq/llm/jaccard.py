"""Documents whose sets of word n-grams are alike, by a grouped prefix join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, fresh, ngram_hashes, one_of_each, partitions, row_key, rows_of, text_of, written
from .components import connected_components

#: n-gram hashes that a task gathers before it deals them out.
BLOCK = 1_000_000
#: Documents in a block at most, and blocks of a task: parts of a row's number.
BLOCK_ROWS, TASK_BLOCKS = 1 << 20, 1 << 16
#: An n-gram that so many of a block's documents have is dealt out once for all of them, with their number.
HEAVY = 4
#: Salts of a meeting place at least, and documents under one salt at most, by the n-gram's count.
SALTS, SALTED = 16, 4096
#: 64-bit words of a signature.
SIGNATURE = 32
DEALT = "target int, block long, docs binary, counts binary, hashes binary, info binary"
DEALT_ARROW = pa.schema([("target", pa.int32()), ("block", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("info", pa.binary())])
INFO = np.dtype([("doc_id", "<i8"), ("mark", "<i8"), ("known", "<u1"), ("n", "<u4"), ("high", "<i8"), ("low", "<i8")])
SHARED = "target int, block long, docs binary, counts binary, hashes binary, often binary, info binary"
SHARED_ARROW = pa.schema([("target", pa.int32()), ("block", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("often", pa.binary()), ("info", pa.binary())])
PROFILE = "doc_id long, mark long, row long, n long, prefix int, high long, low long, central long, most long, shared array<long>"
PROFILE_ARROW = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("prefix", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("central", pa.int64()), ("most", pa.int64()), ("shared", pa.list_(pa.int64()))])
SIGNED = "node long, n long, have int, signature array<long>"


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_)))


def _home(block: int, shards: int) -> int:
    """The partition where a block's parts meet again; blocks of all tasks are spread evenly."""
    return (block ^ block // TASK_BLOCKS) % shards


def _deal(shards: int, size: int):
    """Texts to n-gram sets, dealt to shards by hash: for each block of documents and shard one record.

    An n-gram that HEAVY of the block's documents have goes to its shard as one number; who has it goes to the block's home
    at once. So an n-gram of all documents makes one entry a block, not one a document.
    """

    def flush(block: int, sets: list[np.ndarray], info: list[tuple]) -> pa.RecordBatch:
        hashes = np.concatenate([*sets, np.zeros(0, np.uint64)])
        docs = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
        order = np.argsort(hashes)
        starts, times = _runs(hashes[order])
        heavy = np.empty(len(hashes), bool)
        heavy[order] = np.repeat(times >= HEAVY, times)
        often, times = hashes[order][starts[times >= HEAVY]], times[times >= HEAVY].astype("<u4")

        def shard_of(x: np.ndarray) -> np.ndarray:
            return ((x >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.uint16 if shards < 65536 else np.uint32)

        known, with_them = _runs(docs[heavy])
        out = [(_home(block, shards), block, docs[heavy][known].tobytes(), with_them.astype("<u4").tobytes(), hashes[heavy].tobytes(), np.array(info, INFO).tobytes())]
        hashes, docs = hashes[~heavy], docs[~heavy]
        shard = shard_of(hashes)
        order = np.argsort(shard, kind="stable")
        hashes, docs = hashes[order], docs[order]
        edges = np.arange(shards + 1)
        cuts, marks = np.searchsorted(shard[order], edges).tolist(), np.searchsorted(shard_of(often), edges).tolist()
        for s in range(shards):
            a, b = cuts[s : s + 2]
            if a < b:
                starts, counts = _runs(docs[a:b])
                out.append((s, block, docs[a:b][starts].tobytes(), counts.astype("<u4").tobytes(), hashes[a:b].tobytes(), None))
            a, b = marks[s : s + 2]
            if a < b:
                out.append((s, block, None, times[a:b].tobytes(), often[a:b].tobytes(), None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), DEALT_ARROW, strict=True)], schema=DEALT_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fresh()
        first, words = TaskContext.get().partitionId() * TASK_BLOCKS, WordHashes()
        block, sets, info, held = first, [], [], 0
        for b in batches:
            for doc_id, mark, text in rows_of(b):
                found = np.unique(ngram_hashes(words.of(text.encode().translate(LOWER).split()), size))
                high, low = divmod(xxhash.xxh3_128_intdigest(found.tobytes()), 1 << 64)
                sets.append(found)
                info.append((doc_id or 0, mark, doc_id is not None, len(found), high - (1 << 63), low - (1 << 63)))
                held += len(found)
                if held >= BLOCK or len(sets) >= BLOCK_ROWS:
                    yield flush(block, sets, info)
                    block, sets, info, held = block + 1, [], [], 0
                    if block - first >= TASK_BLOCKS:
                        raise ValueError(f"a partition has over {TASK_BLOCKS} blocks of n-grams; read it in more partitions")
        if sets:
            yield flush(block, sets, info)

    return run


def _count(shards: int):
    """A shard's hashes that two documents or more have, with how many have them, dealt back to their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        records, hashes, owners, numbers, out = [], [], [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["info"] is not None:
                    out.append((_home(r["block"], shards), r["block"], r["docs"], r["counts"], r["hashes"], None, r["info"]))
                    continue
                found, counts, at = np.frombuffer(r["hashes"], "<u8"), np.frombuffer(r["counts"], "<u4"), np.uint64(len(records) << 32)
                one_each = r["docs"] is not None
                records.append((r["block"], one_each))
                owners.append(np.repeat(np.frombuffer(r["docs"], "<u4").astype(np.uint64) | at, counts) if one_each else np.full(len(found), at))
                numbers.append(np.ones(len(found), "<u4") if one_each else counts)
                hashes.append(found)
        if hashes:
            every, owner, number = np.concatenate(hashes), np.concatenate(owners), np.concatenate(numbers)
            del hashes, owners, numbers
            order = np.argsort(every)
            every, owner, number = every[order], owner[order], number[order]
            starts, lengths = _runs(every)
            often = np.repeat(np.add.reduceat(number, starts, dtype=np.int64), lengths)
            keep = often >= 2
            every, owner, often = every[keep], owner[keep], np.minimum(often[keep], (1 << 32) - 1).astype("<u4")
            order = np.argsort(owner, kind="stable")
            every, owner, often = every[order], owner[order], often[order]
            record = (owner >> np.uint64(32)).astype(np.int64)
            starts, lengths = _runs(record)
            for a, n in zip(starts.tolist(), lengths.tolist(), strict=True):
                block, one_each = records[int(record[a])]
                docs = counts = None
                if one_each:
                    own = (owner[a : a + n] & np.uint64(0xFFFFFFFF)).astype("<u4")
                    first, times = _runs(own)
                    docs, counts = own[first].tobytes(), times.astype("<u4").tobytes()
                out.append((_home(block, shards), block, docs, counts, every[a : a + n].tobytes(), often[a : a + n].tobytes(), None))
        for i in range(0, len(out), 200):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 200], strict=True), SHARED_ARROW, strict=True)], schema=SHARED_ARROW)

    return run


def _profiles(num: int, den: int):
    """Each document's n-grams that others have too, rarest first, and how many of them are in its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        blocks: dict[int, list] = {}
        heavy: dict[int, list] = {}
        infos: dict[int, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["info"] is not None:
                    infos[r["block"]] = (r["info"], r["docs"], r["counts"], r["hashes"])
                elif r["docs"] is not None:
                    blocks.setdefault(r["block"], []).append((r["docs"], r["counts"], r["hashes"], r["often"]))
                else:
                    heavy.setdefault(r["block"], []).append((r["hashes"], r["often"]))
        for block, (packed, *shared) in infos.items():
            info = np.frombuffer(packed, INFO)
            parts = blocks.pop(block, [])
            if told := heavy.pop(block, []):
                keys, numbers = np.concatenate([np.frombuffer(h, "<u8") for h, _ in told]), np.concatenate([np.frombuffer(o, "<u4") for _, o in told])
                order = np.argsort(keys)
                parts.append((*shared, numbers[order][np.searchsorted(keys[order], np.frombuffer(shared[2], "<u8"))].tobytes()))
            docs = np.concatenate([np.repeat(np.frombuffer(d, "<u4"), np.frombuffer(c, "<u4")) for d, c, _, _ in parts] + [np.zeros(0, "<u4")]).astype(np.int64)
            hashes = np.concatenate([np.frombuffer(h, "<u8") for _, _, h, _ in parts] + [np.zeros(0, "<u8")])
            often = np.concatenate([np.frombuffer(o, "<u4") for *_, o in parts] + [np.zeros(0, "<u4")])
            n = info["n"].astype(np.int64)
            have = np.bincount(docs, minlength=len(info))
            prefix = np.where(n > 0, n + (-num * n // den) + 1 - (n - have), 0)
            linkable = (prefix > 0) & (have > 0)
            use = linkable[docs]
            docs, hashes, often = docs[use], hashes[use], often[use]
            order = np.lexsort((hashes, often, docs))
            sizes = np.where(linkable, have, 0)
            ends = np.append(0, np.cumsum(sizes))
            last = np.where(linkable, ends[:-1] + prefix - 1, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(info["doc_id"], pa.int64(), mask=info["known"] == 0),
                    pa.array(info["mark"], pa.int64()),
                    pa.array(block * BLOCK_ROWS + np.arange(len(info)), pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(np.where(linkable, prefix, 0), pa.int32()),
                    pa.array(info["high"], pa.int64()),
                    pa.array(info["low"], pa.int64()),
                    pa.array((1000 * np.bincount(docs, often, len(info)) / np.maximum(n, 1)).astype(np.int64), pa.int64()),
                    pa.array(np.where(linkable, np.append(often[order], 0)[last], 0).astype(np.int64), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[order].view("<i8"), pa.int64())),
                ],
                schema=PROFILE_ARROW,
            )

    return run


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, shared) to SIGNED: bit i of a signature is the parity of the n-grams whose hash ends in i."""
    for b in batches:
        sets = b.column(2)
        sizes = sets.value_lengths().to_numpy()
        hashes = sets.flatten().to_numpy().view(np.uint64)
        place = np.repeat(np.arange(b.num_rows) * SIGNATURE, sizes) + (hashes >> np.uint64(6) & np.uint64(SIGNATURE - 1)).astype(np.int64)
        order = np.argsort(place)
        starts, _ = _runs(place[order])
        words = np.zeros(b.num_rows * SIGNATURE, np.uint64)
        if len(starts):
            words[place[order][starts]] = np.bitwise_xor.reduceat((np.uint64(1) << (hashes & np.uint64(63)))[order], starts)
        signatures = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * SIGNATURE, pa.int32()), pa.array(words.view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), signatures], names=["node", "n", "have", "signature"])


def profiles(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """A written table with PROFILE's columns: one row for each row of docs."""
    shards = partitions(docs.sparkSession)
    dealt = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark")).mapInArrow(_deal(shards, size), DEALT)
    counted = dealt.repartitionById(shards, F.col("target")).mapInArrow(_count(shards), SHARED)
    return written(counted.repartitionById(shards, F.col("target")).mapInArrow(_profiles(num, den), PROFILE), "profiles")


def text_mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sizes_fit(a: Column, b: Column, num: int, den: int) -> Column:
    return den * F.least(a, b) >= num * F.greatest(a, b)


def _stars(rows: DataFrame, first: list[str], *key: str) -> DataFrame:
    """(a, b) from the node of each key that is largest by the columns `first` to its others, in two steps over salted keys.

    rows: key, node, most and first. Salts grow with `most`, the count of a node's commonest n-gram in its prefix.
    """
    salts = F.greatest(F.lit(SALTS), F.ceil(F.col("most") / SALTED))
    salted = rows.withColumns({"salt": F.pmod(F.xxhash64(F.lit(1), "node"), salts), "rank": F.struct(*first, "node")})
    near = salted.withColumn("head", F.max("rank").over(Window.partitionBy(*key, "salt")))
    heads = near.where(F.col("node") == F.col("head.node")).withColumn("top", F.max("rank").over(Window.partitionBy(*key)))
    return near.where(F.col("node") != F.col("head.node")).select(F.col("head.node").alias("a"), F.col("node").alias("b")).union(
        heads.where(F.col("node") != F.col("top.node")).select(F.col("top.node").alias("a"), F.col("node").alias("b"))
    )


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, compared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of pairs(a, b) that aren't among those compared before, the ones that link; and all compared now or before.

    sets: written, (node, n, shared).
    """
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("s_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    sized = pairs.join(left, "a").join(right, "b").where(_sizes_fit(F.col("n_a"), F.col("n_b"), num, den))
    linked = sized.withColumn("both", both).where(den * F.col("both") >= num * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")
    return written(linked, "linked"), pairs if compared is None else compared.union(pairs)


def _still_apart(members: DataFrame, leaders: DataFrame, places: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members with group and root; groups in several components; and the places at n-grams where components meet."""
    where = written(members.join(roots, "node").join(leaders.withColumnRenamed("node", "group"), ["same_prefix", "n"]).select("node", "group", "root"), "where")
    spread = where.groupBy("group").agg(F.min("root").alias("low_root"), F.max("root").alias("high_root"), F.count("*").alias("size"))
    met = written(places.join(spread.withColumnRenamed("group", "node"), "node"), "met")
    grams = met.groupBy("gram").agg(F.min("low_root").alias("l"), F.max("high_root").alias("h")).where("l <> h").select("gram")
    return where, spread.where("low_root <> high_root").select("group"), written(met.join(grams, "gram", "left_semi"), "apart")


def _may_link(num: int, den: int) -> Column:
    """Whether two sets, signed with suffixes _a and _b, can have the overlap that a link needs, by their signatures.

    Each bit in which the signatures differ takes an n-gram that only one of the sets has, so the common ones are half of
    what is left at most. N-grams that nobody else has are in no signature.
    """
    bits = F.zip_with("signature_a", "signature_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda total, x: total + x)
    n_a, n_b = F.col("n_a"), F.col("n_b")
    return _sizes_fit(n_a, n_b, num, den) & (F.col("have_a") + F.col("have_b") - apart >= 2 * _least(n_a, n_b, num, den))


def _least(n_a: Column, n_b: Column, num: int, den: int) -> Column:
    """The overlap that a link of two sets takes."""
    return F.ceil(num * (n_a + n_b) / (num + den))


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{side}") for c in df.columns))


def _inside(where: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of one group and two components. where: group, root and SIGNED."""
    one, two = _sided(where, "a"), _sided(where, "b")
    met = (F.col("group_a") == F.col("group_b")) & F.expr("node_a < node_b AND root_a <> root_b")
    return one.join(two, met & _may_link(num, den)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _across(apart: DataFrame, where: DataFrame, num: int, den: int, again: bool) -> DataFrame:
    """(a, b) of two components and of two groups that meet, as far as sizes, places in the prefixes and signatures allow a link.

    apart: gram, at, low_root, high_root, size and SIGNED; where: group, root and SIGNED. A leader's signature holds
    for a group of one member; pairs with larger groups are judged by their members' as they are expanded.
    again: pairs of groups of one member each were compared before.
    """
    one, two = _sided(apart, "a"), _sided(apart, "b")
    # at the first n-gram that both have, the common ones are all still to come: in either set there must be as many left
    least = _least(F.col("n_a"), F.col("n_b"), num, den)
    enough = (F.col("have_a") - F.col("at_a") >= least) & (F.col("have_b") - F.col("at_b") >= least)
    two_roots = (F.col("low_root_a") != F.col("low_root_b")) | (F.col("low_root_a") != F.col("high_root_a")) | (F.col("low_root_b") != F.col("high_root_b"))
    several = (F.col("size_a") > 1) | (F.col("size_b") > 1)
    fit = several & _sizes_fit(F.col("n_a"), F.col("n_b"), num, den) if again else several & _sizes_fit(F.col("n_a"), F.col("n_b"), num, den) | _may_link(num, den)
    met = one.join(two, (F.col("gram_a") == F.col("gram_b")) & (F.col("node_a") < F.col("node_b")) & two_roots & enough & fit)
    met = met.select(F.col("node_a").alias("group_a"), F.col("node_b").alias("group_b")).distinct()
    found = met.join(_sided(where, "a"), "group_a").join(_sided(where, "b").withColumnRenamed("group_b", "other"), (F.col("group_b") == F.col("other")) & F.expr("root_a <> root_b") & _may_link(num, den))
    return found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """roots(node, root) after further links(a, b)."""
    if more.isEmpty():
        return roots
    by_root = more.join(roots.toDF("a", "root_a"), "a").join(roots.toDF("b", "root_b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    top = connected_components(roots.select(F.col("root").alias("node")).distinct(), by_root)
    return written(roots.join(top.toDF("root", "top"), "root").select("node", F.col("top").alias("root")), "roots")


def links(found: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (high, low, n, node, least_id) of profiles `found`, and (node, root) for their nodes.

    A document with fewer shared n-grams than the least overlap can't link. Of the others, equal sets are one class.
    Classes with the same prefix and size are a group; groups meet at each n-gram of their prefixes. First each meeting
    place links its most central node, and the one of the largest group, to the others. Central is the mean number of
    documents that have a node's n-grams: of copies with different edits, the one that the others resemble most has
    the highest. What is linked by then needs no further look, so that of the pairs of
    groups that meet only those in different components are left, as far as sizes, places in the prefixes and signatures
    allow the overlap. These are compared by one member of each component in each group, and, where components are still
    apart, expanded to all their members of different components. The join tests signatures as it meets a pair, so
    that most near misses never become rows; their tests still grow with the product of the components' sizes.
    """
    able = found.where("prefix > 0")
    classes = written(able.groupBy("high", "low", "n").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id")), "classes")
    sets = able.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    sets = sets.withColumn("same_prefix", F.xxhash64("n", F.slice("shared", 1, F.col("prefix"))))
    sets = written(sets.select(F.col("row").alias("node"), "n", "prefix", "same_prefix", "central", "most", "shared"), "sets")
    members = sets.select("node", "n", "same_prefix", "central", "most")
    leaders = members.groupBy("same_prefix", "n").agg(F.min("node").alias("node"), F.count("*").alias("size"))
    places = sets.join(leaders.select("node", "size"), "node").select(
        "node", "central", "most", "size", F.posexplode(F.slice("shared", 1, F.col("prefix"))).alias("at", "gram")
    )
    places = written(places, "places")
    inside = _stars(members, ["central"], "same_prefix", "n")
    between = [_stars(places.select("gram", "node", "most", *first), first, "gram") for first in (["central"], ["size", "central"])]
    linked, compared = _verified(inside.union(between[0]).union(between[1]), sets, num, den)
    roots = connected_components(sets.select("node"), linked)
    members, leaders, places = members.drop("central", "most"), leaders.drop("size"), places.drop("size", "central", "most")
    for look in ("one of each component", "all"):
        where, split, apart = _still_apart(members, leaders, places, roots)
        if look != "all":
            where = where.groupBy("group", "root").agg(F.min("node").alias("node")).select("node", "group", "root")
        meeting = apart.select(F.col("node").alias("group")).union(split).distinct()
        where = written(where.join(meeting, "group", "left_semi"), "meeting")
        signed = written(sets.join(where, "node", "left_semi").select("node", "n", "shared").mapInArrow(_signed, SIGNED), "signed")
        where = where.join(signed, "node")
        pairs = _inside(where.join(split, "group", "left_semi"), num, den).union(_across(apart.join(signed, "node"), where, num, den, look == "all"))
        linked, compared = _verified(pairs, sets, num, den, compared)
        roots = _merged(roots, linked)
    return classes, roots


def similar_documents(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_shingles, component_id, mark, leads.

    Words: runs of characters other than ASCII blanks, A-Z lower-cased. A document's set: its distinct runs of `size`
    words (64-bit hashes of them), or its whole sequence if it has fewer. Two link when den * common >= num * union;
    component_id is the smallest doc_id that links reach. leads: true for one row of each component, which has that id;
    mark: a hash of the text.

    N-grams are hashed and dealt to shards, which count in how many documents each is; the order of prefixes is rarest
    first. Only those that others have too go on, as a common part can have no others. See links for the rest.

    Null or empty text: an empty set, linked with nothing. Null doc_id: component_id is the smallest known id in its
    component, or null. Rows with equal doc_id are documents of their own. Empty table: no rows. Other columns are not
    read. The order of rows must be the same when a task runs again, as it is where docs is read from files.
    """
    found = profiles(docs, size, num, den)
    classes, roots = links(found, num, den)
    where = written(classes.join(roots, "node"), "classes")
    least = written(where.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min(F.struct(F.col("least_id").isNull(), "least_id", "node")).alias("first")), "least")
    ends = written(where.join(least, "root").select("high", "low", "n", "component_id", (F.col("node") == F.col("first.node")).alias("first")), "ends")
    able = found.where("prefix > 0").select("doc_id", "mark", "row", "n", "high", "low").join(ends, ["high", "low", "n"])
    # of a class with the component's smallest id, the first row that has it
    own = Window.partitionBy("high", "low", "n", "doc_id")
    same = able.where(F.col("first") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    same = same.withColumn("leads", F.col("row") == F.min("row").over(own))
    rest = able.where(~(F.col("first") & F.col("doc_id").eqNullSafe(F.col("component_id")))).withColumn("leads", F.lit(False))
    linked = same.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "mark", "leads")
    alone = found.where("prefix <= 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "mark", F.lit(True).alias("leads"))
    return linked.unionByName(alone)


def without_similar(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """docs, of each component the row that leads it, with all its columns; of rows alike in doc_id and text one.

    Null or empty text: linked with nothing, so the row stays, but repeated (doc_id, text) rows are one; null counts as
    empty. Null doc_id: leads only a component without any id. Ties: rows of one doc_id and text are the same to this
    operator, and any one of them stays. Empty table: no rows. Other columns are kept, whatever their names.
    """
    stay = similar_documents(docs, size, num, den).where("leads").select(row_key(F.col("doc_id"), F.col("mark")).alias("key"))
    return one_of_each(docs, row_key(F.col("doc_id"), text_mark()), stay)

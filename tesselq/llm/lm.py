"""Language-model scores from an Elias-Fano trie of n-grams, in memory-mapped levels."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEPT, LOWER, mixed, new_folder, partitions, rows_of, text_of, written
from .elias_fano import EliasFano, build, load, part_of, prefixed, save, spread

U = np.uint64
#: Tokens that are handled at once.
BLOCK = 400_000
#: Dealt counts that a task holds, at least, before it sums them.
HELD = 4_000_000
#: The end of a text; no word has its bytes. It also stands before the first word, as a context.
END = b"\n"
#: Probabilities and back-off weights are kept as 16 bits: steps of their log10, down to 10^-19.66. The least that can occur
#: is (1 - DISCOUNT) / n, which is 10^-19.57 for the largest 64-bit count n, so none is clipped.
STEP_LOG10 = 0.0003
CODEBOOK = 10.0 ** (-STEP_LOG10 * np.arange(1 << 16))
DISCOUNT = 0.75
DEALT = "target int, keys binary, counts binary"
BUILT = "shard int, n long, tokens long, widest long"


def code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP_LOG10), 0, len(CODEBOOK) - 1).astype(np.uint16)


def left_over(seen: np.ndarray, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of the shorter context for contexts seen so often, with successors (their contexts: own) of these counts."""
    rest = seen.copy()
    np.subtract.at(rest, own, counts)
    return (rest + DISCOUNT * np.bincount(own, minlength=len(seen))) / seen


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and steps of as few bytes as the largest needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys).astype("<u8")
    size = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + keys[:1].astype("<u8").tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, U)
    steps = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, raw[0])
    wide = np.zeros((len(steps) + 1, 8), np.uint8)
    wide[0] = np.frombuffer(raw, np.uint8, 8, 1)
    wide[1:, : raw[0]] = steps
    return np.cumsum(wide.view("<u8").ravel(), dtype=U)


def pack_counts(counts: np.ndarray) -> bytes:
    return b"1" + counts.astype("u1").tobytes() if counts.max(initial=0) < 256 else b"4" + counts.astype("<u4").tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "u1" if raw[:1] == b"1" else "<u4", offset=1).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def dealt(keys: np.ndarray, counts: np.ndarray, target: np.ndarray, shards: int) -> pa.RecordBatch | None:
    """One record for each target that has keys."""
    order = np.lexsort((keys, target))
    keys, counts = keys[order], counts[order]
    cuts = np.searchsorted(target[order], np.arange(shards + 1)).tolist()
    out = [(t, pack_keys(keys[a:b]), pack_counts(counts[a:b])) for t, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
    if not out:
        return None
    t, k, c = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], ["target", "keys", "counts"])


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """What was dealt to each target of this task, summed; also on the way, when it is twice the last sum."""
    own: dict[int, list] = {}
    held: dict[int, int] = {}
    most: dict[int, int] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))

    for b in batches:
        for target, keys, counts in rows_of(b):
            parts = own.setdefault(target, [])
            parts.append((unpack_keys(keys), unpack_counts(counts)))
            held[target] = held.get(target, 0) + len(parts[-1][0])
            if held[target] > most.get(target, HELD):
                parts[:] = [merged(parts)]
                held[target] = len(parts[0][0])
                most[target] = max(HELD, 2 * held[target])
    return {t: merged(parts) for t, parts in own.items()}


@dataclass(frozen=True)
class Model:
    """Where a trie lies and what its levels hold; small, so it travels with tasks."""

    folder: str
    shards: int
    offsets: tuple[int, ...]  # of word ids, by shard of the word's hash
    tokens: int
    bigram_offsets: tuple[int, ...] = ()
    widest: int = 1  # most successors of a word

    @property
    def types(self) -> int:
        return self.offsets[-1]

    @property
    def id_bits(self) -> int:
        return max(1, self.types.bit_length())

    @property
    def rank_bits(self) -> int:
        return max(1, self.widest.bit_length())


_OPEN: OrderedDict = OrderedDict()
KEPT.append(_OPEN)


def level(model: Model, name: str, shard: int) -> dict:
    """A level's shard, mapped; its Elias-Fano parts are readers. Stays open from task to task."""
    at = f"{model.folder}/{name}-{shard}.bin"
    if at not in _OPEN:
        arrays = load(at)
        parts = {k.split(".")[0] for k in arrays if "." in k}
        _OPEN[at] = {k: v for k, v in arrays.items() if "." not in k} | {p: EliasFano(part_of(arrays, p)) for p in parts}
        while len(_OPEN) > 4000:
            _OPEN.popitem(last=False)
    return _OPEN[at]


def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def segments(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places of its items."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    at = shard[order]
    cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
        yield int(at[a]), order[a:b]


class Words(dict):
    """Numbers of words in order of appearance, END first, and what `of` gives for their hashes; emptied, between blocks,
    when there are over `most`."""

    def __init__(self, of: Callable[[np.ndarray], np.ndarray], most: int = 500_000):
        super().__init__()
        self.of, self.most = of, most
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.values = np.zeros(0, np.int64)
        self[END]

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def known(self) -> np.ndarray:
        """What `of` gives for each number."""
        if self.new:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.new), U, len(self.new))
            found = self.of(hashes)
            self.values = np.concatenate([self.values, found]) if len(self.values) else found
            self.new = []
        return self.values


def blocks(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, numbers of all tokens (END before and after each text's words) and where each text starts."""
    end = np.zeros(1, np.int32)
    ids, parts, starts, held = [], [], [], 0
    for b in batches:
        for doc_id, text in rows_of(b):
            found = words.numbers(text.encode().translate(LOWER).split())
            ids.append(doc_id)
            starts.append(held)
            parts += [end, found, end]
            held += len(found) + 2
            if held >= BLOCK:
                yield ids, np.concatenate(parts), np.array(starts)
                ids, parts, starts, held = [], [], [], 0
                if len(words) > words.most:
                    words.restart()
    if ids:
        yield ids, np.concatenate(parts), np.array(starts)


IDS = "doc_id long, learn boolean, ids binary"


def id_blocks(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """As blocks, but of IDS rows, with word ids (-1: unknown) for hashes."""
    kind = id_type(model)
    ids, parts, starts, held = [], [], [], 0
    for b in batches:
        for doc_id, _, raw in rows_of(b):
            found = np.frombuffer(raw, kind).astype(np.int64) - 1
            ids.append(doc_id)
            starts.append(held)
            parts.append(found)
            held += len(found)
            if held >= BLOCK:
                yield ids, np.concatenate(parts), np.array(starts)
                ids, parts, starts, held = [], [], [], 0
    if ids:
        yield ids, np.concatenate(parts), np.array(starts)


def id_type(model: Model) -> str:
    return "<u4" if model.types < (1 << 32) - 1 else "<u8"


def _ids(model: Model):
    """Texts to IDS rows: ids + 1, 0 for unknown words, END before and after."""
    kind = id_type(model)

    def run(batches):
        learn: list[bool] = []

        def noted(batches):
            for b in batches:
                learn.extend(b.column(2).to_pylist())
                yield b.select([0, 1])

        words = Words(lambda hashes: (word_ids(model, hashes) + 1).astype(kind))
        for ids, numbers, starts in blocks(noted(batches), words):
            packed = words.known()[numbers]
            cuts = [*starts.tolist(), len(packed)]
            own, learn[: len(ids)] = learn[: len(ids)], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.bool_()), pa.array([packed[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["doc_id", "learn", "ids"])

    return run


def word_ids(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Ids (-1: unknown) of words by hash."""
    ids = np.full(len(hashes), -1, np.int64)
    if model.tokens:
        for s, at in segments(word_shard(hashes, model.shards)):
            found = level(model, "words", s)["hashes"].find(hashes[at])
            ids[at[found >= 0]] = found[found >= 0] + model.offsets[s]
    return ids


def pair_lookup(model: Model, u: np.ndarray, v: np.ndarray, codes: bool) -> tuple[np.ndarray, ...]:
    """For contexts u (known ids) and words v: the bigram's place (-1: none), its rank among the successors of u, how many
    these are, and, if asked for, the word's discounted probability and the weight of u's shorter context."""
    place, rank, room = np.full(len(u), -1, np.int64), np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
    direct, weight = (np.zeros(len(u)), np.ones(len(u))) if codes else (None, None)
    for s, at in segments(np.searchsorted(model.offsets, u, side="right") - 1):
        second = level(model, "pairs", s)
        own, back = np.unique(u[at] - model.offsets[s], return_inverse=True)
        bounds = second["pointers"].read(np.concatenate([own, own + 1])).astype(np.int64)
        first, n = bounds[: len(own)][back], np.diff(bounds.reshape(2, -1), axis=0)[0][back]
        room[at] = n
        if codes:
            weight[at] = CODEBOOK[second["weight"][own]][back]
        ask = np.flatnonzero((v[at] >= 0) & (n > 0))
        found = second["keys"].find(spread(first[ask], n[ask], v[at[ask]], model.types, model.id_bits))
        have = ask[found >= 0]
        found = found[found >= 0]
        place[at[have]] = found + model.bigram_offsets[s]
        rank[at[have]] = found - first[have]
        if codes:
            direct[at[have]] = CODEBOOK[second["direct"][found]]
    return place, rank, room, direct, weight


def triple_lookup(model: Model, context: np.ndarray, rank: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For bigrams `context` (places) and words by their rank among the successors of the context's second word, of which
    there are `room`: as pair_lookup's last two."""
    direct, weight = np.zeros(len(context)), np.ones(len(context))
    for s, at in segments(triple_shard(context.astype(U), model.shards)):
        third = level(model, "triples", s)
        own = third["contexts"].find(context[at].astype(U))
        have = np.flatnonzero(own >= 0)
        weight[at[have]] = CODEBOOK[third["weight"][own[have]]]
        ask = have[rank[at[have]] >= 0]
        if not len(ask):
            continue
        first = third["pointers"].read(own[ask]).astype(np.int64)
        n = third["pointers"].read(own[ask] + 1).astype(np.int64) - first
        found = third["keys"].find(spread(first, n, rank[at[ask]], room[at[ask]], model.rank_bits))
        direct[at[ask[found >= 0]]] = CODEBOOK[third["direct"][found[found >= 0]]]
    return direct, weight


def successors(model: Model, u: np.ndarray) -> np.ndarray:
    """How many successors words have."""
    out = np.zeros(len(u), np.int64)
    for s, at in segments(np.searchsorted(model.offsets, u, side="right") - 1):
        pointers, own = level(model, "pairs", s)["pointers"], u[at] - model.offsets[s]
        out[at] = pointers.read(own + 1).astype(np.int64) - pointers.read(own).astype(np.int64)
    return out


def triple_shard(context: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(context + U(7)) % U(shards)).astype(np.int64)


def _words(shards: int):
    def run(batches):
        words = Words(lambda hashes: hashes)
        for _, numbers, starts in blocks(batches, words):
            counts = np.bincount(numbers, minlength=len(words))
            counts[0] -= len(starts)  # END before a text is no token
            at = np.flatnonzero(counts)
            keys = words.known()[at]
            yield dealt(keys, counts[at], word_shard(keys, shards), shards)

    return run


def _save_words(folder: str):
    def run(batches):
        for shard, (keys, counts) in gathered(batches).items():
            small = counts.max() < 1 << 32
            save(f"{folder}/words-{shard}.bin", prefixed("hashes", build(keys, 1 << 64)) | {"counts": counts.astype("<u4" if small else "<u8")})
            yield _built(shard, len(keys), int(counts.sum()), 0)

    return run


def _built(shard: int, n: int, tokens: int, widest: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x], pa.int64()) for x in (n, tokens, widest))], ["shard", "n", "tokens", "widest"])


def _pairs(model: Model, target: Callable[[np.ndarray], np.ndarray], shards: int):
    """Bigrams of the block's texts, as id * types + id, dealt for counting."""

    def run(batches):
        for _, ids, starts in id_blocks(model, batches):
            inside = np.ones(len(ids) - 1, bool)
            inside[starts[1:] - 1] = False
            keys = ids[:-1][inside].astype(U) * U(model.types) + ids[1:][inside].astype(U)
            keys, counts = np.unique(keys, return_counts=True)
            yield dealt(keys, counts, target(keys), shards)

    return run


def _triples(model: Model, target: Callable[[np.ndarray], np.ndarray], shards: int):
    """Trigrams both of whose bigrams the trie has, as place * widest + rank, dealt for counting."""

    def run(batches):
        for _, ids, starts in id_blocks(model, batches):
            place, rank, *_ = pair_lookup(model, ids[:-1], ids[1:], False)
            place[starts[1:] - 1] = -1
            both = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0))
            keys, counts = np.unique(place[both].astype(U) * U(model.widest) + rank[both + 1].astype(U), return_counts=True)
            if (out := dealt(keys, counts, target(keys), shards)) is not None:
                yield out

    return run


def _save_pairs(model: Model):
    """Level 2: pointers from words to their successors, these as a monotone sequence, and the quantised numbers."""

    def run(batches):
        for shard, (keys, counts) in gathered(batches).items():
            low, high = model.offsets[shard : shard + 2]
            own = (keys // U(model.types)).astype(np.int64) - low
            each = np.bincount(own, minlength=high - low)
            seen = np.maximum(level(model, "words", shard)["counts"].astype(np.int64), 1)
            direct = (counts - DISCOUNT) / seen[own]
            weight = left_over(seen, own, counts)
            pointers = np.append(0, np.cumsum(each))
            save(
                f"{model.folder}/pairs-{shard}.bin",
                prefixed("keys", build(spread(pointers[own], each[own], (keys % U(model.types)).astype(np.int64), model.types, model.id_bits), len(keys) << model.id_bits, width=model.id_bits))
                | prefixed("pointers", build(pointers, len(keys) + 1, access=True))
                | {"direct": code(direct), "weight": code(weight), "counts": counts.astype("<u8" if counts.max(initial=0) >> 32 else "<u4")},
            )
            yield _built(shard, len(keys), int(counts.sum()), int(each.max(initial=0)))

    return run


def _save_triples(model: Model):
    """Level 3: contexts (bigrams) and, relative to each, the ranks of the words after it."""

    def run(batches):
        for shard, (keys, counts) in gathered(batches).items():
            context = keys // U(model.widest)
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            contexts = context[first].astype(np.int64)
            own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
            each = np.diff(np.append(first, len(keys)))
            seen, second_word = np.ones(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
            for s, at in segments(np.searchsorted(model.bigram_offsets, contexts, side="right") - 1):
                second, local = level(model, "pairs", s), contexts[at] - model.bigram_offsets[s]
                seen[at] = second["counts"][local]
                second_word[at] = second["keys"].low(local)
            room = successors(model, second_word)
            direct = (counts - DISCOUNT) / seen[own]
            weight = left_over(seen, own, counts)
            ranks = spread(first[own], each[own], (keys % U(model.widest)).astype(np.int64), room[own], model.rank_bits)
            save(
                f"{model.folder}/triples-{shard}.bin",
                prefixed("contexts", build(contexts, model.bigram_offsets[-1]))
                | prefixed("pointers", build(np.append(first, len(keys)), len(keys) + 1, access=True))
                | prefixed("keys", build(ranks, len(keys) << model.rank_bits, width=model.rank_bits))
                | {"direct": code(direct), "weight": code(weight)},
            )
            yield _built(shard, len(keys), int(counts.sum()), 0)

    return run


def _empty(model: Model, name: str, shards: set[int]) -> None:
    """Files of a level's shards that got nothing."""
    for s in shards:
        none = np.zeros(0, U)
        if name == "words":
            save(f"{model.folder}/words-{s}.bin", prefixed("hashes", build(none, 0)) | {"counts": none})
        elif name == "pairs":
            n = model.offsets[s + 1] - model.offsets[s]
            save(f"{model.folder}/pairs-{s}.bin", prefixed("keys", build(none, 0)) | prefixed("pointers", build(np.zeros(n + 1, U), 1, access=True)) | {"direct": none.astype(np.uint16), "weight": np.zeros(n, np.uint16), "counts": none})
        else:
            save(f"{model.folder}/triples-{s}.bin", prefixed("contexts", build(none, 0)) | prefixed("pointers", build(np.zeros(1, U), 1, access=True)) | prefixed("keys", build(none, 0)) | {"direct": none.astype(np.uint16), "weight": none.astype(np.uint16)})


#: Whether Spark removes an action's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def train(docs: DataFrame, learn: Column | None = None, per_shard: int = 16_000_000) -> tuple[Model, DataFrame]:
    """The trie of the texts of docs where `learn` holds (all, if none), with every word, bigram and trigram; and all of
    docs as IDS rows, a written table.

    Counts are summed in each block of texts and dealt to the shards of the trie; no n-gram or word is one task's. There are as
    many shards as shuffle partitions, and more where the texts have over per_shard tokens for each by their bytes, so that
    what a task sorts and writes doesn't grow with the corpus. Shards are written as files in the shared folder. Word ids are
    ranks by hash. The driver learns three numbers of each shard. A level's shuffle files go when it is written.
    """
    spark = docs.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return _train(docs, learn, per_shard)
    finally:
        spark.conf.set(CLEANUP, before)


#: Bytes of a token and its blank, fewer than texts have on average, for the number of shards.
TOKEN_BYTES = 4


def _train(docs: DataFrame, learn: Column | None, per_shard: int) -> tuple[Model, DataFrame]:
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(partitions(spark), -(-size // (TOKEN_BYTES * per_shard)))
    folder = new_folder(spark, "trie")
    used = F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True)
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"), used.alias("learn")).select("doc_id", "text", "learn")

    def built(df: DataFrame, run, name: str, model: Model) -> list[tuple[int, int, int]]:
        out = [(0, 0, 0)] * shards
        for r in df.repartitionById(shards, F.col("target")).mapInArrow(run, BUILT).collect():
            out[r.shard] = (r.n, r.tokens, r.widest)
        _empty(model, name, {s for s, x in enumerate(out) if not x[0]})
        return out

    def offsets(sizes: list[tuple[int, int, int]]) -> tuple[int, ...]:
        return (0, *np.cumsum([n for n, _, _ in sizes]).tolist())

    model = Model(folder, shards, (0,), 0)
    learnt = rows.where("learn").select("doc_id", "text")
    sizes = built(learnt.mapInArrow(_words(shards), DEALT), _save_words(folder), "words", model)
    model = Model(folder, shards, offsets(sizes), sum(t for _, t, _ in sizes))
    ids = written(rows.mapInArrow(_ids(model), IDS), "ids")
    if not model.tokens:
        return model, ids
    bounds, types = np.array(model.offsets), model.types

    def by_first(keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, (keys // U(types)).astype(np.int64), side="right") - 1

    def counted(run, target: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        return ids.where("learn").mapInArrow(run(model, target, shards), DEALT)

    sizes = built(counted(_pairs, by_first), _save_pairs(model), "pairs", model)
    model = Model(folder, shards, model.offsets, model.tokens, offsets(sizes), max(1, *(w for _, _, w in sizes)))
    widest = model.widest

    def by_context(keys: np.ndarray) -> np.ndarray:
        return triple_shard(keys // U(widest), shards)

    built(counted(_triples, by_context), _save_triples(model), "triples", model)
    return model, ids


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(model: Model):
    def run(batches):
        for ids, word, starts in id_blocks(model, batches):
            distinct, back = np.unique(word, return_inverse=True)
            seen = np.zeros(len(distinct), np.int64)
            known = np.flatnonzero(distinct >= 0)
            for s, at in segments(np.searchsorted(model.offsets, distinct[known], side="right") - 1):
                seen[known[at]] = level(model, "words", s)["counts"][distinct[known[at]] - model.offsets[s]]
            count = seen[back]
            single = (count + 1) / (model.tokens + model.types + 1)
            token = np.ones(len(word), bool)
            token[starts] = False
            p = single.copy()
            if model.tokens:
                u = np.flatnonzero((word[:-1] >= 0) & token[1:])  # pairs within a text, of a known context
                # at a pair's second word: the pair's place, its rank after the first, and the room there
                place, rank, room = np.full(len(word), -1), np.full(len(word), -1), np.zeros(len(word), np.int64)
                place[u + 1], rank[u + 1], room[u + 1], direct, weight = pair_lookup(model, word[u], word[u + 1], True)
                p[u + 1] = direct + weight * single[u + 1]
                c = np.flatnonzero((place[:-1] >= 0) & token[1:])
                direct, weight = triple_lookup(model, place[c], rank[c + 1], room[c + 1])
                p[c + 1] = direct + weight * p[c + 1]
            sums = (np.add.reduceat(x, starts) for x in (token.astype(np.int64), (token & (count > 0)).astype(np.int64), np.where(token, np.log10(single), 0.0), np.where(token, np.log10(np.minimum(p, 1.0)), 0.0)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(ids: DataFrame, model: Model) -> DataFrame:
    """SCORES' columns for each of IDS rows.

    The model interpolates orders 3, 2 and 1 with absolute discounting; what rare n-grams would have got goes to the
    shorter context, where single words have count + 1 of all tokens and types and one. Unknown words end a context.
    """
    return ids.mapInArrow(_score(model), SCORES)


def indexed(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) as IDS rows of a model."""
    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", "text", F.lit(False).alias("learn")).mapInArrow(_ids(model), IDS)


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """crc32 of the id as text, mod folds, is `fold`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def score_held_out(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """Learns from the documents that aren't held out and scores all: SCORES' columns, held_out and train_tokens.

    Tokens: runs of characters other than ASCII blanks, A-Z lower-cased, then one end. Null text: empty, which is the
    end alone. Null doc_id: by the fold of the empty text. Repeated rows: count and are scored each. Empty table: no
    rows; nothing to learn from: single words alone, all unknown. Other columns are not read.
    """
    model, ids = train(docs, ~held_out(F.col("doc_id"), folds, fold))
    return score(ids, model).select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )

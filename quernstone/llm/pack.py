"""Filling containers of fixed capacity with texts, lexical neighbours together.

The scan's partitions are worked through in shards of consecutive items, so no text is shuffled; a shard ends at a number of
items or of tokens, whichever comes first. Each shard gets a BM25 inverted index. The largest unused item opens a container;
the index returns the unused neighbours of that seed, best first, and those that fit are taken until there is room for two
usual items. That room goes to the best neighbour that fills it, alone or with another item, to within what
``Settings.least_fill`` allows; where there is none, to the one or two items that fill it best. Items of containers that stay
emptier than ``Settings.least_fill`` are packed again over shard borders by best fit, in groups of bounded size (sizes only;
that round knows no neighbours).

Defined results: an item larger than the capacity is divided: its full pieces fill containers of their own, its rest is
packed like any item; nothing else is divided. Null and empty texts have size 0 and are placed with others of their shard
(in a container of their own only where a shard holds nothing else). Exact duplicate rows are items of their own unless the
caller removes them. A capacity below 1 raises ``ValueError``. Each item, or piece of one, is in exactly one container.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.tokens import Vocabulary, encode_array
from quernstone.plans.lineage import staged


@dataclass(frozen=True)
class Settings:
    capacity: int
    #: Items of an index. More give more and closer neighbours; the time grows in proportion.
    shard: int = 4096
    #: Tokens of an index; a shard ends with the texts that reach this number.
    shard_tokens: int = 4_000_000
    #: Terms of a seed that query the index: those with the largest weight, or all (None). Of 4,096 documents 2,572 come to
    #: their container as neighbours with 48 terms, 2,722 with all of them, which takes 15 times as long.
    query_terms: int | None = 48
    #: Hashed terms are pairs of consecutive token ids; their number bounds an index's vocabulary.
    term_bits: int = 20
    k1: float = 1.2
    b: float = 0.75
    #: Containers filled less than this are opened again.
    least_fill: float = 0.98
    #: Items that one task of the second round packs.
    second_round: int = 100_000

    def __post_init__(self) -> None:
        if self.capacity < 1:
            raise ValueError(f"no container holds {self.capacity}")
        if self.shard > 1 << 32 - self.term_bits:
            raise ValueError("item and term of an index must fit into 32 bits")


class Index:
    """BM25 inverted index over the terms of a shard's items."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, s: Settings) -> None:
        n, bits = len(lengths), s.term_bits
        item = np.repeat(np.arange(n, dtype=np.uint32), lengths)
        pair = ids[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids[1:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        term = (pair >> np.uint64(64 - bits)).astype(np.uint32)
        inside = item[1:] == item[:-1]
        # Item and term fit into 32 bits, whose sort is the cheap one.
        keys, tf = np.unique(item[:-1][inside] << np.uint32(bits) | term[inside], return_counts=True)
        self.item, term = keys >> np.uint32(bits), keys & np.uint32((1 << bits) - 1)
        self.first = np.searchsorted(self.item, np.arange(n + 1))  # an item's terms lie together
        df = np.bincount(term, minlength=1 << bits)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = s.k1 * (1 - s.b + s.b * lengths / max(1.0, lengths.mean())) if n else np.zeros(0)
        self.term, self.weight = term, idf[term] * tf * (s.k1 + 1) / (tf + norm[self.item])
        # Postings: the same entries by term.
        by_term = np.sort(term.astype(np.uint64) << np.uint64(32) | np.arange(len(term), dtype=np.uint64))
        at = (by_term & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.postings, self.posting_weight = self.item[at].astype(np.int64), self.weight[at]
        self.counts, self.starts = df, np.cumsum(df) - df
        self.n, self.query_terms = n, s.query_terms

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every item for the seed's terms of largest weight."""
        own = slice(self.first[seed], self.first[seed + 1])
        slots = self.term[own]
        if self.query_terms is not None and len(slots) > self.query_terms:
            slots = slots[np.argpartition(-self.weight[own], self.query_terms)[: self.query_terms]]
        counts = self.counts[slots]
        total = int(counts.sum())
        if not total:
            return np.zeros(self.n)
        ends = np.cumsum(counts)
        at = np.arange(total) + np.repeat(self.starts[slots] - (ends - counts), counts)
        return np.bincount(self.postings[at], weights=self.posting_weight[at], minlength=self.n)


def closest(sizes: np.ndarray, room: int) -> list[int]:
    """Positions of the one or two items (``sizes`` ascending) that fill ``room`` best."""
    n = int(np.searchsorted(sizes, room, side="right"))
    if not n:
        return []
    small = sizes[:n]
    partner = np.minimum(np.searchsorted(small, room - small, side="right") - 1, np.arange(n) - 1)
    sums = np.where(partner >= 0, small + small[partner], 0)
    at = int(np.argmax(sums))
    return [n - 1] if small[n - 1] >= sums[at] else [at, int(partner[at])]


#: How an item came to its container.
SEED, RETRIEVED, BY_SIZE = 0, 1, 2


def neighbour_and_filler(sizes: np.ndarray, live: np.ndarray, near: np.ndarray, room: int, slack: int) -> list[int]:
    """The first of ``near`` that fills ``room`` but for ``slack``, alone or with the largest of ``live`` (ascending) that fits beside it."""
    rest = room - sizes[near]
    at = np.searchsorted(sizes[live], rest, side="right") - 1
    at = np.where((at >= 0) & (live[at] == near), at - 1, at)  # an item is no filler for itself
    filler = np.where(at >= 0, sizes[live[at]], 0)
    full = np.flatnonzero(rest - filler <= slack)
    if not len(full):
        return []
    first = full[0]
    return [int(near[first])] + ([int(live[at[first]])] if at[first] >= 0 and filler[first] else [])


def pack_shard(sizes: np.ndarray, index: Index, capacity: int, least_fill: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Container number of each item (sizes at most the capacity), and how it came there."""
    container, how = np.full(len(sizes), -1, dtype=np.int64), np.full(len(sizes), BY_SIZE, dtype=np.int8)
    live = np.argsort(sizes, kind="stable")  # unused items, ascending
    count, slack = 0, int(capacity * (1 - least_fill))
    while len(live):
        seed = live[-1]
        room = capacity - int(sizes[seed])
        container[seed], how[seed] = count, SEED
        live = live[:-1]
        if room and len(live):
            scores = index.scores(seed)
            near = np.flatnonzero((scores > 0) & (container < 0) & (sizes <= room))
            near = near[np.argsort(-scores[near], kind="stable")]
            # Room for two items of usual size is left to those that fill it.
            reserve = min(room, 2 * int(sizes[live[len(live) // 2]]))
            for at in near[sizes[near] <= room - reserve]:
                if sizes[at] <= room - reserve:
                    container[at], how[at] = count, RETRIEVED
                    room -= int(sizes[at])
            live = live[container[live] < 0]
            near = near[(container[near] < 0) & (sizes[near] <= room) & (sizes[near] > 0)]
            if len(near) and (found := neighbour_and_filler(sizes, live, near, room, slack)):
                container[found] = count
                how[found[0]] = RETRIEVED
                room -= int(sizes[found].sum())
                live = live[container[live] < 0]
        while room and len(live) and (found := closest(sizes[live], room)):
            container[live[found]] = count
            room -= int(sizes[live[found]].sum())
            live = np.delete(live, found)
        if not room and len(live) and sizes[live[0]] == 0:
            empty = live[sizes[live] == 0]
            container[empty], live = count, live[len(empty) :]
        count += 1
    return container, how


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container numbers by best fit, the largest items first."""
    container = np.zeros(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 2, dtype=bool)
    count = 0
    for at in np.argsort(-sizes, kind="stable"):
        size = int(sizes[at])
        room = size + int(np.argmax(filled[size:])) if size <= capacity else capacity + 1
        if room > capacity or not filled[room]:
            number, room = count, capacity
            count += 1
        else:
            number = by_room[room].pop()
            filled[room] = bool(by_room[room])
        container[at] = number
        by_room[room - size].append(number)
        filled[room - size] = True
    return container


#: Texts that are encoded before the size of a shard is looked at again.
STEP = 128


def pack(df: DataFrame, id: str, text: str, settings: Settings, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """(``id``, piece, start, size, container_id, retrieved): where each text, or each piece of one over the capacity, goes.

    ``retrieved`` says whether it came there as a neighbour. Sizes and starts are in tokens. Container ids are strings, unique over the whole table.
    """
    capacity = settings.capacity
    kind = df.schema[id].dataType.simpleString()
    names = [id, "piece", "start", "size", "shard", "container", "fill", "retrieved"]
    schema = f"`{id}` {kind}, piece int, start bigint, size int, shard bigint, container bigint, fill int, retrieved boolean"

    def packed(rows: list[pa.Array], lists: list[pa.ListArray], shard: int) -> pa.RecordBatch:
        keys = pa.concat_arrays(rows)
        ids = np.concatenate([x.flatten().to_numpy() for x in lists])
        lengths = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]).astype(np.int64)
        rests = np.where(lengths > capacity, lengths % capacity, lengths)
        container, how = pack_shard(rests, Index(ids, lengths, settings), capacity, settings.least_fill)
        fills = np.bincount(container, weights=rests, minlength=int(container.max(initial=-1)) + 1).astype(np.int64)
        over = np.flatnonzero(lengths > capacity)
        # A text over the capacity: its full pieces first, then the rest, which is gone if the pieces were even.
        full = lengths[over] // capacity
        who = np.repeat(over, full)
        piece = np.arange(len(who)) - np.repeat(np.cumsum(full) - full, full)
        keep = ~((lengths > capacity) & (rests == 0))
        rest_piece = np.where(lengths > capacity, lengths // capacity, 0)
        at = np.concatenate([np.flatnonzero(keep), who])
        pieces = np.concatenate([rest_piece[keep], piece])
        sizes = np.concatenate([rests[keep], np.full(len(who), capacity)])
        numbers = np.concatenate([container[keep], len(fills) + np.arange(len(who))])
        filled = np.concatenate([fills[container[keep]], np.full(len(who), capacity)])
        retrieved = np.concatenate([how[keep] == RETRIEVED, np.zeros(len(who), dtype=bool)])
        arrays = [keys.take(pa.array(at)), *(pa.array(x, k) for x, k in ((pieces, pa.int32()), (pieces * capacity, pa.int64()), (sizes, pa.int32()), (np.full(len(at), shard), pa.int64()), (numbers, pa.int64()), (filled, pa.int32()), (retrieved, pa.bool_())))]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        rows, lists, held, tokens, shard = [], [], 0, 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(STEP, settings.shard - held))
                at, held = at + part.num_rows, held + part.num_rows
                rows.append(part.column(0))
                lists.append(encode_array(part.column(1), vocabulary))
                tokens += len(lists[-1].values)
                if held == settings.shard or tokens >= settings.shard_tokens:
                    yield packed(rows, lists, partition << 32 | shard)
                    rows, lists, held, tokens, shard = [], [], 0, 0, shard + 1
        if held:
            yield packed(rows, lists, partition << 32 | shard)

    first = staged(df.select(id, text).mapInArrow(work, schema))
    closed = F.col("fill") >= settings.least_fill * capacity
    done = first.where(closed).select(id, "piece", "start", "size", F.concat_ws("-", F.lit("a"), "shard", "container").alias("container_id"), "retrieved")
    return done.unionAll(_again(first.where(~closed), id, settings))


def _again(items: DataFrame, id: str, settings: Settings) -> DataFrame:
    """The second round over the items of badly filled containers."""
    kind = items.schema[id].dataType.simpleString()
    groups = max(1, -(-items.count() // settings.second_round))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            order = table.sort_by([("size", "descending"), (id, "ascending"), ("piece", "ascending")])
            numbers = best_fit(order.column("size").to_numpy(), settings.capacity)
            ids = pa.array([f"b-{partition}-{n}" for n in numbers.tolist()])
            yield from order.append_column("container_id", ids).append_column("retrieved", pa.array(np.zeros(len(ids), dtype=bool))).to_batches()

    spread = items.select(id, "piece", "start", "size").repartition(groups, F.xxhash64(id, "piece"))
    return spread.mapInArrow(work, f"`{id}` {kind}, piece int, start bigint, size int, container_id string, retrieved boolean")


def fills(packed: DataFrame, capacity: int) -> DataFrame:
    """Per container: items, those that were retrieved as neighbours, tokens, and the share of the capacity that is used."""
    return packed.groupBy("container_id").agg(F.count("*").alias("items"), F.count_if("retrieved").alias("retrieved"), F.sum("size").alias("tokens")).withColumn("fill", F.col("tokens") / capacity)

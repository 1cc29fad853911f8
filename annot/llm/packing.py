"""Packing of tokenised documents into sequences of bounded length by bin completion.

Tokenising runs in Spark's tasks; a text longer than a sequence is cut so that all its pieces but the first fill one.
The other pieces are dealt at random to shards of a bounded number of pieces, and each shard is packed by itself, by branch
and bound on the numbers of pieces of each size. Best-fit gives the first incumbent; if it has as few bins as all sizes
together need, it stands. Else the undominated fillings of the room around the largest piece left are tried in the order
of their waste, each for as many bins alike as the numbers allow, and a branch ends when its waste exceeds what one bin
less than the incumbent's would leave. A filling is dominated if a piece left out could replace some of its pieces that
are no larger together, or be added. When a bound on the nodes is reached, the branch at hand is ended with the first
fillings, and the best packing so far is taken.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, written

LENGTH = 1024
END = 2
SHARD_PIECES = 8192
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Encoded words that a Python worker remembers.
MEMO = 200_000
#: Nodes that the search for the first filling of a bin, and that for the fillings of a whole shard, may take.
FILL_NODES, SHARD_NODES = 400, 20_000


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, equal to those of the tokenizer file.

    The pattern of this tokenizer splits before the last space of any run, so a text without double spaces can be cut
    before each space; the parts, mostly words, are remembered. Texts with double spaces or with the name of a special
    token go through the tokenizer file itself.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.full = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        found = np.asarray(self.fast.encode_ordinary(text), "<u4").tobytes()
        if len(text) < 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[text] = found
        return found

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or any(s in text for s in self.special):
            return np.asarray(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        get, part = self.memo.get, self.part
        out = [part(first)] if first else []
        for word in rest:
            word = " " + word
            out.append(get(word) or part(word))
        return b"".join(out)


_encoders: dict[tuple, Encoder] = {}


def tokenizer_files(tokenizer: str | None = None, ranks: str | None = None) -> tuple[str, str, str]:
    import public_tokenizers

    return tokenizer or public_tokenizers.path(TOKENIZER), ranks or public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def _pieces(files: tuple[str, str, str], length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoders.get(files) or _encoders.setdefault(files, Encoder(*files))
        end = np.asarray([END], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                stop = n - (n - 1) // length * length
                start = piece = 0
                while start < n:
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop, piece = stop, stop + length, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, files: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of each row's tokens and end token. Null texts count as empty."""
    id_type = df.schema[doc_id].dataType.simpleString()
    texts = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.mapInPandas(_pieces(files or tokenizer_files(), length), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def _filling(counts: list[int], mask: int, room: int, nodes: int) -> list[int]:
    """The sizes, large ones first, that fill `room` best, of sizes with a bit in mask and no more often than counted."""
    best, least, left = [], room, [nodes]

    def rec(room: int, top: int, chosen: list[int]) -> bool:
        nonlocal best, least
        m = mask & ((1 << (min(room, top) + 1)) - 1)
        while m:
            a = m.bit_length() - 1
            m ^= 1 << a
            if chosen.count(a) >= counts[a]:
                continue
            left[0] -= 1
            if room - a < least:
                best, least = [*chosen, a], room - a
            if least == 0 or left[0] <= 0 or rec(room - a, a, [*chosen, a]):
                return True
        return False

    rec(room, room, [])
    return best


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """Bins by best-fit, large sizes first: each goes where least room is left."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(cap + 1)]
    rooms = 0  # a bit for each room that some bin has
    for s in sorted(sizes, reverse=True):
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            i = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[i].append(s)
        else:
            room, i = cap, len(bins)
            bins.append([s])
        by_room[room - s].append(i)
        rooms |= 1 << (room - s)
    return bins


def dominated(filling: list[int], counts: list[int], mask: int, room: int) -> bool:
    """Whether a size that is left could replace some of the filling's that are no larger together, or be added to it."""
    one, more = 0, 0  # sums of one or more, and of two or more
    for x in filling:
        more |= (one << x) | (more << x)
        one |= more | (1 << x)
        if counts[x] <= filling.count(x):
            mask &= ~(1 << x)
    waste = room - sum(filling)
    reach, width = (one | 1) << 1, 1
    while width < waste:
        reach |= reach << min(width, waste - width)
        width *= 2
    return bool(mask & (more | (reach if waste else 0)))


def fillings_in_order(counts: list[int], mask: int, room: int, left: list[int]) -> Iterator[list[int]]:
    """Undominated fillings of the room, least waste first, large sizes first among these; ends when left[0] nodes are used up."""
    sizes = [s for s in range(room, 0, -1) if mask >> s & 1]
    reach = [1] * (len(sizes) + 1)  # sums of the sizes from each place on
    for i in range(len(sizes) - 1, -1, -1):
        sums = reach[i + 1]
        for _ in range(min(counts[sizes[i]], room // sizes[i])):
            sums |= sums << sizes[i]
        reach[i] = sums & ((1 << (room + 1)) - 1)

    def exact(i: int, total: int, chosen: list[int]) -> Iterator[list[int]]:
        left[0] -= 1
        if not total:
            yield chosen
        elif i < len(sizes) and left[0] > 0:
            s = sizes[i]
            for k in range(min(counts[s], total // s), -1, -1):
                if reach[i + 1] >> (total - k * s) & 1:
                    yield from exact(i + 1, total - k * s, [*chosen, *[s] * k])

    for total in range(room, -1, -1):
        if left[0] <= 0:
            return
        if reach[0] >> total & 1:
            for f in exact(0, total, []):
                if not dominated(f, counts, mask, room):
                    yield f


def _fillings(counts: list[int], mask: int, room: int, left: list[int]) -> Iterator[list[int]]:
    """At least one filling of the room, and all others in order while nodes are left."""
    left[0] -= 1
    first, told = _filling(counts, mask, room, FILL_NODES), False
    if sum(first) == room or left[0] <= 0:  # without waste, and met before those that it dominates
        told = True
        yield first
    if left[0] > 0:
        for f in fillings_in_order(counts, mask, room, left):
            if not (told and f == first):
                told = True
                yield f
    if not told:
        yield first


def branch_and_bound(sizes: list[int], cap: int, nodes: int | None = SHARD_NODES) -> list[list[int]]:
    """Bins of the sizes, as few as the nodes show. Without a number of nodes the search goes on, a bin at a step, until no
    packing can have fewer."""
    best, total, left = best_fit(sizes, cap), sum(sizes), [math.inf if nodes is None else nodes]
    least = -(-total // cap)
    if len(best) <= least:
        return best
    counts = [0] * (cap + 1)
    for s in sizes:
        counts[s] += 1
    waste, path, stack = 0, [], []

    def put(pattern: list[int], times: int) -> None:
        for s in pattern:
            counts[s] -= times

    def options() -> Iterator[list[int]]:
        rest = counts.copy()
        largest = max(s for s in range(cap + 1) if rest[s])
        rest[largest] -= 1
        mask = sum(1 << s for s in range(1, cap + 1) if rest[s])
        return ([largest, *f] for f in _fillings(rest, mask, cap - largest, left))

    stack.append(options())
    while stack:
        if len(path) == len(stack):  # back at a step that was taken
            pattern, times = path.pop()
            put(pattern, -times)
            waste -= (cap - sum(pattern)) * times
        pattern = next(stack[-1], None)
        most = (len(best) - 1) * cap - total
        if pattern is None or waste + cap - sum(pattern) > most:
            stack.pop()
            continue
        times = 1 if nodes is None else min(counts[s] // pattern.count(s) for s in set(pattern))
        if waste + (cap - sum(pattern)) * times > most:
            times = 1
        put(pattern, times)
        path.append((pattern, times))
        waste += (cap - sum(pattern)) * times
        if any(counts):
            stack.append(options())
            continue
        best = [p for p, n in path for _ in range(n)]
        if len(best) <= least:
            break
    return best


def complete_bins(lengths: np.ndarray, cap: int = LENGTH, nodes: int | None = SHARD_NODES) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and place within the bin of each length."""
    order = np.argsort(lengths, kind="stable")
    next_of = np.searchsorted(lengths[order], np.arange(cap + 2))
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for n, pattern in enumerate(branch_and_bound(lengths.tolist(), cap, nodes)):
        at = 0
        for s in pattern:
            i = order[next_of[s]]
            next_of[s] += 1
            bins[i], places[i] = n, at
            at += s
    return bins, places


def _pack_shard(cap: int, nodes: int | None):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("uid", ignore_index=True)
        bins, places = complete_bins(shard["length"].to_numpy(), cap, nodes)
        return shard.assign(sequence_id=shard["shard"] * 2**32 + bins, offset=places)

    return run


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, shard_pieces: int = SHARD_PIECES, files: tuple[str, str, str] | None = None, nodes: int | None = SHARD_NODES) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    nodes: steps of the search of a shard; None searches each shard until its packing is proven to be the best, which can
    take very long, so shards should be small then. Every row of df is packed, repeated rows too, each for itself. Null and empty texts are one end token. Extra columns
    are ignored. An empty table gives an empty table.
    """
    pieces = written(token_pieces(df, doc_id, text, length, files).withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    short = pieces.where(F.col("length") < length)
    shards = max(1, math.ceil(short.count() / shard_pieces))
    dealt = short.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", sequence_id long, offset long"
    packed = dealt.groupBy("shard").applyInPandas(_pack_shard(length, nodes), schema).drop("shard")
    whole = pieces.where(F.col("length") == length).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole).drop("uid")


def op4_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))

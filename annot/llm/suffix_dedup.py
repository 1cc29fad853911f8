"""Removing repeated passages: a sparse suffix array, built by a distributed merge sort that knows common prefixes.

A window is any SPAN-byte string of a document. Its anchor is the first of the positions, among its first PICK ones, at
which the hash of the next bytes is least, so equal windows have anchors at equal places. All windows with one anchor are
neighbours, and two equal windows have anchors whose suffixes agree for at least SPAN - PICK bytes.

1. Hashes of those bytes are counted over all anchors; anchors whose hash occurs once begin no repeated window.
2. Each batch of documents sorts the suffixes of its other anchors, contexts that occur several times once, and cuts the
   sorted run at splitters; the parts are front-coded: a suffix is stored from where it differs from the one before.
3. Each range of suffixes merges its runs with a loser tree. A run's next suffix comes with the prefix it shares with the
   last one, and only where two candidates share equally much with the last output are bytes read, from there on.
   Neighbours that share SPAN - PICK bytes or more form a cluster, and within it the first and the last repeated window
   of each anchor is found by comparing bytes. Windows between two repeated ones of an anchor add nothing to their union.
4. The spans of a document are united and cut out.

The same steps, with a hash of eight bytes for each word, find passages of PASSAGE words or more that occur twice, however
few bytes they have.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, written

SPAN = 400
#: Words of the passages that are counted: over 50.
PASSAGE = 51
WORD_BYTES = 8
WORD_PICK = 16  # words
PICK = 128  # a power of two
GRAM = 8
#: Bytes of text that are looked at together.
CHUNK = 2_000_000
#: Bytes of texts whose words are hashed together.
WORDS_CHUNK = 1 << 18
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Anchors' hashes that are sent to every task, at most; with more of them the tasks get theirs by a join.
NEAR_KEYS = 2_000_000
SAMPLES = 20_000
#: Characters of text of which one sorted run is made.
RUN_BYTES = 16_000_000
RANGE_BYTES = 64_000_000


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of a and b, of which the first `start` bytes are known to agree."""
    n, i = min(len(a), len(b)), start
    while i < n:
        e = min(i + 64, n)
        x, y = a[i:e], b[i:e]
        if x != y:
            d = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return i + (8 * (e - i) - d.bit_length()) // 8
        i = e
    return n


def anchors(raws: list[bytes], span: int = SPAN, pick: int = PICK, unit: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text of at least span bytes: its number, and for each anchor its place and its first and last window.

    Windows and anchors are at multiples of unit bytes, and so are span, pick and the texts' lengths.
    """
    i = 0
    while i < len(raws):
        group, total = [], 0
        while i < len(raws) and (not group or total + len(raws[i]) <= CHUNK):
            if len(raws[i]) >= span:
                group.append(i)
                total += len(raws[i])
            i += 1
        if not group:
            continue
        joined = b"".join(raws[k] for k in group)
        n = (len(joined) - GRAM) // unit + 1
        h = np.ndarray((n,), "<u8", joined, strides=(unit,)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h &= np.uint64(0xFFFFFFFF00000000)
        h |= np.arange(n, dtype=np.uint64)
        width = 1
        while width < pick // unit:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        at = (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = 0
        for k in group:
            size = len(raws[k]) // unit
            own = at[start : start + size - span // unit + 1]
            cut = np.flatnonzero(own[1:] != own[:-1]) + 1
            first = np.concatenate([[0], cut])
            last = np.concatenate([cut - 1, [len(own) - 1]])
            yield k, (own[first] - start) * unit, first * unit, last * unit
            start += size


def _keys(raw: bytes, places: np.ndarray, reach: int) -> np.ndarray:
    import xxhash

    view = memoryview(raw)
    return np.array([xxhash.xxh3_64_intdigest(view[p : p + reach]) for p in places.tolist()], np.uint64).view(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: What stands between words, a number for each byte, and the base of the words' polynomials with its inverse modulo 2^64.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTERS = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The powers of base from 0 to n - 1 at least, modulo 2^64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        known = _powers[base] = np.cumprod(x, dtype=np.uint64)
    return known


def word_hashes(texts: list[bytes]) -> list[bytes]:
    """Eight bytes for each word of each text, made for the words of many texts at once.

    A word's hash is a polynomial in its bytes, as the difference of two sums that run over all texts. Texts are taken
    together up to WORDS_CHUNK bytes; longer ones are cut between words.
    """
    out: list[list[bytes]] = [[] for _ in texts]
    group: list[tuple[int, bytes]] = []

    def solve() -> None:
        joined = b" ".join(x for _, x in group) + b" "
        raw = np.frombuffer(joined, np.uint8)
        space = _SPACE[raw]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.concatenate([[0], edges])
        first, end = edges[0::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_LETTERS[raw] * _power(_BASE, len(raw))[: len(raw)], out=sums[1:])
        h = (sums[end] - sums[first]) * _power(pow(_BASE, -1, 1 << 64), len(raw))[first]
        h = _mixed(h + (end - first).astype(np.uint64)).astype("<u8").tobytes()
        at = np.concatenate([[0], np.cumsum([len(x) + 1 for _, x in group])])
        cuts = (8 * np.searchsorted(first, at)).tolist()
        for (k, _), a, b in zip(group, cuts, cuts[1:]):
            out[k].append(h[a:b])

    total = 0
    for k, text in enumerate(texts):
        start = 0
        while start < len(text):
            stop = len(text)
            if stop - start > WORDS_CHUNK and (gap := _GAP.search(text, start + WORDS_CHUNK)):
                stop = gap.start()
            if group and total + stop - start > WORDS_CHUNK:
                solve()
                group, total = [], 0
            group.append((k, text[start:stop]))
            total += stop - start + 1
            start = stop
    if group:
        solve()
    return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def _raws(batch: pd.DataFrame, unit: int = 1) -> list[bytes]:
    """The texts' bytes, or the hashes of their words."""
    raws = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
    return raws if unit == 1 else word_hashes(raws)


def _parts(batches: Iterator[pd.DataFrame], limit: int = RUN_BYTES) -> Iterator[pd.DataFrame]:
    """Consecutive rows with about `limit` characters of text, a text at least. A batch gives its texts up part by part."""
    for batch in batches:
        ends, start = batch["text"].str.len().to_numpy().cumsum(), 0
        texts, rest = batch.pop("text").tolist(), batch
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
            part = rest.iloc[start:stop].reset_index(drop=True)
            part["text"] = texts[start:stop]
            texts[start:stop] = [None] * (stop - start)
            yield part
            start = stop


def _count_keys(span: int, pick: int, unit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = span - pick
        for batch in _parts(batches, RUN_BYTES // 2):
            raws, found, samples = _raws(batch, unit), [], {}
            for k, places, _, _ in anchors(raws, span, pick, unit):
                keys = _keys(raws[k], places, reach)
                found.append(keys)
                for j in np.flatnonzero(keys & 4095 == 0):
                    samples[int(keys[j])] = raws[k][places[j] : places[j] + reach]
            if found:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"key": key, "n": n, "sample": [samples.get(x) for x in key.tolist()]})

    return run


def _each_key(span: int, pick: int, unit: int):
    """(doc_id, h, place, key) of every anchor, for the join that stands in for sending the keys to every task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws = _raws(batch, unit)
            for k, places, _, _ in anchors(raws, span, pick, unit):
                yield pd.DataFrame({"doc_id": [batch["doc_id"].iloc[k]] * len(places), "h": batch["h"].iloc[k], "place": places, "key": _keys(raws[k], places, span - pick)})

    return run


def pack_run(rows: list[tuple[bytes, bytes, int, list[tuple[int, int]]]]) -> bytes:
    """A sorted run, front-coded and compressed. A row: suffix, bytes before it, windows after the last, occurrences."""
    import zstandard

    shared, tails, befores, skips, times, docs, places, last = [], [], [], [], [], [], [], b""
    for suffix, before, skip, found in rows:
        n = common_prefix(last, suffix)
        shared.append(n)
        tails.append(suffix[n:])
        befores.append(before)
        skips.append(skip)
        times.append(len(found))
        docs += [d for d, _ in found]
        places += [p for _, p in found]
        last = suffix
    numbers = np.concatenate([np.array([len(rows), len(docs)]), shared, [len(t) for t in tails], [len(b) for b in befores], skips, times, docs, places]).astype("<i8")
    return zstandard.ZstdCompressor(level=1).compress(numbers.tobytes() + b"".join(tails) + b"".join(befores))


def unpack_run(blob: bytes) -> Iterator[tuple[int, bytes, tuple[bytes, int, np.ndarray, np.ndarray]]]:
    """Rows of a run in order: the length shared with the suffix before, the suffix, and the rest."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(data, "<i8", 2).tolist()
    numbers = np.frombuffer(data, "<i8", 2 + 5 * n + 2 * m)[2:]
    shared, tails, befores, skips, times = (numbers[i * n : (i + 1) * n].tolist() for i in range(5))
    docs, places = numbers[5 * n : 5 * n + m], numbers[5 * n + m :]
    t = 8 * (2 + 5 * n + 2 * m)
    b, at, last = t + sum(tails), 0, b""
    for i in range(n):
        last = last[: shared[i]] + data[t : t + tails[i]]
        t += tails[i]
        before = data[b : b + befores[i]]
        b += befores[i]
        yield shared[i], last, (before, skips[i], docs[at : at + times[i]], places[at : at + times[i]])
        at += times[i]


def merge_runs(runs: list[Iterator[tuple]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Merges sorted runs with a loser tree; each row comes with the length of the prefix shared with the row before."""
    k = 1
    while k < len(runs):
        k *= 2
    current: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    text = [c[1] if c else None for c in current]
    known = [0] * k  # what each run's suffix shares with the last output
    loser = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known becomes what it shares with the winner."""
        if text[b] is None:
            return a, b
        if text[a] is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common_prefix(text[a], text[b], known[a])
        if text[a][n : n + 1] <= text[b][n : n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    level = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        level[node], loser[node] = play(level[2 * node], level[2 * node + 1])
    top = level[1]
    while text[top] is not None:
        yield known[top], text[top], current[top][2]
        row = current[top] = next(runs[top], None)
        text[top], known[top] = (row[1], row[0]) if row else (None, 0)
        node = (top + k) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2


def repeated_windows(cluster: list[tuple[bytes, tuple]], shared: list[int], span: int, unit: int = 1) -> Iterator[tuple[int, int, tuple]]:
    """For each row with a repeated window: the bytes before its anchor of the first and of the last such window.

    cluster: rows (suffix, (before, skip, docs, places)) whose neighbours share shared[i] bytes. A row's windows start at
    skip to len(before) bytes before the anchor. Equal windows are as far from their anchors.
    """
    if len(cluster) == 1:
        suffix, (before, skip, docs, _) = cluster[0]
        if len(docs) > 1:
            yield len(before), skip, cluster[0]
        return
    if len(cluster) == 2 and all(len(c[1][2]) == 1 for c in cluster):
        (_, a), (_, b) = cluster
        most = common_prefix(a[0][::-1], b[0][::-1]) // unit * unit
        least = max(a[1], b[1], span - shared[1] // unit * unit)
        if least <= most:
            for row in cluster:
                yield most, least, row
        return
    whole = [before + suffix for suffix, (before, _, _, _) in cluster]
    alike = Counter((suffix, rest[0]) for suffix, rest in cluster)
    open_rows = []
    for i, (suffix, (before, skip, docs, _)) in enumerate(cluster):
        if len(docs) > 1 or alike[suffix, before] > 1:
            yield len(before), skip, cluster[i]
        else:
            open_rows.append(i)

    def bounds(order) -> dict[int, int]:
        found, rest = {}, set(open_rows)
        for o in order:
            if not rest:
                break
            windows = {}
            for i, (_, (before, skip, docs, _)) in enumerate(cluster):
                if skip <= o <= len(before):
                    at = len(before) - o
                    windows.setdefault(whole[i][at : at + span], []).append(i)
            for rows in windows.values():
                if len(rows) > 1:
                    for i in rest.intersection(rows):
                        found[i] = o
                        rest.discard(i)
        return found

    if open_rows:
        lowest, highest = min(r[1][1] for r in cluster), max(len(r[1][0]) for r in cluster)
        most = bounds(range(highest, lowest - 1, -unit))
        if most:
            open_rows = list(most)
            least = bounds(range(lowest, highest + 1, unit))
            for i in most:
                yield most[i], least[i], cluster[i]


def _sort_runs(span: int, pick: int, unit: int, splitters: list[bytes], shared_keys):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = span - pick
        live = shared_keys.value if shared_keys is not None else None
        for batch in _parts(batches):
            raws, contexts = _raws(batch, unit), {}
            del batch["text"]
            ids, hs = batch["doc_id"].tolist(), batch["h"].tolist()
            for k, places, first, last in anchors(raws, span, pick, unit):
                raw = raws[k]
                if live is not None:
                    keys = _keys(raw, places, reach)
                    at = np.searchsorted(live, keys)
                    keep = np.flatnonzero(live[np.minimum(at, len(live) - 1)] == keys) if len(live) else []
                else:
                    keep = np.flatnonzero(np.isin(places, np.asarray(batch["places"].iloc[k], np.int64)))
                for j in keep:
                    p, a, b = int(places[j]), int(first[j]), int(last[j])
                    contexts.setdefault((raw[p : b + span], raw[a:p], p - b), []).append((k, p))
            parts: dict[int, list] = {}
            for suffix, before, skip in sorted(contexts):
                parts.setdefault(bisect_right(splitters, suffix[:reach]), []).append((suffix, before, skip, contexts[suffix, before, skip]))
            rows = []
            for b, part in parts.items():
                used = sorted({d for _, _, _, found in part for d, _ in found})
                to = {d: i for i, d in enumerate(used)}
                blob = pack_run([(s, f, skip, [(to[d], p) for d, p in found]) for s, f, skip, found in part])
                rows.append((b, blob, [ids[d] for d in used], [hs[d] for d in used]))
            if rows:
                yield pd.DataFrame(rows, columns=["part", "run", "ids", "hs"])

    return run


def _merge(span: int, pick: int, unit: int, id_dtype):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, hs, runs, base = [], [], [], 0
        for _, r in rows.iterrows():
            runs.append((lambda blob, base: ((n, s, (b, k, d + base, p)) for n, s, (b, k, d, p) in unpack_run(blob)))(r["run"], base))
            ids.extend(r["ids"])
            hs.extend(r["hs"])
            base += len(r["ids"])
        docs, starts, ends = [], [], []

        def solve(cluster, shared):
            for most, least, (_, (_, _, d, p)) in repeated_windows(cluster, shared, span, unit):
                docs.append(d)
                starts.append(p - most)
                ends.append(p - least + span)

        cluster, shared = [], []
        for n, suffix, rest in merge_runs(runs):
            if cluster and n < span - pick:
                solve(cluster, shared)
                cluster, shared = [], []
            cluster.append((suffix, rest))
            shared.append(n)
        if cluster:
            solve(cluster, shared)
        d = np.concatenate(docs) if docs else np.empty(0, np.int64)
        out = pd.DataFrame({"d": d, "s": np.concatenate(starts) if docs else d, "e": np.concatenate(ends) if docs else d})
        # One row for each document and stretch.
        out = out.sort_values(["d", "s"], ignore_index=True)
        if len(out):
            reach = out.groupby("d")["e"].cummax().groupby(out["d"]).shift(fill_value=-1)
            out["g"] = (out["s"] > reach).cumsum()
            out = out.groupby(["d", "g"], as_index=False).agg(s=("s", "min"), e=("e", "max"))
        return pd.DataFrame({"doc_id": pd.Series([ids[i] for i in out["d"]], dtype=id_dtype if len(out) else object), "h": pd.Series([hs[i] for i in out["d"]], dtype="int64"), "s": out["s"], "e": out["e"]})

    return run


def _united(spans, unit: int) -> list[list[int]]:
    """The spans of this unit, those that meet joined, in order."""
    merged: list[list[int]] = []
    for s, e in sorted((int(x["s"]), int(x["e"])) for x in spans if x["unit"] == unit) if spans is not None else []:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return merged


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
            raw, kept, at, n, removed = text.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0, 0, 0
            for s, e in _united(spans, 1):
                kept.update(raw[at:s])
                removed, at, n = removed + e - s, e, n + 1
            kept.update(raw[at:])
            words = sum(e - s for s, e in _united(spans, WORD_BYTES)) // WORD_BYTES
            rows.append((doc_id, len(raw), removed, n, kept.hexdigest(), words))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])


def repeated_spans(docs: DataFrame, span: int = SPAN, pick: int = PICK, near_keys: int = NEAR_KEYS, unit: int = 1) -> DataFrame:
    """doc_id, h, s, e: stretches of bytes, or of the hashes of words, that repeated windows cover, in docs (doc_id, h, text)."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.mapInPandas(_count_keys(span, pick, unit), "key long, n long, sample binary").groupBy("key").agg(F.sum("n").alias("n"), F.max("sample").alias("sample"))
    live = written(counted.where("n > 1"), "suffix-keys")
    total, n_live = live.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).head()
    sample = sorted(bytes(r["sample"]) for r in live.where("sample is not null").orderBy("key").limit(SAMPLES).select("sample").collect())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * (span + pick) // RANGE_BYTES)
    splitters = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    if n_live <= near_keys:
        keys = spark.sparkContext.broadcast(np.sort(live.select("key").toArrow()["key"].to_numpy()))
        runs = docs.mapInPandas(_sort_runs(span, pick, unit, splitters, keys), f"part int, run binary, ids array<{id_type}>, hs array<long>")
    else:
        places = docs.mapInPandas(_each_key(span, pick, unit), f"doc_id {id_type}, h long, place long, key long").join(live.select("key"), "key")
        places = places.groupBy("doc_id", "h").agg(F.collect_set("place").alias("places")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "places")
        some = docs.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("doc_id", "h", "text", "places")
        runs = some.mapInPandas(_sort_runs(span, pick, unit, splitters, None), f"part int, run binary, ids array<{id_type}>, hs array<long>")
    dtype = "Int64" if id_type in ("bigint", "int", "smallint", "tinyint") else object
    return runs.groupBy("part").applyInPandas(_merge(span, pick, unit, dtype), f"doc_id {id_type}, h long, s long, e long")


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, pick: int = PICK, near_keys: int = NEAR_KEYS, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words for each row of df.

    n_passage_words: the words that lie in passages of at least `passage` words which also begin anywhere else; nothing is
    removed for these.

    Null texts count as empty, and texts of under `span` bytes lose nothing. Rows with equal texts lose all that is
    longer, also when their ids are equal. An empty table gives an empty table; extra columns are ignored.
    """
    id_type = df.schema[doc_id].dataType.simpleString()
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    spans = written(repeated_spans(docs.where(F.octet_length("text") >= span), span, pick, near_keys), "suffix-spans")
    words = written(repeated_spans(docs.where(F.octet_length("text") >= 2 * passage - 1), passage * WORD_BYTES, WORD_PICK * WORD_BYTES, near_keys, WORD_BYTES), "passage-spans")
    spans = spans.withColumn("unit", F.lit(1)).unionByName(words.withColumn("unit", F.lit(WORD_BYTES)))
    spans = spans.groupBy("doc_id", "h").agg(F.collect_set(F.struct("unit", "s", "e")).alias("spans")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "spans")
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("doc_id", "text", "spans")
    return joined.mapInPandas(_cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")


def op7_remove_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))

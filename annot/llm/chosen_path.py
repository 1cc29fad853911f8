"""Near-duplicate join by Jaccard similarity of word shingles: the chosen-path method.

Texts with equal sets of shingles form one class and are joined once. Each class gets a MinHash signature, its sample of
tokens. A run sends every class down a tree: a node picks one or two places of the signature by its own hash, and the
classes at the node move to the children that the values at those places name. Nodes with few classes are leaves: there
signatures are compared by brute force, and classes that look similar are linked to one of them. Runs are repeated so
often that a pair at the threshold is met with the target probability. The classes of nodes that are still large after
the usual number of steps are compared with one of them; those that aren't much like it go down again, deeper and in more
runs, through nodes that hold classes which no links join yet.

Linked classes form candidate groups. Within each group all pairs are verified on the full sets: small groups many to a
task, large groups in blocks of bounded size, one task for each pair of blocks. A task returns the number of links of
each class and one link to the least class that they lead to, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, take_rows, written

WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
PLACES = 64
LEAF = 1024
#: Steps between which nodes are looked at. Runs over all classes go to the depth of the first; classes then still in large
#: nodes get the runs that the depth of the second asks for.
USUAL_STEPS, DEEP_STEPS = (3,), (5,)
USUAL_DEPTH, DEPTH = sum(USUAL_STEPS), sum(DEEP_STEPS)
BLOCK = 1024
#: How far below the threshold an estimate from PLACES places may lie: five standard deviations.
MARGIN = 0.25
_rng = np.random.default_rng(17)
_STEP = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_HASH = _rng.integers(1, 2**63, PLACES, dtype=np.uint64) | np.uint64(1)


def miss(threshold: float, runs: int, depth: int) -> float:
    """Probability that a pair at the threshold shares no leaf at this depth in any of the runs.

    A node picks one place always and a second one with probability 1 / threshold - 1, so that a pair at the threshold
    goes on in one child on average. All runs use the same PLACES places, so the number of them that the pair has alike
    is the same in all: the mean is taken over its binomial distribution.
    """
    extra, total = 1 / threshold - 1, 0.0
    for alike in range(PLACES + 1):
        meet = 1.0
        for _ in range(depth):
            go = alike / PLACES * meet
            meet = 1 - (1 - go) * (1 - extra * go)
        total += math.comb(PLACES, alike) * threshold**alike * (1 - threshold) ** (PLACES - alike) * (1 - meet) ** runs
    return total


def runs_needed(threshold: float, target: float, depth: int = USUAL_DEPTH) -> int:
    """Runs after which a pair at the threshold has shared a leaf at this depth with the target probability."""
    runs = 1
    while miss(threshold, runs, depth) > 1 - target:
        runs += 1
    return runs


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; of all words where there are fewer; none of no word."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        out += h[k : k + n] * _STEP[k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """PLACES minimum hashes of a set that isn't empty."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(least, np.multiply.outer(_HASH, s[i : i + 4096]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for batch in batches:
        rows = []
        for doc_id, h, text in zip(batch["doc_id"], batch["h"], batch["text"], strict=True):
            s = shingles(text)
            rows.append((doc_id, h, xxhash.xxh3_128_digest(s.tobytes()), len(s), signature(s).view(np.int32) if len(s) else None))
        yield pd.DataFrame(rows, columns=["doc_id", "h", "digest", "n", "sig"])


def _leaf_links(threshold: float):
    """Batches sorted by node; links the classes of a node that look similar to the first of each group of them."""

    def link(ids: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.empty((len(ids), len(ids)), bool)
        for i in range(0, len(ids), 128):  # some megabytes at a time
            share = (sketches[i : i + 128, None, :] == sketches[None, :, :]).mean(2, dtype=np.float32)
            near[i : i + 128] = (share - 1 / 256) / (1 - 1 / 256) >= threshold - MARGIN
        root = np.arange(len(ids))
        while True:  # the least index that reaches each row
            new = np.where(near, root[None, :], len(ids)).min(1)
            if (new == root).all():
                break
            root = new
        moved = root != np.arange(len(ids))
        return ids[moved], ids[root[moved]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            node, ids = rows["node"].to_numpy(), rows["id"].to_numpy()
            sk = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), PLACES)
            cuts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
            a, b = [], []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j - i > 1:
                    x, y = link(ids[i:j], sk[i:j])
                    a.append(x)
                    b.append(y)
            return pd.DataFrame({"a": np.concatenate(a) if a else np.empty(0, np.int64), "b": np.concatenate(b) if b else np.empty(0, np.int64)})

        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = int(np.flatnonzero((rows["node"] != rows["node"].iloc[-1]).to_numpy()).max(initial=-1)) + 1
            held = rows.iloc[last:]
            if last:
                yield solve(rows.iloc[:last])
        if held is not None:
            yield solve(held)

    return run


def components(edges: DataFrame, name: str) -> DataFrame:
    """id and comp (the least id) of every id in edges (a, b).

    Of an id's links to lesser ids, one to the least of them stays; the others become links of that one to them. Ids that
    none is linked down to are settled so, by one aggregation. What is left, links among the few that others were linked
    to, is solved by passing on least labels and following them.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("low"))
    stars = written(pairs.groupBy("id").agg(F.min("low").alias("top"), F.collect_set("low").alias("lows")), f"{name}-stars")
    hubs = written(stars.select(F.explode("lows").alias("a"), F.col("top").alias("b")).distinct(), f"{name}-hubs")
    named = hubs.select(F.col("a").alias("id")).distinct()
    own = stars.join(named, "id", "left_semi").select(F.col("id").alias("a"), F.col("top").alias("b"))
    labels = _least_labels(hubs.where("a <> b").unionByName(own), f"{name}-labels").select(F.col("id").alias("top"), "comp")
    tops = stars.select("id", "top").unionByName(named.select("id", F.col("id").alias("top"))).groupBy("id").agg(F.min("top").alias("top"))
    return written(tops.join(labels, "top", "left").select("id", F.coalesce("comp", "top").alias("comp")), name)


def _least_labels(edges: DataFrame, name: str) -> DataFrame:
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")), name)
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        new = labels.join(seen, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("comp").alias("far"))
        new = written(new.join(jump, "next").select("id", "was", F.least("next", "far").alias("comp")), name)
        labels = new.select("id", "comp")
        if not new.where("comp <> was").limit(1).count():
            return labels


def _children(node: Column, sig: Column, threshold: float) -> Column:
    """The one or two nodes that a node sends a class to."""
    extra = int(1000 * (1 / threshold - 1))
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(PLACES)).cast("int")
    second = F.pmod(F.xxhash64(node, F.lit(2)), F.lit(PLACES)).cast("int")
    child = lambda i: F.xxhash64(node, i, F.get(sig, i))
    return F.when(F.pmod(F.xxhash64(node, F.lit(3)), F.lit(1000)) < extra, F.array_distinct(F.array(child(first), child(second)))).otherwise(F.array(child(first)))


def descend(classes: DataFrame, runs: range, plan: tuple[int, ...], threshold: float) -> tuple[DataFrame, DataFrame]:
    """Sends classes (id, sig, comp) down the trees of these runs: links (a, b), and what is left (id, hub).

    plan: numbers of steps; after each, small nodes are leaves and large ones go on.

    Classes of one comp are known to be linked: nodes that hold no others are left out. What is left are the classes of
    nodes that are still large after the last step.
    """
    known = classes.select("id", "sig")
    level = classes.withColumn("node", F.explode(F.array(*[F.xxhash64(F.lit(f"run {r}")) for r in runs])))
    leaves, links, left = [], [], classes.select("id", F.col("id").alias("hub")).limit(0)
    for number, steps in enumerate(plan):
        for _ in range(steps):
            level = level.withColumn("node", F.explode(_children(F.col("node"), F.col("sig"), threshold)))
        level = level.select("id", "comp", "node")
        # The least id is the hub, so that runs and levels agree on it and repeat few links.
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("count"), F.min("id").alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        sized = written(level.join(sizes.select("node", "count", "hub"), "node"), f"path-{number}")
        leaves.append(sized.where(F.col("count") <= LEAF).select("id", "node"))
        full = sized.where(F.col("count") > LEAF).select("id", "comp", "node", "hub")
        if not full.limit(1).count():
            break
        full = full.join(known, "id")
        if number + 1 < len(plan):
            level = full.select("id", "comp", "node", "sig")
            continue
        # Nodes that are still large are compared with one of their classes. Those much like it need no more: what is
        # near them is near it too, as 1 - similarity is a distance, and so is linked to it.
        full = full.join(known.select(F.col("id").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
        share = sum(((F.get("sig", F.lit(k)) == F.get("hub_sig", F.lit(k))).cast("int") for k in range(PLACES)), F.lit(0)) / float(PLACES)
        full = written(full.select("id", "hub", share.alias("share")), "path-hubs")
        links.append(full.where(F.col("share") >= threshold - MARGIN).select(F.col("id").alias("a"), F.col("hub").alias("b")))
        left = full.where((F.col("share") < (1 + threshold) / 2) & (F.col("id") != F.col("hub"))).select("id", "hub")
    sketch = known.select("id", F.unhex(F.concat_ws("", F.transform("sig", lambda x: F.lpad(F.hex(F.pmod(x, F.lit(256))), 2, "0")))).alias("sketch"))
    compared = reduce(DataFrame.unionByName, leaves).join(sketch, "id").repartition("node").sortWithinPartitions("node", "id").mapInPandas(_leaf_links(threshold), "a long, b long")
    return reduce(DataFrame.unionByName, [compared, *links]).where("a <> b"), left


def candidate_groups(classes: DataFrame, threshold: float, target: float) -> DataFrame:
    """id, comp for the classes (id, sig) that chosen paths link to others.

    All classes go down USUAL_DEPTH steps. Those then still in large nodes go down to DEPTH, in the more runs that this
    depth needs, to be linked to classes that they aren't linked to yet. What is together even then shares so many places
    that it is verified as it is.
    """
    runs = runs_needed(threshold, target)
    links, left = descend(classes.withColumn("comp", F.col("id")), range(runs), USUAL_STEPS, threshold)
    groups = components(links, "path-groups")
    deep = written(classes.join(left.select("id").distinct(), "id").join(groups, "id", "left").select("id", "sig", F.coalesce("comp", "id").alias("comp")), "path-deep")
    if not deep.limit(1).count():
        return groups
    more, left = descend(deep, range(runs, runs + runs_needed(threshold, target, DEPTH)), DEEP_STEPS, threshold)
    known = groups.select(F.col("id").alias("a"), F.col("comp").alias("b"))
    return components(known.unionByName(more).unionByName(left.select(F.col("id").alias("a"), F.col("hub").alias("b"))).where("a <> b"), "path-groups")


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b."""
    out = np.zeros((len(a), len(b)), np.float32)
    va, vb = np.unique(np.concatenate(a)), np.unique(np.concatenate(b))
    common = np.intersect1d(va, vb, assume_unique=True)
    ia, ib = ([np.searchsorted(common, s[np.isin(s, common, assume_unique=True)]) for s in x] for x in (a, b))
    for lo in range(0, len(common), 4096):
        m, n = (np.zeros((len(x), min(4096, len(common) - lo)), np.float32) for x in (ia, ib))
        for rows, mat in ((ia, m), (ib, n)):
            for r, at in enumerate(rows):
                at = at[np.searchsorted(at, lo) : np.searchsorted(at, lo + 4096)] - lo
                mat[r, at] = 1
        out += m @ n.T
    return out


def _verify(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, group in rows.groupby(["comp", "i", "j"], sort=True):
            group = group.sort_values("id")
            i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
            left, right = group[group["block"] == i], group[group["block"] == j]
            if not len(left) or not len(right):
                continue
            a = [shingles(t) for t in left["text"]]
            b = a if i == j else [shingles(t) for t in right["text"]]
            both = _intersections(a, b)
            na, nb = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :]
            linked = both >= threshold * (na + nb - both) - 1e-6
            ida, idb = left["id"].to_numpy(), right["id"].to_numpy()
            if i == j:
                np.fill_diagonal(linked, False)
                found.append(pd.DataFrame({"id": ida, "links": linked.sum(1)}))
            else:
                found.append(pd.DataFrame({"id": np.concatenate([ida, idb]), "links": np.concatenate([linked.sum(1), linked.sum(0)])}))
            found.append(_bridges(ida, idb, linked))
        found = [f for f in found if len(f)]
        if not found:
            return pd.DataFrame({"id": [], "links": [], "other": []})
        return pd.concat(found, ignore_index=True).reindex(columns=["id", "links", "other"])

    return run


def _bridges(ida: np.ndarray, idb: np.ndarray, linked: np.ndarray) -> pd.DataFrame:
    """A link of each id to the least one that links lead to from it, but of that one itself."""
    root = {int(x): int(x) for x in np.concatenate([ida, idb])}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in range(len(ida)):
        for c in np.flatnonzero(linked[r]):
            x, y = top(int(ida[r])), top(int(idb[c]))
            if x != y:
                root[max(x, y)] = min(x, y)
    return pd.DataFrame([(x, top(x)) for x in root if top(x) != x], columns=["id", "other"])


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, target: float = TARGET_RECALL, block: int = BLOCK, keep_keys: bool = False) -> DataFrame:
    """doc_id, class_id, copy_id, n_copies, n_links for each row of df.

    copy_id: the least id of the rows with the same set of shingles, of which there are n_copies; n_links: the number of
    other sets with a Jaccard similarity of the threshold or more; class_id: the least id that links lead to. Texts
    without words, null ones too, equal each other and have no links. Repeated rows are copies. An empty table gives an
    empty table; extra columns are ignored.
    """
    id_type = df.schema[doc_id].dataType.simpleString()
    texts = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    signed = written(texts.mapInPandas(_sign, f"doc_id {id_type}, h long, digest binary, n int, sig array<int>").withColumn("uid", F.monotonically_increasing_id()), "path-signed")
    classes = signed.groupBy("digest").agg(F.min(F.struct("doc_id", "uid", "h", "n", "sig")).alias("x"), F.count(F.lit(1)).alias("n_copies"))
    classes = written(classes.select(F.col("x.uid").alias("id"), "digest", F.col("x.doc_id").alias("copy_id"), F.col("x.h").alias("h"), F.col("x.n").alias("n"), F.col("x.sig").alias("sig"), "n_copies"), "path-classes")

    groups = candidate_groups(classes.where("n > 0").select("id", "sig"), threshold, target)
    sizes = groups.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = groups.join(sizes, "comp").join(classes.select("id", "digest", "copy_id"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # The one row of each class whose text is compared: any with its digest, of those with the class's least id.
    placed = written(placed, "path-placed")
    # A merge join at any size: the candidates grow with the texts.
    members = texts.join(placed.hint("merge"), texts["doc_id"].eqNullSafe(placed["copy_id"])).select("id", "comp", "blocks", "block", "digest", "text")
    members = members.where(_digest_udf()("text") == F.col("digest")).dropDuplicates(["id"])
    small = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = members.withColumn("o", other).withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).withColumn("part", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(small))).otherwise(F.xxhash64("comp", "i", "j")))
    verified = pairs.select("part", "id", "comp", "block", "i", "j", "text").groupBy("part").applyInPandas(_verify(threshold), "id long, links long, other long")
    verified = written(verified, "path-verified")

    links = verified.where("links is not null").groupBy("id").agg(F.sum("links").alias("n_links"))
    joined = components(verified.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), "path-links")
    out = classes.select("id", "digest", "copy_id", "h", "n_copies").join(links, "id", "left").join(joined, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = out.groupBy("comp").agg(F.min(F.struct("copy_id", "h")).alias("least"))
    out = written(out.join(least, "comp").select("digest", F.col("least.copy_id").alias("class_id"), F.col("least.h").alias("class_h"), "copy_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "path-result")
    rows = signed.select("doc_id", "h", "digest").join(out, "digest")
    if keep_keys:
        first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h"))
        return rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")).alias("_k"), F.col("h").alias("_h"), first.alias("first"))
    return rows.select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def _digest_udf():
    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        import xxhash

        return texts.map(lambda t: xxhash.xxh3_128_digest(shingles(t).tobytes()))

    return digest


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df, one of each class of near duplicates: that with the least id."""
    rows = near_duplicates(df, doc_id, text, keep_keys=True, **options)
    keys = rows.groupBy("_k", "_h").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("first")).alias("x")).select("_k", "_h", "n", F.col("x.first").cast("int").alias("times"))
    return take_rows(df, written(keys.where("times > 0"), "path-kept"), doc_id, text)


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))

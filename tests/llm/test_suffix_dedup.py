import hashlib
import random
from collections import Counter

import numpy as np

from annot.llm.suffix_dedup import common_prefix, merge_runs, pack_run, remove_repeats, unpack_run

from .cases import crowded, odd_rows, table


def plain(rows, span):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + span] for r in raws for i in range(len(r) - span + 1))
    out = []
    for (doc, _), r in zip(rows, raws, strict=True):
        cover = np.zeros(len(r) + 1, int)
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                cover[i] += 1
                cover[i + span] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((str(doc), len(r), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def found(df, **options):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, **options).collect())


def passages(seed):
    """Texts over few letters with shared passages of all lengths around the span, runs of one letter and copies."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [text(rng.randint(30, 90)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(text(rng.randint(0, 60)))
            s = rng.choice(shared)
            a = rng.randint(0, 20)
            parts.append(s[a : len(s) - rng.randint(0, 20)])
        rows.append((i, "".join(parts) + text(rng.randint(0, 30))))
    return [*rows, (100, "z" * 150), (101, "z" * 41), rows[5], (102, rows[6][1]), (103, None), (104, "")]


def test_removed_bytes_equal_brute_force(spark):
    for seed in (1, 2):
        rows = passages(seed)
        want = plain(rows, 40)
        assert found(crowded(table(spark, rows)), span=40, pick=16) == want
        assert found(table(spark, rows), span=40, pick=16, near_keys=0) == want


def test_production_span(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p, q = text(450), text(399)
    rows = [(1, text(500) + p + text(300)), (2, text(37) + p), (3, q + text(200)), (4, text(100) + q), (5, p[10:430] + text(9)), *odd_rows()]
    assert found(table(spark, rows)) == plain(rows, 400)
    assert remove_repeats(table(spark, [])).count() == 0


def test_runs_merge_in_order():
    rng = random.Random(5)
    runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 40))) for _ in range(7)]
    coded = [unpack_run(pack_run([(s, b"", 0, [(0, 0)]) for s in run])) for run in runs]
    merged = list(merge_runs(coded))
    assert [s for _, s, _ in merged] == sorted(s for run in runs for s in run)
    for (_, a, _), (n, b, _) in zip(merged, merged[1:], strict=False):
        assert n == common_prefix(a, b)


def plain_words(rows, passage):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + passage]) for w in texts for i in range(len(w) - passage + 1))
    out = []
    for (doc, _), w in zip(rows, texts, strict=True):
        covered = {j for i in range(len(w) - passage + 1) if seen[tuple(w[i : i + passage])] > 1 for j in range(i, i + passage)}
        out.append((str(doc), len(covered)))
    return sorted(out)


def test_words_of_repeated_passages_equal_brute_force(spark):
    for seed, passage in ((1, 20), (2, 51)):
        rng = random.Random(seed)
        text = lambda n: " ".join(rng.choice(["a", "b", "c", "de", "é"]) for _ in range(n))
        shared = [text(rng.randint(passage - 4, passage + 12)) for _ in range(8)]
        rows = [(i, "  ".join([text(rng.randint(0, 40)), rng.choice(shared), text(rng.randint(0, 9)), *([rng.choice(shared)] if i % 3 == 0 else [])])) for i in range(60)]
        rows += [(100, "x " * 150), rows[3], (101, rows[4][1] + " "), (102, None), (103, " \n")]
        want = plain_words(rows, passage)
        assert any(n for _, n in want) and any(not n for _, n in want)
        for near in (2_000_000, 0):
            got = remove_repeats(crowded(table(spark, rows)), passage=passage, near_keys=near).collect()
            assert sorted((str(r.doc_id), r.n_passage_words) for r in got) == want


def test_short_passages_of_many_words_are_told(spark):
    """A passage of over 50 words and under 400 bytes stays, as the span asks, and is counted; other texts have none."""
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passage = text(54)
    assert len(passage) < 400
    rows = [(i, text(100) + " " + passage + " " + text(60)) for i in range(5)] + [(i, text(200)) for i in range(10, 20)]
    got = {r.doc_id: r for r in remove_repeats(table(spark, rows)).collect()}
    assert all(got[i].n_passage_words == 54 and got[i].n_removed == 0 for i in range(5))
    assert all(got[i].n_passage_words == 0 and got[i].n_removed == 0 for i in range(10, 20))


def test_words_are_hashed_without_a_lookup_for_each(monkeypatch):
    """Equal words have equal hashes wherever they stand, others have others, and words are what bytes.split() gives."""
    from annot.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "WORDS_CHUNK", 40)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé\u0085 \t\n\x0b\x1c") for _ in range(rng.randrange(120))).encode() for _ in range(300)] + [b"", b" ", b"a" * 100, b" " * 90 + b"b"]
    hashes: dict[bytes, bytes] = {}
    for text, raw in zip(texts, suffix_dedup.word_hashes(texts), strict=True):
        words = text.split()
        assert len(raw) == 8 * len(words)
        for i, word in enumerate(words):
            assert hashes.setdefault(word, raw[8 * i : 8 * i + 8]) == raw[8 * i : 8 * i + 8]
    assert len(set(hashes.values())) == len(hashes)

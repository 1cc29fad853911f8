import random
import zlib

import numpy as np

from annot.llm.packing import Encoder, best_fit, branch_and_bound, complete_bins, dominated, fillings_in_order, pack, tokenizer_files

from .cases import crowded, odd_rows, table, words


def test_bins_hold_all_and_come_near_the_bound():
    rng = random.Random(2)
    for n, top in ((1, 5), (40, 900), (3000, 1023), (3000, 300)):
        lengths = np.array([rng.randint(1, top) for _ in range(n)])
        bins, places = complete_bins(lengths)
        for b in set(bins.tolist()):
            mine = sorted((p, s) for p, s, x in zip(places, lengths, bins, strict=True) if x == b)
            at = 0
            for p, s in mine:
                assert p == at
                at += s
            assert at <= 1024
        assert len(set(bins.tolist())) <= -(-int(lengths.sum()) // 1024) * 1.02 + 1


def test_branch_and_bound_finds_the_fewest_bins():
    def fewest(sizes, cap, bins=()):
        if not sizes:
            return len(bins)
        best = len(sizes) + len(bins)
        for i, room in enumerate(bins):
            if room >= sizes[0]:
                best = min(best, fewest(sizes[1:], cap, (*bins[:i], room - sizes[0], *bins[i + 1 :])))
        return min(best, fewest(sizes[1:], cap, (*bins, cap - sizes[0])))

    rng = random.Random(8)
    for _ in range(25):
        sizes = sorted((rng.randint(1, 10) for _ in range(7)), reverse=True)
        assert len(branch_and_bound(sizes, 12)) == fewest(sizes, 12)


def test_branch_and_bound_betters_best_fit():
    # Best-fit puts 6 with 5; 6 4 2, 5 4 3 fill two bins of 12.
    assert len(best_fit([6, 5, 4, 4, 3, 2], 12)) == 3 and len(branch_and_bound([6, 5, 4, 4, 3, 2], 12)) == 2
    rng, better = random.Random(5), 0
    for _ in range(30):
        sizes = [x for _ in range(12) for x in (lambda a, b: (a, b, 100 - a - b))(rng.randint(30, 45), rng.randint(20, 30))]
        found = branch_and_bound(sizes, 100)
        assert sorted(s for b in found for s in b) == sorted(sizes) and all(sum(b) <= 100 for b in found)
        assert len(found) <= len(best_fit(sizes, 100))
        better += len(found) < len(best_fit(sizes, 100))
    assert better >= 3


def test_fillings_are_undominated_and_in_order():
    import itertools

    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 9) for _ in range(7)]
        counts = [sizes.count(s) for s in range(30)]
        mask = sum(1 << s for s in set(sizes))
        room = rng.randint(3, 16)
        every = {tuple(sorted(c, reverse=True)) for n in range(8) for c in itertools.combinations(sizes, n) if sum(c) <= room}

        def worse(f):
            waste = room - sum(f)
            for s in set(sizes):
                if counts[s] > f.count(s):
                    for n in range(len(f) + 1):
                        for part in itertools.combinations(f, n):
                            if part != (s,) and s - waste <= sum(part) <= s and (sum(part) < s or n > 1):
                                return True
            return False

        got = [tuple(f) for f in fillings_in_order(counts, mask, room, [10**6])]
        assert len(set(got)) == len(got) and set(got) == {f for f in every if not worse(f)}
        assert [room - sum(f) for f in got] == sorted(room - sum(f) for f in got)
        assert all(dominated(list(f), counts, mask, room) == worse(f) for f in every)


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    files = tokenizer_files()
    plain, fast = Tokenizer.from_file(files[0]), Encoder(*files)
    texts = ["", " ", "a", " a b", "a  b", "line\n\n next", "\tTab and space ", "don't <|endoftext|> stop", "Ünïcode 世界 🙂 x", "1234 56,7 !!??", "end \n", *(words(random.Random(i), 50) for i in range(5))]
    for text in texts:
        assert np.frombuffer(fast(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_pieces_restore_the_tokens(spark):
    rows = odd_rows()
    got = pack(crowded(table(spark, rows)), shard_pieces=4).collect()
    encode = Encoder(*tokenizer_files())
    want = []
    for i, text in rows:
        ids = np.frombuffer(encode(text or ""), "<u4").tolist() + [2]
        first = len(ids) - (len(ids) - 1) // 1024 * 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert pack(table(spark, [])).count() == 0

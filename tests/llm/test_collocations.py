import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from annot.llm import collocations as c

from .cases import crowded, odd_rows


def texts(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string")


def plain(rows, least, pct, longest=5):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        good = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        held = defaultdict(int)
        for p, a in good.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        held[p[i:j]] = max(held[p[i:j]], a)
        for p, a in good.items():
            if p not in held or 100 * held[p] < pct * a:
                score, k = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                out.append((lang, " ".join(p), a, own[p[:k]], own[p[k:]], total[lang], score))
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in c.collocations(df, **options).select("lang", "phrase", "a", "l", "r", "n", "score").collect())


def sample(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(12)] + ["É", "世界", "a b", "x\x1cy"]
    fixed = ["new york city", "the end of the day", "a a a a a a"]
    out = []
    for _ in range(150):
        w = [rng.choice(vocabulary) if rng.random() < 0.8 else rng.choice(fixed) for _ in range(rng.randint(0, 40))]
        out.append(("".join(x + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for x in w), rng.choice(["en", "en", "de", None, "und"])))
    return [*out, *[(t, "en") for _, t in odd_rows()], (None, None), ("", "fr"), out[0]]


@pytest.mark.parametrize("seed,pct,longest", [(1, 100, 5), (2, 80, 5), (3, 100, 3)])
def test_equals_brute_force(spark, seed, pct, longest):
    rows = sample(seed)
    assert found(crowded(texts(spark, rows)), least=5, absorb_pct=pct, longest=longest) == plain(rows, 5, pct, longest)


def test_few_bits_change_nothing(spark):
    rows = sample(4)
    assert found(texts(spark, rows), least=4, bits=15) == plain(rows, 4, 100)


def test_words_with_one_hash_are_told_apart(spark, monkeypatch):
    rows, split, hashed, seeds = sample(5), c._split, c._hashed, []
    monkeypatch.setattr(c, "_split", lambda seed: seeds.append(seed) or split(seed))
    monkeypatch.setattr(c, "_hashed", lambda seed: hashed(seed) if seed else _clashing(hashed(0)))
    assert found(texts(spark, rows), least=5) == plain(rows, 5, 100) and seeds == [0, 1]


def _clashing(hashed):
    def same(batches):
        import pyarrow as pa

        for b in hashed(batches):
            yield b.set_column(4, "key", pa.array([7] * b.num_rows, pa.int64()))

    return same


def test_a_word_that_is_a_languages_name_is_no_clash(spark, monkeypatch):
    rows, split, seeds = [("en de es fr. " * 9, lang) for lang in ("en", "de", "es")], c._split, []
    monkeypatch.setattr(c, "_split", lambda seed: seeds.append(seed) or split(seed))
    assert found(texts(spark, rows), least=5) == plain(rows, 5, 100) and seeds == [0]


def test_products_beyond_64_bits(spark):
    score = spark.range(1).selectExpr("(cast(cast(9000000000000 as decimal(16,0)) * 1000 as decimal(20,0)) * cast(9000000000000 as decimal(17,0))) div (cast(9000000000001 as decimal(18,0)) * cast(8999999999999 as decimal(18,0))) as s").head().s
    assert score == 1000 * 9000000000000 * 9000000000000 // (9000000000001 * 8999999999999)


def test_empty_table_and_rare_phrases(spark):
    assert found(texts(spark, [("a b", "en")]).where("false")) == []
    assert found(texts(spark, [("a b", "en"), (None, None)])) == []


def test_query_equals_sql(spark, tmp_path):
    rng = random.Random(6)
    rows = [(" ".join(rng.choice(["one", "two", "Three", "four.", "five"]) for _ in range(60)), rng.choice(["en", None])) for _ in range(120)]
    texts(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in c.op11_phrase_collocations(spark, str(tmp_path)).collect())
    duckdb_rows = duckdb.connect().execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'").execute(c.ORACLE).fetchall()
    assert got and got == sorted(duckdb_rows)


def test_rare_windows_are_not_sent(spark, monkeypatch, tmp_path):
    """All pairs of these words are frequent and all that is longer is rare: windows of more words would be nearly as many as the words."""
    rng, windows = random.Random(7), c._windows
    rows = [(" ".join(f"w{rng.randrange(20)}" for _ in range(200)), "en") for _ in range(60)]
    monkeypatch.setattr(c, "_windows", lambda *args: _noting(windows(*args), str(tmp_path)))
    assert found(texts(spark, rows), least=10) == plain(rows, 10, 100)
    sent = [int(n) for f in tmp_path.iterdir() for n in f.read_text().split()]
    assert sum(sent[::2]) > 10_000 and sum(sent[1::2]) < 500


def _noting(look, folder):
    """look, with the rows of each batch and those of more than two words noted in a file."""
    def noted(batches):
        import uuid

        for b in look(batches):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{b.num_rows} {(b['w3'].to_numpy() != 0).sum()}")
            yield b

    return noted


def test_all_lengths_and_many_parts(spark, monkeypatch):
    rows = sample(8)
    monkeypatch.setattr(c, "PART_WORDS", 10)
    monkeypatch.setattr(c, "BLOCK_PHRASES", 50)
    monkeypatch.setattr(c, "LOOK_BYTES", 500)
    assert found(texts(spark, rows), least=3, longest=4) == plain(rows, 3, 100, 4)
    assert found(texts(spark, rows), least=3) == plain(rows, 3, 100)


def test_parts_of_a_language_are_ranked_first(spark, monkeypatch, tmp_path):
    rng = random.Random(9)
    rows = [(" ".join(f"w{rng.randrange(9)}" for _ in range(300)), rng.choice(["en", "de"])) for _ in range(100)]
    texts(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(c, "TOP", 7)
    monkeypatch.setattr(c, "RANK_PARTS", 3)
    df = c.op11_phrase_collocations(spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number()") == 2
    best = {lang: sorted((r for r in plain(rows, 100, 100) if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1])) for lang in ("de", "en")}
    assert min(map(len, best.values())) > 21
    assert sorted(tuple(r) for r in df.collect()) == [(lang, i, *r[1:]) for lang in ("de", "en") for i, r in enumerate(best[lang][:7], 1)]

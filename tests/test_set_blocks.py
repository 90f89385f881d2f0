"""Similar sets through blocks of bitmaps, whatever their sizes and however frequent their words."""
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import set_blocks
from tidemark.operators.set_blocks import SLOTS, Sets, bitmaps, close_pairs, earliest_arrivals, fold, in_order, reach, shared_words, spans
from tidemark.operators.similarity import first_matches, similar_variants, variants


def test_pairs_over_many_blocks_and_sizes_match_brute_force(spark):
    r = random.Random(4)
    sets = []
    for n in (1, 2, 3, 5, 9, 40, 70, 150, 300):
        for _ in range(8):
            s = set(r.sample(range(1500), n))
            sets += [s, set(list(s)[:max(1, int(n * r.uniform(0.5, 1)))]), s | set(r.sample(range(1500), max(1, n // r.choice([1, 2, 4, 8]))))]
    sets = sorted({tuple(sorted(f"w{x}" for x in s)) for s in sets})
    v = variants(spark.createDataFrame([(list(s),) for s in sets], "tokens array<string>"))
    key = {x.variant: tuple(x.tokens) for x in v.collect()}
    want = {frozenset((a, b)) for a, b in itertools.combinations(sets, 2) if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.6}
    assert len(want) > 50
    for block in (7, 32_768):
        got = [frozenset((key[x.a], key[x.b])) for x in similar_variants(v, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_word_that_all_sets_lead_with_makes_no_join_of_its_own(spark):
    """Sets of three words of which two are everywhere: each pair meets twice on words, and none is similar."""
    d = spark.range(300).select(F.array(F.lit("aa"), F.lit("bb"), *[F.concat(F.lit(f"x{k}_"), F.col("id").cast("string")) for k in range(4)]).alias("tokens"))
    out = similar_variants(variants(d))
    assert out.count() == 0
    assert "Generate explode(tokens" not in out._jdf.queryExecution().executedPlan().toString()


def test_folded_bitmaps_are_narrower_bitmaps():
    h = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63 - 1, 500)
    bounds = np.array([0, 10, 10, 300, 500])
    assert (fold(bitmaps(h, bounds, 1024), 4) == bitmaps(h, bounds, 256)).all()


def test_frequent_words_cost_nothing_outside_the_window(spark):
    """A thousand titles of common words, a day apart: a window holds four, so few groups of rows are compared."""
    d = spark.range(1000).select(F.col("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 86_400).alias("at"),
                                 F.array(*[F.concat(F.lit(f"c{k}_"), F.pmod(F.floor(F.col("id") / 3 ** k), F.lit(3)).cast("string")) for k in range(7)]).alias("tokens"))
    rows = {x.id: set(x.tokens) for x in d.collect()}
    near = [next((j for j in range(max(0, i - 3), i) if len(rows[i] & rows[j]) / len(rows[i] | rows[j]) >= 0.6), None) for i in range(1000)]
    links = first_matches(d, "id", "at")
    assert {x.id: x.parent for x in links.collect()} == dict(enumerate(near))
    assert "token" not in str(links._jdf.queryExecution().optimizedPlan().toString()).replace("tokens", "")
    for block in (2, 3):
        assert {x.id: x.parent for x in first_matches(d.where("id < 60"), "id", "at", window_hours=240, block=block).collect()} == {
            i: next((j for j in range(max(0, i - 10), i) if len(rows[i] & rows[j]) / len(rows[i] | rows[j]) >= 0.6), None) for i in range(60)}


def block_of(sets, threshold=0.6):
    """A block that is compared with itself, of sets of hashes sorted by size, and how often it holds a word."""
    n, flat = np.array([len(x) for x in sets]), np.concatenate([np.array(x, np.int64) for x in sets])
    bounds = np.concatenate(([0], np.cumsum(n)))
    counts = np.bincount((flat.view(np.uint64) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
    words = in_order(flat, bounds, np.minimum(255, 8 * np.log2(np.maximum(counts, 1))).astype(np.uint8))
    lead = reach(n, int(n.min()), int(n.max()), threshold)
    return Sets(n, words[spans(bounds[:-1], lead)], np.concatenate(([0], np.cumsum(lead))), bitmaps(flat, bounds, 512)), flat, bounds


def near_sets(r, common, rare, n):
    """Sets of n words, of which some have a near copy."""
    sets = [r.sample(common, n // 2) + r.sample(rare, n - n // 2) for _ in range(300)]
    sets += [s[:-3] + r.sample(rare, 3) for s in sets[:40]] + [s[: n * 3 // 4] for s in sets[40:70]]
    return sorted(sets, key=len)


def alike(sets, threshold=0.6):
    return {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= threshold}


def test_only_sets_that_meet_on_a_rare_word_are_compared(monkeypatch):
    """All sets share many words, yet no set is looked at against a whole block: the bitmaps of few pairs are asked."""
    r = random.Random(8)
    words = [r.getrandbits(64) - 2 ** 63 for _ in range(6100)]
    sets = near_sets(r, words[:100], words[100:], 60)
    block, flat, bounds = block_of(sets)
    asked = []
    limit = set_blocks._limit
    monkeypatch.setattr(set_blocks, "survivors", lambda *a: pytest.fail("a set was compared with the whole block"))
    monkeypatch.setattr(set_blocks, "_limit", lambda total, threshold: asked.append(len(total)) or limit(total, threshold))
    a, b = close_pairs(block, None, 0.6)
    want = alike(sets)
    assert len(want) >= 70 and want <= set(zip(a.tolist(), b.tolist())) and sum(asked) < len(sets) ** 2 / 40
    shared = shared_words(flat, bounds, a, b)
    assert shared.tolist() == [len(set(sets[i]) & set(sets[j])) for i, j in zip(a, b)]


def test_pairs_of_two_blocks_and_of_frequent_words_lose_nothing():
    r = random.Random(9)
    words = [r.getrandbits(64) - 2 ** 63 for _ in range(90)]
    sets = near_sets(r, words[:45], words[45:], 40)                 # every word is frequent: all pairs of fitting sizes are looked at
    block, _, _ = block_of(sets)
    assert alike(sets) <= set(zip(*(x.tolist() for x in close_pairs(block, None, 0.6))))

    def part(of):
        at = np.array(of)
        n = np.diff(block.bounds)[at]
        return Sets(block.sizes[at], block.words[spans(block.bounds[at], n)], np.concatenate(([0], np.cumsum(n))), block.maps[at])
    odd, even = list(range(1, len(sets), 2)), list(range(0, len(sets), 2))
    a, b = close_pairs(part(odd), part(even), 0.6)
    assert {p for p in alike(sets) if (p[0] + p[1]) % 2} <= {tuple(sorted((odd[x], even[y]))) for x, y in zip(a, b)}


def test_leading_words_reach_every_similar_size():
    for n, m in itertools.product(range(1, 60), repeat=2):
        for shared in range(min(n, m) + 1):
            if shared / (n + m - shared) >= 0.6:
                # The shared words may all come last in both sets; the first of them must be among the leading words.
                assert reach(np.array([n]), m, m, 0.6)[0] >= n - shared + 1 and reach(np.array([n]), 1, 1000, 0.6)[0] >= n - shared + 1


def test_variants_may_be_numbers_and_tokens_hashes(spark):
    rows = [(k, [10 * g + x for x in range(10)][k % 3:]) for k, g in enumerate([1, 1, 1, 5, 5, 9])]
    v = spark.createDataFrame(rows, "variant bigint, tokens array<bigint>")
    want = {(i, j, len(set(a) & set(b)) / len(set(a) | set(b))) for (i, a), (j, b) in itertools.combinations(rows, 2) if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.6}
    assert len(want) == 4 and {tuple(x) for x in similar_variants(v).collect()} == want


def test_clusters_look_back_on_every_earlier_document(spark, tmp_path):
    """copies and near copies many documents apart are one cluster, in the query and in its SQL."""
    import duckdb

    from tidemark.registry import QUERIES, SQL
    r = random.Random(11)
    texts = [" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(12)) for _ in range(2000)]
    texts[1500], texts[1999] = texts[3], texts[3] + " another"
    texts[700] = "word " + texts[40]
    spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(texts)], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.cluster_id: x for x in QUERIES["near_duplicate_clusters"](spark, str(tmp_path)).collect()}
    assert len(got) == 1997 and got[3].n_members == 3 and got[40].n_members == 2
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(SQL["near_duplicate_clusters"]).fetchall()) == sorted((x.cluster_id, x.n_members, x.title_length, x.first_seen_at) for x in got.values())


def test_earliest_arrivals_match_brute_force():
    r = random.Random(12)
    units = [sorted(r.sample(range(60), r.randint(1, 6))) for _ in range(12)]
    times, bounds = np.concatenate(units).astype(np.int64), np.concatenate(([0], np.cumsum([len(u) for u in units])))
    ids = [f"id{r.randrange(10 ** 6)}" for _ in times]
    pairs = [p for p in itertools.permutations(range(12), 2) if r.random() < 0.4]
    want = {}
    for u, w in pairs:
        for x in range(bounds[u], bounds[u + 1]):
            found = [(times[y], ids[y]) for y in range(bounds[w], bounds[w + 1]) if times[x] - 9 <= times[y] <= times[x]]
            if found:
                want[x] = min([*found, want.get(x, min(found))])
    asked, seen = earliest_arrivals(times, pa.array(ids), bounds, *np.array(pairs).T, 9)
    assert {x: (times[y], ids[y]) for x, y in zip(asked.tolist(), seen.tolist())} == want

import numpy as np
from data import components, jaccard_links

from tidemark.llm import hamming, jaccard, neighbours


def near_brute(rows, cosine=neighbours.COSINE):
    """{vec_id: (n_links, component_id, kept)} of (vec_id, vector, label) rows with different ids, none null or zero."""
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, label = np.array([i for i, _, _ in rows]), np.array([k for _, _, k in rows])
    near = (x @ x.T >= cosine) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    comp = components([(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(near)) if a < b], ids.tolist())
    return {int(i): (int(n), comp[int(i)], comp[int(i)] == int(i)) for i, n in zip(ids, near.sum(1))}


def near_got(spark, rows):
    frame = spark.createDataFrame([(i, [float(c) for c in v], k) for i, v, k in rows], "vec_id long, embedding array<double>, label int")
    return {a.vec_id: (a.n_links, a.component_id, a.kept) for a in neighbours.near_duplicates(frame).collect()}


def two_groups(r, n, width=32):
    """Two groups of ``n`` vectors, about 0.99 inside and 0.94 across, label 1; and as many that link with none, of two labels."""
    a, b = np.eye(width)[:2]
    b = 0.951 * a + np.sqrt(1 - 0.951 ** 2) * b
    x = np.concatenate([c + r.normal(scale=0.1 / np.sqrt(width), size=(n, width)) for c in (a, b)] + [r.normal(size=(2 * n, width))])
    return x, [1] * (2 * n) + [1 + i % 2 for i in range(2 * n)]


def test_neighbours_of_two_saturated_groups(spark):
    """No list of either group has room for the other: their links are found by comparing groups."""
    x, label = two_groups(np.random.default_rng(6), 150)
    rows = list(zip(range(len(x)), x, label))
    got, want = near_got(spark, rows), near_brute(rows)
    links = sum(n for n, _, _ in got.values()), sum(n for n, _, _ in want.values())
    assert got == want, f"{links[0]} of {links[1]} link ends"


def test_neighbours_count_copies_in_saturated_groups(spark):
    """Every copy of a linked vector counts, listed or not."""
    r = np.random.default_rng(7)
    base = np.eye(32)[0] + r.normal(scale=0.02, size=(100, 32))
    x = np.concatenate([base, base[:60], base[:30], r.normal(size=(60, 32))])
    rows = list(zip(range(len(x)), x, [1] * len(x)))
    got, want = near_got(spark, rows), near_brute(rows)
    links = sum(n for n, _, _ in got.values()), sum(n for n, _, _ in want.values())
    assert got == want, f"{links[0]} of {links[1]} link ends"


def test_neighbours_without_lists(spark, monkeypatch):
    """Where no list finds anything, the audits fail and all vectors are compared, copies included."""
    x, label = two_groups(np.random.default_rng(8), 40)
    rows = list(zip(range(len(x) + 20), np.concatenate([x, x[:20]]), [*label, *label[:20]]))
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    monkeypatch.setattr(neighbours, "SHARE", 2)
    monkeypatch.setattr(neighbours, "nn_descent", lambda data, size, seed: data.sparkSession.createDataFrame([], "a long, b long, s double"))
    assert near_got(spark, rows) == near_brute(rows)


def test_hamming_copies_tied_with_single_codes(spark):
    """Ids of tied codes mix by id, however many copies one of them has."""
    r = np.random.default_rng(5)
    bits = {0: r.random(40) > 0.5}

    def flipped(*at):
        b = bits[0].copy()
        b[list(at)] ^= True
        return b
    a, b, c = flipped(1, 17, 33), flipped(2, 18, 34), flipped(1, 2, 3)
    bits |= {5: a, 7: b, 9: c, 11: b} | {i: a for i in range(500, 521)} | {i: c for i in range(600, 605)}
    bits |= {i: flipped(0, 5) for i in (300, 301)} | {i: r.random(40) > 0.5 for i in range(700, 760)}
    rows = [(i, [1.0 if v else -1.0 for v in x], 1) for i, x in bits.items()]
    codes = hamming.binary_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got, want = {}, {}
    for x in hamming.hamming_search(codes, codes, 10).collect():
        got[x.query_id, x.rank] = x.neighbour_id, x.distance
    for q in bits:
        near = sorted((int((bits[q] != bits[j]).sum()), j) for j in bits if j != q)[:10]
        want |= {(q, k + 1): (j, d) for k, (d, j) in enumerate(near)}
    wrong = sum(got.get(k) != v for k, v in want.items())
    assert got == want, f"{wrong} of {len(want)} places wrong"


def test_jaccard_null_doc_id_first(spark):
    """A set whose first row of a chunk has a null doc_id still meets its near copies."""
    w = [f"w{i}" for i in range(60)]
    near = [*w[:30], "changed", *w[31:]]
    rows = [(None, " ".join(w)), (1, " ".join(w)), (2, " ".join(near)), (3, " ".join(w)), (4, "something else of more than five words")]
    got = {x.doc_id: (x.component_id, x.n_links) for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    sets, links = jaccard_links(rows[1:])
    comp = components(links, sets)
    want = {i: (comp[i], sum(i in pair for pair in links)) for i in sets} | {None: (None, 0)}
    assert got == want, f"{sum(n for _, n in got.values())} of {sum(n for _, n in want.values())} link ends"

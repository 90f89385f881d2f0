"""Operators against brute force, the tokenizers library, SQL, and held-out labels."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from data import SCHEMA, components, counted, jaccard_links, odd_rows, words
from oracle import compare, connect

import __spark_entry__ as e
from tidemark.llm import bpe, hamming, jaccard, licences, mixing, neighbours, parsing, personal, pretokens, token_files, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def spec():
    return token_files.tokenizer_spec()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", ["op2_hamming_top_k", "op7_licence_scan"])
def test_sql(spark, name):
    result, _ = compare(spark, connect(FOLDER), FOLDER, name, e.queries()[name], e.oracle_sql()[name])
    assert result.startswith("OK"), result


def test_jaccard(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    sets, links = jaccard_links([r for r in rows if r[0] is not None])
    comp, degree = components(links, sets), dict.fromkeys(sets, 0)
    for r in jaccard.jaccard_components(odd).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.n_links == 0 and r.n_shingles > 5
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), comp[r.doc_id])
            degree[r.doc_id] = r.n_links
    assert len(rows) == jaccard.jaccard_components(odd).count() and max(degree.values()) > 20


def test_jaccard_hot_family(spark):
    """Hundreds of variants of one text, most pairs near the bound, in many blocks."""
    r = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(600):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 40)}"
        rows.append((i, " ".join(w)))
    old, jaccard.BLOCK = jaccard.BLOCK, 32
    try:
        got = {x.doc_id: (x.component_id, x.n_links) for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        jaccard.BLOCK = old
    sets, links = jaccard_links(rows)
    comp = components(links, sets)
    degree = dict.fromkeys(sets, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert got == {i: (comp[i], degree[i]) for i in sets}


def test_hamming_ties_and_copies(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 40))
    x[50:180] = x[3]
    rows = [(i, None if i == 7 else [float(v) for v in x[i]], 1) for i in range(400)] + [(900, [1.0] * 8, 1), (None, [1.0] * 40, 1)]
    codes = hamming.binary_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = {(a.query_id, a.rank): (a.neighbour_id, a.distance) for a in hamming.hamming_search(codes, codes.where("id % 20 = 0 OR id = 900"), 10).collect()}
    bits, want = x > 0, {}
    for q in range(0, 400, 20):
        near = sorted(((int((bits[q] != bits[j]).sum()), j) for j in range(400) if j not in (q, 7)))[:10]
        want |= {(q, k + 1): (j, d) for k, (d, j) in enumerate(near)}
    assert got == want


def test_elias_fano():
    r = np.random.default_rng(3)
    for n, high in ((1, 0), (1, 10 ** 9), (5, 3), (5000, 4000), (5000, 10 ** 8), (700, 0)):
        v = np.sort(r.integers(0, high + 1, n))
        ef = token_files.EliasFano.encode(v)
        pick = r.integers(0, n, 50)
        assert (ef.all() == v).all() and (ef.select(pick) == v[pick]).all()
        spent = 8 * (len(ef.low) + len(ef.high)) + 32 * len(ef.directory)
        assert spent <= n * (2 + max(0, np.log2(max(1, high / n))) + 1) * 1.1 + 1200


def test_split_like_the_library(library, spec):
    r = random.Random(5)
    pool = [*"aZé ß'  \n\t   1٣½²·.,!?-_日本語ではא😀🏽\x1c\x85​ ", "'s", "'re", "'ll", "'t", " '", "''", "<|endoftext|>", " \n "]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["", "  ", "<|endoftext|>", "'s's don't 'sabc 'reab"]
    memory = pretokens.Memory(pretokens.pieces_of(spec), bits=6)
    ids, n = memory.encode(texts)
    ends = np.cumsum(n)
    for t, c, b, want in zip(texts, n, ends, library.encode_batch(texts, add_special_tokens=False)):
        assert want.ids == ids[b - c:b].tolist(), t


def test_token_files(spark, odd, library, spec, tmp_path):
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    old, token_files.SEGMENT_IDS = token_files.SEGMENT_IDS, 500
    try:
        token_files.write_tokens(odd, str(tmp_path / "t"), spec)
        got = token_files.read_tokens(spark, str(tmp_path / "t")).collect()
    finally:
        token_files.SEGMENT_IDS = old
    want, start = [], 0
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert counted(got) == counted(want)


def test_bpe(spark, odd, library, spec):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = bpe.encode(spark.createDataFrame(odd_rows(), SCHEMA), spec, bpe.digests(spec), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").collect()
    assert counted(got) == counted(want)


def test_decode_join(spark, library, spec):
    texts = ["it's é 😀", "", "two  words"]
    rows = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)]
    pieces = spark.createDataFrame(list(enumerate(map(bytearray, pretokens.pieces_of(spec).table()))), "id int, piece binary")
    got = {r.doc_id: bytes(r.text_bytes).decode() for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), pieces).collect()}
    assert got == dict(enumerate(texts))


def strings_brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p:p + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = True
        out.append(tuple(parsing.digest(i, np.frombuffer(b, np.uint8), gone).values()))
    return counted(out)


@pytest.mark.parametrize("hot", [4096, 2])
def test_passages(spark, hot):
    r = random.Random(3)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(10, 400))) for _ in range(9)]
    rows = []
    for i in range(160):
        t = "".join(b[a:a + r.randint(0, 200)] + r.choice(["", "x", "a" * 90]) for b in r.choices(base, k=r.randint(0, 4)) for a in [r.randint(0, len(b))])
        rows.append((i * 7 % 150, None if i == 9 else t))
    old, parsing.HOT = parsing.HOT, hot
    try:
        got = parsing.dedupe_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), parsing.digest,
                                      "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    finally:
        parsing.HOT = old
    assert counted(got) == strings_brute(rows)


def test_neighbours(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(700, 32))
    x[100:180] = x[5] + r.normal(scale=0.02, size=(80, 32))             # more than a list holds
    x[200:204] = x[9]
    x[300] = x[301] * 3e200
    label = r.integers(0, 3, 700)
    label[[*range(100, 180), 5]] = 1
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(700)]
    rows += [(1000, None, 1), (1001, [0.0] * 32, 1), (1002, [float("nan")] + [1.0] * 31, 1), (1003, [None] + [1.0] * 31, 1), (1004, [float(v) for v in x[5]], None), (1005, [1.0, 2.0], 1)]
    got = {a.vec_id: (a.n_links, a.component_id, a.kept) for a in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    y = x / np.abs(x).max(1, keepdims=True)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    comp = components([(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b], range(700))
    want = {i: (int(near[i].sum()), comp[i], comp[i] == i) for i in range(700)} | {i: (0, i, True) for i in range(1000, 1006)}
    assert got == want


def test_mix_targets(spark, odd):
    got = mixing.mix_plan(odd).collect()
    sizes = {}
    for r in odd.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / w for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    largest = {s: max(len(words(r.text)) for r in odd.collect() if r.source == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order) and len(got) == odd.count()
    assert counted(got) == counted(mixing.mix_plan(odd.repartition(3)).collect())


def test_personal_patterns():
    import re
    mail, card = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]([\x20-]?[0-9])+")
    ip, phone = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    r = random.Random(1)
    pool = ["a", "B", "1", "23", "4111111111111111", ".", ".", "@", "@", "%", "-", " ", "+", "+1", "(", "\n", "é", "000", "255", "x.y"]
    for _ in range(8000):
        t = "".join(r.choice(pool) for _ in range(r.randint(0, 25)))
        want = [("email", *m.span()) for m in mail.finditer(t)]
        want += [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
        want += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(digits(m.group())) <= 19 and personal.luhn(digits(m.group()))]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(digits(m.group())) <= 15]
        assert personal.base_spans(t) == want, t
    for t in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "1." * 100_000):
        personal.base_spans(t)


def test_field_finds_what_patterns_miss():
    field = personal.train_field()
    find = lambda t: [t[a:b] for _, a, b in personal.field_spans([t], field)[0]]
    assert find("mail bob (at) site (dot) org today") == ["bob (at) site (dot) org"]
    assert find("call (212) 555-0199 now") == ["(212) 555-0199"]
    assert find("on 2024-05-13 at 12:30 in version 3.2.1 of 1999") == []
    rows = personal.seed_rows(seed=99, repeats=1)
    hit = sum(any(s[0] == k and s[1] < b and s[2] > a for s in got) for (t, spans), got in zip(rows, personal.field_spans([t for t, _ in rows], field)) for k, a, b in spans if k in ("email", "phone"))
    assert hit >= 0.9 * sum(k in ("email", "phone") for _, spans in rows for k, _, _ in spans)


def test_viterbi_is_the_best_path():
    import itertools
    r = np.random.default_rng(0)
    field = personal.ChainCRF.blank()
    field.step += r.normal(size=field.step.shape)
    scores = r.normal(size=(9, len(personal.TAGS)))
    got = field.decode(scores, np.array([0, 4, 4, 7, 9]))
    for a, b in ((0, 4), (4, 7), (7, 9)):
        value = lambda p: field.begin[p[0]] + scores[a, p[0]] + sum(field.step[p[i - 1], p[i]] + scores[a + i, p[i]] for i in range(1, len(p)))   # noqa: E731, B023
        assert tuple(got[a:b]) == max(itertools.product(range(len(personal.TAGS)), repeat=b - a), key=value)


def test_toxicity_held_out():
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(2000)]
    bad = ["zorku", "zorkane", "zorkit", "gloom"]

    def make(n):
        texts, labels = [], []
        for i in range(n):
            w = [r.choice(vocabulary) for _ in range(r.randint(5, 120))]
            if i % 4 == 0:
                w[r.randrange(len(w))] = r.choice(bad)
            texts.append(" ".join(w).capitalize() + ".")
            labels.append(float(i % 4 == 0))
        return texts, np.array(labels, np.float32)
    model = toxicity.TextCNN()
    model.train(*make(900))
    texts, labels = make(300)
    model.calibrate(*make(200), ["en"] * 200)
    p = model.score(texts) >= toxicity.CUT
    assert (p == (labels == 1)).mean() > 0.95 and model.score([""])[0] < 0.5 and set(model.thresholds) == {"en"}
    one = model.score(texts)
    assert np.allclose(one, [model.score([t])[0] for t in texts], atol=1e-5)        # texts do not lean on their neighbours

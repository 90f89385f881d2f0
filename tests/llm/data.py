"""Small tables with every odd case, and plain answers to compare with."""
import collections
import random
import re

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, copies string, key int, bucket string"


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def odd_rows(n=120, seed=4):
    """Nulls everywhere, empty and blank texts, a very long text, exact and near copies, shared passages, repeated rows, and
    columns whose names the operators use inside."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7))) for _ in range(300)]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, copy = line(40), line(60)
    rows = []
    for i in range(n):
        text = line(r.randint(1, 80))
        kind = i % 8
        if kind == 1:
            text = copy
        elif kind == 2:
            parts = copy.split(" ")
            parts[r.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        elif kind == 3:
            text = f"{line(9)} {passage}\n{line(7)}"
        elif kind == 4:
            text = r.choice([None, "", "  \n\t", "One", "one two THREE", "mail a.b@c.example.com or +1 (415) 555-0132", "it's <|endoftext|> here", "日本語 😀  x"])
        rows.append((i * 5 % n if n % 5 else i, text, r.choice(["en", "de", None]), r.choice(["s1", "s2", None, "S9"]), None, 1, 0.5, "x", 3, "b"))
    rows.append((10_000, " ".join(r.choice(vocabulary) for _ in range(150_000)), "en", "s1", 0, None, None, None, None, None))
    rows.append((None, copy, None, None, None, None, None, None, None, None))
    rows += [rows[1], rows[1]]
    return rows


def components(links, nodes):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def jaccard_links(rows, k=5):
    """{doc_id: set}, links between ids, from (doc_id, text) rows with different ids."""
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, links


def counted(items):
    return collections.Counter(map(tuple, items))

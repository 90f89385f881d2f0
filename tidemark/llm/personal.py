"""Personal data: fixed patterns, plus a linear-chain conditional random field over word shapes, decoded by Viterbi."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
REACH = 3                       # words around a digit or at-sign that the field labels; all others are O
MOST_ROWS = 20_000              # labelled rows that training accepts

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")         # a run of digits that fails at its start fails inside too
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_HINT = re.compile(r"[0-9@]|[(\[{](?:at|AT)[)\]}]")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    own = sum(map(int, digits[-1::-2]))
    return (own + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, end = text.find("@"), 0
    while at >= 0:
        start = at                                              # no local part holds an at-sign, so no character is passed twice
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain is not None:
            yield start, domain.end()
            end = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost and non-overlapping per kind, in linear time; failing matches go."""
    out = [("email", *s) for s in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NO_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m.group())) <= 15]
    return out


# Words that tell what follows, or stand for a sign.
CUES = ["at", "(at)", "[at]", "{at}", "dot", "(dot)", "[dot]", "{dot}", "tel", "phone", "call", "fax", "mobile", "card", "mail", "email"]
_CUE = {w: i + 1 for i, w in enumerate(CUES)}
_SIGNS = "@+()-."
SIZES = (10, 4, 1 << len(_SIGNS), len(CUES) + 1)
EDGE = tuple(s for s in SIZES)  # the value of a position outside the sequence


@lru_cache(maxsize=200_000)
def shape(word: str) -> tuple[int, int, int, int]:
    """Digits in classes, kinds of letters, which signs it has, and whether it is a cue."""
    digits = sum("0" <= c <= "9" for c in word)
    lower, upper = any(c.islower() for c in word), any(c.isupper() for c in word)
    level = digits if digits <= 4 else 5 if digits < 8 else 6 if digits < 12 else 7 if digits < 16 else 8 if digits < 20 else 9
    return level, lower + 2 * upper, sum(1 << i for i, s in enumerate(_SIGNS) if s in word), _CUE.get(word.lower().strip(":,;"), 0)


@dataclass
class ChainCRF:
    """p(tags | words) with weights for (feature, value, tag) at the word before, the word and the word after, and for
    pairs of neighbouring tags. I follows only B or I of its kind."""
    emit: list[np.ndarray]      # per (place, feature): values x tags
    step: np.ndarray            # tags x tags
    begin: np.ndarray

    @staticmethod
    def blank() -> ChainCRF:
        n = len(TAGS)
        step, begin = np.zeros((n, n)), np.zeros(n)
        for j, t in enumerate(TAGS):
            if t[0] == "I":
                begin[j] = -1e4
                step[[i for i, s in enumerate(TAGS) if s[1:] != t[1:]], j] = -1e4
        return ChainCRF([np.zeros((s + 1, n)) for _ in range(3) for s in SIZES], step, begin)

    def scores(self, shapes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.zeros((len(shapes), len(TAGS)))
        for p, x in enumerate((left, shapes, right)):
            for f in range(len(SIZES)):
                out += self.emit[p * len(SIZES) + f][x[:, f]]
        return out

    def decode(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Viterbi for all sequences at once: sequence i owns rows bounds[i]:bounds[i + 1]."""
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        first, sizes = bounds[:-1][order], sizes[order]
        tags, back = np.zeros(len(scores), np.int8), np.zeros((len(scores), len(TAGS)), np.int8)
        if not len(scores):
            return tags
        alive = int((sizes > 0).sum())
        best = self.begin + scores[first[:alive]]
        final = np.zeros((len(first), len(TAGS)))
        final[:alive] = best
        for t in range(1, int(sizes[0])):
            alive = int((sizes > t).sum())
            paths = final[:alive, :, None] + self.step
            back[first[:alive] + t] = paths.argmax(1)
            final[:alive] = paths.max(1) + scores[first[:alive] + t]
        now = final.argmax(1)
        for t in range(int(sizes[0]) - 1, -1, -1):
            alive = int((sizes > t).sum())
            tags[first[:alive] + t] = now[:alive]
            if t:
                now[:alive] = back[first[:alive] + t, now[:alive]]
        return tags

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> None:
        """Gradient of the log likelihood by forward-backward over padded rows, with Adam; rows are (shapes, tags)."""
        n, most, k = len(rows), max(len(t) for _, t in rows), len(TAGS)
        x = np.tile(np.array(EDGE), (n, most + 2, 1))
        y, mask = np.zeros((n, most), np.int64), np.zeros((n, most), bool)
        for i, (s, t) in enumerate(rows):
            x[i, 1:len(t) + 1], y[i, :len(t)], mask[i, :len(t)] = s, t, True
        gold, hard_step, hard_begin = np.eye(k)[y] * mask[..., None], self.step <= -1e3, self.begin <= -1e3
        pairs = np.einsum("ntk,ntl->kl", gold[:, :-1], gold[:, 1:])
        params = [*self.emit, self.step, self.begin]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

        def norm(a, axis):
            top = a.max(axis, keepdims=True)
            return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)

        for epoch in range(1, epochs + 1):
            e = sum(self.emit[p * len(SIZES) + f][x[:, p:p + most, f]] for p in range(3) for f in range(len(SIZES)))
            fore, aft = np.zeros((n, most, k)), np.zeros((n, most, k))
            fore[:, 0] = self.begin + e[:, 0]
            for t in range(1, most):
                new = norm(fore[:, t - 1, :, None] + self.step, 1) + e[:, t]
                fore[:, t] = np.where(mask[:, t, None], new, fore[:, t - 1])
            z = norm(fore[:, -1], 1)
            for t in range(most - 2, -1, -1):
                new = norm(self.step + (e[:, t + 1] + aft[:, t + 1])[:, None, :], 2)
                aft[:, t] = np.where(mask[:, t + 1, None], new, aft[:, t + 1])
            p_one = np.exp(fore + aft - z[:, None, None]) * mask[..., None]
            p_two = np.exp(fore[:, :-1, :, None] + self.step + (e + aft)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            d = (p_one - gold) / n
            grads = []
            for p in range(3):
                for f in range(len(SIZES)):
                    g = np.zeros_like(self.emit[p * len(SIZES) + f])
                    np.add.at(g, x[:, p:p + most, f].ravel(), d.reshape(-1, k))
                    grads.append(g)
            g_step, g_begin = (p_two.sum((0, 1)) - pairs) / n, d[:, 0].sum(0)
            g_step[hard_step], g_begin[hard_begin] = 0, 0
            for i, g in enumerate([*grads, g_step, g_begin]):
                soft = np.where(params[i] > -1e3, params[i], 0)
                g = g + ridge * soft
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= rate * (m[i] / (1 - 0.9 ** epoch)) / (np.sqrt(v[i] / (1 - 0.999 ** epoch)) + 1e-8)


def words_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def seed_rows(seed: int = 2, repeats: int = 6) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: short lines with spans, made from frames in which <kind:...> marks personal data and # any digit."""
    frames = [
        "write to <email:anna (at) post (dot) org> today", "or <email:b.lee [at] mail [dot] net>, please", "contact <email:info(at)shop.com> for it", "send <email:jo{at}web.de> a note",
        "mail <email:kim## (at) site (dot) co (dot) uk>", "reach us: <email:me#[at]home.org>", "ask <email:sam.t@post.example.com> about it", "from <email:x_y##@mail#.example.com> again",
        "call <phone:(###) ###-####> now", "phone <phone:###-###-####> or come", "tel <phone:###.###.####> daily", "fax <phone:00## ## #######> only", "mobile <phone:0### #######> please", "his number <phone:(0##) #### ####> is new",
        "call <phone:+# (###) ###-####> back", "at <phone:+## ## #### ####> in time", "card <card:#### ###### #####> expires", "pay with <card:####.####.####.####> soon", "old <card:#### #### #### ####> card", "number <card:################> on it",
        "host <ip:##.###.##.###> is down", "from <ip:###.##.#.##>:#### came", "node <ip:##.##.###.#> and <ip:##.#.##.##> too",
        "on ####-##-## we met", "at ##:## in the hall", "version #.# of it", "version #.#.# came", "the year #### was good", "from #### to ####", "see page ### and ###", "costs ##.## each", "about #,###,### people", "id ######## was lost",
        "order ############ is sent", "token = \"#a##bc###d#e##f#a#b\" there", "password=#a##bf###c", "key AKIA#BC#DEF##GH is bad", "isbn ###-#-##-######-# sold", "under CC BY-NC #.#.", "chapter ## of ##", "see @home for more", "a @ b is odd", "it is (at) home",
        "meet at noon and go", "the result was ## percent", "room ### at ## street", "## ## ## ##", "####-####", "tracking ################## here", "# # # # # # # #", "score ###-###", "(####)", "p. ##-##",
    ]
    r, out = np.random.default_rng(seed), []
    for _ in range(repeats):
        for f in frames:
            f = re.sub("#", lambda _: str(r.integers(0, 10)), f)
            text, spans, at = "", [], 0
            for m in re.finditer(r"<(\w+):([^>]*)>", f):
                text += f[at:m.start()]
                spans.append((m.group(1), len(text), len(text) + len(m.group(2))))
                text += m.group(2)
                at = m.end()
            out.append((text + f[at:], spans))
    return out


def train_field(rows: list[tuple[str, list[tuple[str, int, int]]]] | None = None) -> ChainCRF:
    """Fits the field on (text, spans) rows; a table of at most MOST_ROWS rows, the built-in one where none is given."""
    rows = seed_rows() if rows is None else rows[:MOST_ROWS]
    data = []
    for text, spans in rows:
        words = words_of(text)
        tags, last = [], None
        for a, b in words:
            inside = next((s for s in spans if a < s[2] and b > s[1]), None)
            tags.append(TAGS.index(f"{'I' if inside is last and inside else 'B'}-{inside[0]}") if inside else 0)
            last = inside
        if words:
            data.append((np.array([shape(text[a:b]) for a, b in words]), np.array(tags)))
    field = ChainCRF.blank()
    if data:
        field.fit(data)
    return field


def _plausible(kind: str, s: str) -> bool:
    digits = _NO_DIGIT.sub("", s)
    if kind == "email":
        return bool(re.search(r"@|[(\[{]at[)\]}]", s, re.I)) and bool(re.search(r"\w\s*(?:\.|[(\[{]dot[)\]}])\s*\w", s, re.I))
    if kind == "ip":
        return False                                            # four parts in digits are what the pattern finds already
    if not re.fullmatch(r"[+()0-9. \x2d/]*", s):
        return False
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15 and len(re.findall("[0-9]+", s)) >= 2 and not re.fullmatch(r"\d{1,4}[-./]\d{1,2}[-./]\d{1,4}", s)


def field_spans(texts: list[str], field: ChainCRF) -> list[list[tuple[str, int, int]]]:
    """Spans the field labels in each text and that hold what their kind must hold. Lines with no digit and no at-sign have none."""
    seqs, shapes, where = [0], [], []
    for i, text in enumerate(texts):
        hint = _HINT.search(text)
        while hint is not None:
            a = text.rfind("\n", 0, hint.start()) + 1
            b = text.find("\n", hint.end())
            b = len(text) if b < 0 else b
            words = [m.span() for m in _WORD.finditer(text, a, b)]
            hot = np.zeros(len(words) + 2 * REACH, bool)
            for k, (x, y) in enumerate(words):
                if _HINT.search(text, x, y):
                    hot[k:k + 2 * REACH + 1] = True
            hot = hot[REACH:len(words) + REACH]
            for k in np.flatnonzero(hot).tolist():
                if (k == 0 or not hot[k - 1]) and len(shapes) > seqs[-1]:
                    seqs.append(len(shapes))
                shapes.append(shape(text[words[k][0]:words[k][1]]))
                where.append((i, *words[k]))
            if len(shapes) > seqs[-1]:
                seqs.append(len(shapes))
            hint = _HINT.search(text, b)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not shapes:
        return out
    x, bounds = np.array(shapes), np.array(seqs)
    left, right = np.roll(x, 1, 0), np.roll(x, -1, 0)
    left[bounds[:-1]], right[bounds[1:] - 1] = EDGE, EDGE
    tags = field.decode(field.scores(x, left, right), bounds)
    k = 0
    while k < len(tags):
        if TAGS[tags[k]][0] != "B":
            k += 1
            continue
        e = k + 1
        while e < len(tags) and where[e][0] == where[k][0] and TAGS[tags[e]] == "I" + TAGS[tags[k]][1:]:
            e += 1
        i, a, b = where[k][0], where[k][1], where[e - 1][2]
        while b > a and texts[i][b - 1] in ".,;:!?\"'" :
            b -= 1
        while a < b and texts[i][a] in "\"'":
            a += 1
        kind = TAGS[tags[k]][2:]
        if _plausible(kind, texts[i][a:b]):
            out[i].append((kind, a, b))
        k = e
    return out


def all_spans(texts: list[str], field: ChainCRF) -> list[tuple[list, list]]:
    """(base spans, all spans) per text; what the field finds stays unless it touches a base span."""
    out = []
    for text, more in zip(texts, field_spans(texts, field)):
        base = base_spans(text)
        extra = [s for s in more if not any(s[1] < b[2] and s[2] > b[1] for b in base)]
        out.append((base, sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, and spans that overlap as one, replaced by the kind of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_personal(docs: DataFrame, finish: Callable, schema, field: ChainCRF | None = None) -> DataFrame:
    """Rows of ``finish(row, text, base, spans)`` for every row of ``docs``, in one narrow stage.

    Whole texts are searched, null as empty. Spans are (kind, start, end) in code points, end exclusive. The field is a few
    thousand weights and travels with the tasks. Rows with one doc_id stay apart; an empty table gives no rows.
    """
    field = train_field() if field is None else field
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, names.index("text")):
            rows = batch.to_pylist()
            texts = [r["text"] or "" for r in rows]
            out = [finish(r, t, *s) for r, t, s in zip(rows, texts, all_spans(texts, field))]
            yield pa.RecordBatch.from_pylist(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    target = to_arrow_schema(kind)
    return docs.mapInArrow(run, kind)


def digests(row: dict, text: str, base: list, spans: list) -> dict:
    found = [k for k, _, _ in base]
    return {"doc_id": row["doc_id"], **{f"n_{k}": found.count(k) for k in KINDS}, "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(spans)}


def op4_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal(docs, digests, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")

"""Text columns: addresses, clean titles, tokens, keyword and claim detection, number tokens."""
from __future__ import annotations

import re
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CAUSAL_PATTERNS, DIRECTION_WORDS, NUMBER_PATTERN, STOP_WORDS, TRACKING_PATTERN
from .robust import let

# Named character references of HTML 4, and the apostrophe; the ampersand comes last so that nothing is unescaped twice.
ENTITIES = [(f"&{n};", chr(c)) for n, c in sorted(name2codepoint.items()) if n != "amp"] + [("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")]


def short_hash(n: int, *parts: Column) -> Column:
    """First n hex digits of the SHA-1 of pipe-joined parts; null counts as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *texts)), 1, n)


def _decoded(part: Column) -> Column:
    spaced = F.replace(part, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(part), spaced)           # a percent sign that starts no code stays


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """https, bare lower-case host, tracking and blank parameters dropped, the rest decoded, sorted by name and value, encoded."""
    u = F.trim(url)
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    host = F.regexp_replace(host, r"^(?:m|amp)\.", "")
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/amp/?$", ""), r"/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    given = F.filter(F.split(query, "&"), lambda kv: kv.rlike("^[^=]*=."))
    pairs = F.transform(given, lambda kv: F.struct(_decoded(F.regexp_extract(kv, "^([^=]*)=", 1)).alias("k"), _decoded(F.regexp_extract(kv, "^[^=]*=(.*)$", 1)).alias("v")))
    pairs = F.array_sort(F.filter(pairs, lambda p: ~F.regexp(p["k"], F.lit(TRACKING_PATTERN))))
    kept = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(F.lit("https://"), host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def unescape(text: Column) -> Column:
    """Character references, numeric and named, as the characters they stand for; unknown names stay."""
    names = F.create_map(*[F.lit(x) for name, char in ENTITIES for x in (name, char)])

    def one(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^&#[xX]?([0-9A-Fa-f]{1,7});$", 1)
        code = F.when(piece.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        return F.when(piece.rlike("^&#(?:[xX][0-9A-Fa-f]{1,7}|[0-9]{1,7});$"), char).otherwise(F.coalesce(F.try_element_at(names, piece), piece))

    pieces = F.regexp_extract_all(text, F.lit("(&#?[A-Za-z0-9]{1,32};|[^&]+|&)"), 1)
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def clean_text(text: Column, limit: int | None = None) -> Column:
    """Tags and control characters out, entities in, blanks collapsed; ``limit`` cuts what is stored."""
    s = unescape(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "))
    s = F.regexp_replace(s, "[\\x00-\\x08\\x0b-\\x1f\\x7f]", "")
    s = F.trim(F.regexp_replace(s, "[\\s\\u00a0]+", " "))
    return s if limit is None else F.substring(s, 1, limit)


def title_tokens(title: Column) -> Column:
    """Distinct lower-case words of three letters and more that are no stop words."""
    # The plain range is asked first: it holds most characters and costs far less than the lookup of a character's kind.
    words = F.regexp_extract_all(F.lower(title), F.lit(r"(?U)([a-z\w]+)"), 1)
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), stops)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens, 0 where either side is empty. Inputs hold no repeats."""
    shared = F.size(F.array_intersect(a, b))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def normal_text(text: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "), F.lit(" "))


def _keyword_pattern(keyword: str) -> str:
    k = "".join("\\" + c if c in r"\.^$|?*+()[]{}-" else c for c in keyword.lower())
    tail = r"(?!\w)" if len(keyword) <= 4 else ""
    return rf"(?<!\w){k}{tail}"


def _plain(keyword: str) -> bool:
    """Does a keyword consist of ASCII letters and digits only, so that blanks around it show its edges in spaced words?"""
    return re.fullmatch("[A-Za-z0-9]+", keyword) is not None


def _searched(text: Column, keywords: list[str], body) -> Column:
    """Hands ``body`` a struct of what the keywords are sought in: the words between blanks, and the normalised text if one needs it."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+", " "), F.lit(" ")).alias("words")
    whole = [] if all(_plain(k) for k in keywords) else [normal_text(text).alias("text")]
    return let(F.struct(words, *whole), body)


def _hits(t: Column, keywords: list[str]) -> Column:
    """``t`` comes from ``_searched``."""
    if not keywords:
        return F.array().cast("array<string>")

    def found(k: str) -> Column:
        if _plain(k):
            return t["words"].contains(F.lit(" " + k.lower() + (" " if len(k) <= 4 else "")))
        return t["text"].rlike("(?U)" + _keyword_pattern(k))
    return F.array_compact(F.array(*[F.when(found(k), F.lit(k)) for k in keywords]))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """The configured keywords found: short ones as whole words, longer ones at a word start.

    The text is turned into words between blanks once, in which plain keywords are sought as they stand; only keywords with
    other characters run a pattern. The keyword list is configuration and does not follow the data.
    """
    return _searched(text, keywords, lambda t: _hits(t, keywords))


def topic_hits(text: Column, topics: dict, aliases: list[str] = (), alias_topic: str | None = None) -> Column:
    """array<struct<topic, hits>> of the matched topics, in configured order."""
    def labelled(name: str, anchored: Column):
        return lambda h: F.when((F.size(h) > 0) & anchored, F.struct(F.lit(name).alias("topic"), h.alias("hits")))

    def found(t: Column) -> Column:
        out = []
        for name, cfg in topics.items():
            extra = list(aliases) if name == alias_topic else []
            anchors = list(cfg.get("require_any", [])) + (extra if cfg.get("require_any") else [])
            anchored = (F.size(_hits(t, anchors)) > 0) if anchors else F.lit(True)
            out.append(let(_hits(t, list(cfg["keywords"]) + extra), labelled(name, anchored)))
        return F.array_compact(F.array(*out))

    every = [k for cfg in topics.values() for k in [*cfg["keywords"], *cfg.get("require_any", [])]] + list(aliases)
    return _searched(text, every, found)


def claims(text: Column, words: dict[str, list[str]] = DIRECTION_WORDS) -> Column:
    """Sorted claim labels; up together with down becomes mixed. Words match anywhere in the text."""
    def flags(t: Column) -> Column:
        return F.struct(*[reduce(Column.__or__, [t.contains(F.lit(w.lower())) for w in ws], F.lit(False)).alias(k) for k, ws in words.items()])

    def labels(has: Column) -> Column:
        both = has["up"] & has["down"]
        return F.array_compact(F.array(
            F.when(has["disruption"], F.lit("disruption")), F.when(has["down"] & ~both, F.lit("down")),
            F.when(both, F.lit("mixed")), F.when(has["up"] & ~both, F.lit("up"))))

    return let(let(normal_text(text), flags), labels)


def claimed_direction(labels: Column) -> Column:
    """One label: mixed, then disruption, up, down; null when nothing is claimed."""
    return (F.when(F.array_contains(labels, "mixed"), "mixed")
            .when(F.array_contains(labels, "disruption"), "disruption")
            .when(F.array_contains(labels, "up"), "up")
            .when(F.array_contains(labels, "down"), "down"))


def canonical_number(token: Column) -> Column:
    """Minus sign unified, blanks and leading plus dropped, negative zero made plain."""
    t = F.translate(F.translate(token, "\u2212", "-"), "\u202f ", "")
    t = F.regexp_replace(t, r"^\++", "")
    return F.when(t.rlike(r"^-0[0.,]*$"), t.substr(F.lit(2), F.length(t))).otherwise(t)


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({NUMBER_PATTERN})"), 1)


def number_forms(v: Column) -> Column:
    """All spellings of a value a note may use: 0 to 4 digits, signed or not, with or without commas."""
    forms = []
    for d in range(5):
        plain = F.format_string(f"%,.{d}f", v)
        signed = F.format_string(f"%+,.{d}f", v)
        forms += [plain, signed, F.replace(plain, F.lit(","), F.lit("")), F.replace(signed, F.lit(","), F.lit(""))]
    forms.append(v.cast("string"))
    return F.when(v.isNotNull(), F.transform(F.array(*forms), canonical_number)).otherwise(F.array().cast("array<string>"))


def untraceable_numbers(text: Column, allowed: Column) -> Column:
    """Number tokens of a text that no allowed spelling covers. Counting words 0..10 always pass."""
    small = F.array(*[F.lit(str(i)) for i in range(11)])
    pairs = F.transform(number_tokens(text), lambda t: F.struct(t.alias("raw"), canonical_number(t).alias("c")))

    def unknown(x: Column, ok: Column) -> Column:
        c, bare = x["c"], F.rtrim(x["c"], F.lit("."))
        return (c != "") & ~F.array_contains(ok, c) & ~F.array_contains(ok, bare)

    return let(F.array_union(allowed, small), lambda ok: F.transform(
        F.filter(pairs, lambda x: unknown(x, ok)), lambda x: x["raw"]))


def causal_wording(text: Column) -> Column:
    """First conclusive phrase found for each listed pattern; one combined pass clears most texts."""
    any_of = "(?iU)(?:" + "|".join(CAUSAL_PATTERNS) + ")"
    found = F.array(*[F.regexp_extract(text, f"(?iU)({p})", 1) for p in CAUSAL_PATTERNS])
    return F.when(text.rlike(any_of), F.filter(found, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def dash_slug(text: Column, limit: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)


def german_slug(text: Column) -> Column:
    s = F.lower(text)
    for a, b in (("ü", "ue"), ("ö", "oe"), ("ä", "ae"), ("ß", "ss")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def untrusted(text: Column, limit: int = 40) -> Column:
    """Field text from a radio message: control characters, angle brackets and padding removed."""
    s = F.trim(F.replace(F.regexp_replace(text, "[\\x00-\\x1f\\x7f<>]", ""), F.lit("@"), F.lit("")))
    return F.nullif(F.substring(s, 1, limit), F.lit(""))

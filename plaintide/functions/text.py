"""Tokens, entities, keys, fingerprints and normal forms of text, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern, aliases, stop words, short words that are kept.
TOKEN = r"[a-z0-9][a-z0-9+.#-]*|[一-鿿぀-ヿ가-힯]+"
ALIASES = {
    "gpt4": "gpt-4", "gpt-4o": "gpt-4", "gpt4o": "gpt-4", "claude-3": "claude", "claude3": "claude", "llms": "llm", "agents": "agent",
    "integrations": "integration", "workflows": "workflow", "imports": "import", "exports": "export",
}
STOP = (
    "the a an of to for and or in on with is are be it its your you this that we i my our using use used can will would could should just now "
    "today vs via from into out up down get got make made build built want need would like please could able really very much more when how why "
    "what where who do does did not no yes also even still only"
).split()
SHORT = ("ai", "ui", "ux", "ml", "vr", "ar", "qa")
CJK = r"[一-鿿぀-ヿ가-힯]"
SIGNAL = (
    r"(error|bug|broken|crash|blank|reload|fail|can'?t|cannot|won'?t|doesn'?t|isn'?t|not work|stopped|stuck|glitch|freeze|lag|slow|down|outage|"
    r"rate.?limit|wish|would (be|love)|want to|need to|please add|feature|suggest|should (add|have|be)|how (do|to|can) i|is there (a|any) way|"
    r"why (does|is|isn|won|can'?t|doesn)|import|export|can'?t (find|save|load|login|pay|connect)|model|token|route|provider|character|lorebook|"
    r"preset|reply|generat|cost|credit|balance|plan|subscri|plus|billing|refund|报错|无法|不能|卡住|崩|闪退|求|建议|希望|怎么|为什么(不|没|会)|需求|功能)"
)


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a group."""
    depth, parts = 0, [""]
    for x in pattern[1:-1]:
        depth += {"(": 1, ")": -1}.get(x, 0)
        parts = [*parts, ""] if x == "|" and not depth else [*parts[:-1], parts[-1] + x]
    return parts


def by_letter(pattern: str) -> str:
    """A group of alternatives, each beginning with a plain letter, as one branch for each first letter, tried where such a letter is."""
    parts = alternatives(pattern)
    rest = {k: [p[1:] for p in parts if p[0] == k] for k in dict.fromkeys(p[0] for p in parts)}
    return f"(?=[{''.join(rest)}])(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in rest.items()) + ")"


_SIGNAL, _SIGNAL_WIDE = (by_letter(f"({'|'.join(x for x in alternatives(SIGNAL) if x[0].isascii() == plain)})") for plain in (True, False))
_WIDE = f"[{min(x[0] for x in alternatives(SIGNAL) if not x[0].isascii())}-{max(x[0] for x in alternatives(SIGNAL))}]"  # where one of the wide ones can begin
_LETTERS = "\u017f\u212a\u0131\u0130"  # long s, Kelvin, i without a dot, I with one
TOKENS_OF_ENTITIES, TOKENS_OF_SETS = 8, 64


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed one time: a lambda variable is not expanded where it is used."""
    return F.transform(F.array(value), use)[0]


def alias(token: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), token), token)


def slug(text: Column) -> Column:
    return alias(F.lower(F.trim(F.coalesce(text, F.lit("")))))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def entities(text: Column, limit: int | None = TOKENS_OF_ENTITIES) -> Column:
    """The first ``limit`` distinct content words, or all, aliases applied, in order. Only words that differ are looked at."""
    kept = F.filter(F.array_except(tokens(text), F.array(*map(F.lit, STOP))), lambda t: (F.length(t) >= 3) | t.isin(*SHORT) | ~t.rlike(r"^[\x00-\x7f]*$"))
    named = once(kept, lambda x: _aliased(x, lambda y: F.array_distinct(F.transform(y, alias))))
    return named if limit is None else F.slice(named, 1, limit)


def _aliased(words: Column, use: Callable[[Column], Column]) -> Column:
    """``use(words)`` where one of them has an alias."""
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, ALIASES))), use(words)).otherwise(words)


def canonical_key(entity_array: Column, track: Column) -> Column:
    """Sorted distinct slugs and the track's slug."""
    slugs = F.filter(F.transform(entity_array, slug), lambda x: x != "")
    return F.concat(F.array_join(F.array_sort(F.array_distinct(slugs)), "|"), F.lit("::"), slug(track))


def demand_id(key: Column) -> Column:
    return F.concat(F.lit("dm-"), F.left(F.sha1(key), F.lit(16)))


def idempotency_key(key: Column) -> Column:
    return F.concat(F.lit("demand:"), key)


def token_hash(token: Column) -> Column:
    """The first 64 bits of the token's MD5, as a signed integer of the same bits."""
    return F.conv(F.left(F.md5(token), F.lit(16)), 16, -10).cast("long")


def simhash(text: Column) -> Column:
    """A bit is set if more of the content tokens' hashes, repeats counted, have it set than not. No tokens: 0."""
    kept = F.filter(tokens(text), lambda t: ~t.isin(STOP) & ((F.length(t) >= 3) | ~t.rlike(r"^[\x00-\x7f]*$")))
    hashes = F.transform(once(kept, lambda x: _aliased(x, lambda y: F.transform(y, alias))), token_hash)

    long = lambda x: F.lit(x).cast("long")
    right = lambda x, n: F.call_function("shiftrightunsigned", x, n)

    def counted(h: Column, width: int) -> Column:
        """The bits that most hashes have. A long holds the counts of every ``width``-th bit side by side, so one pass over the hashes counts several; they stay below half its range, as the topmost has the sign."""
        lanes = long(sum(1 << k for k in range(0, 64, width)))
        counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.aggregate(h, long(0), lambda n, x: n + right(x, b).bitwiseAND(lanes)))

        def bit(n: Column, j: Column) -> Column:
            count = right(F.get(n, j % width), j - j % width).bitwiseAND(long((1 << width) - 1))
            return F.call_function("shiftleft", (2 * count > F.size(h)).cast("long"), j)

        return once(counts, lambda n: F.aggregate(F.sequence(F.lit(0), F.lit(63)), long(0), lambda out, j: out.bitwiseOR(bit(n, j))))

    def vote(h: Column) -> Column:
        return F.when(F.size(h) < 1 << 7, counted(h, 8)).when(F.size(h) < 1 << 15, counted(h, 16)).otherwise(counted(h, 32))

    return once(hashes, vote)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either side is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def norm_match(text: Column) -> Column:
    """Lower case, runs of other than word characters as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+", " "))


def meaning_length(text: Column) -> Column:
    """Characters other than spaces; ideographs, kana and hangul count twice."""
    bare = F.regexp_replace(text, " ", "")
    return F.length(bare) + F.length(F.regexp_replace(bare, "[^" + CJK[1:], ""))


def grounded(quote: Column, source: Column, least: int = 6) -> Column:
    q = norm_match(quote)
    return (meaning_length(q) >= least) & F.contains(norm_match(source), q)


def inline(text: Column) -> Column:
    """One line: white space collapsed, dashes as commas, backtick and bar neutralised."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.translate(F.regexp_replace(flat, r"(?U)\s*[–—―]+\s*", ", "), "`|", "'/")


def truncate(text: Column, cap: int) -> Column:
    """Cut at the last sentence end in the second half of the first ``cap`` characters, else with an ellipsis."""
    whole = F.trim(F.coalesce(text, F.lit("")))
    head = F.left(whole, F.lit(cap))
    last = F.greatest(*[F.when(F.locate(p, head) > 0, F.length(head) - F.locate(p[::-1], F.reverse(head)) + 1).otherwise(0) for p in ("。", "！", "？", "；", ". ", "! ", "? ")])
    return F.when(F.length(whole) <= cap, whole).when(last >= cap * 0.5, F.trim(F.left(head, last))).otherwise(F.concat(F.rtrim(head), F.lit("…")))


def prose_words(text: Column) -> Column:
    """Lower-case words of prose: code fences, table rows, link targets and markup are taken out first. A rule runs only where its marks are."""

    def without(t: Column, mark: str, pattern: str, put: str) -> Column:
        return F.when(F.contains(t, F.lit(mark)), F.regexp_replace(t, pattern, put)).otherwise(t)

    bare = without(F.coalesce(text, F.lit("")), "```", r"(?s)```.*?```", " ")
    bare = without(bare, "|", r"(?m)^\s*\|.*\|\s*$", " ")
    bare = without(bare, "](", r"\[([^\]]*)\]\([^)]*\)", "$1")
    bare = F.translate(bare, "`*_#>", "     ")
    # most words show a plain letter, and need no slower look
    return F.filter(F.split(F.lower(bare), r"(?U)\s+"), lambda w: w.rlike("[a-z]") | ((w != "") & ~w.rlike(r"(?U)^[\W\d_]+$")))


def shingles(text: Column, n: int = 8) -> Column:
    """Distinct n-word windows over prose, each as a 64-bit hash of its words' hashes: no window is written out."""
    hashes = F.transform(prose_words(text), lambda w: F.xxhash64(w))
    windows = lambda h: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, n))))
    return once(hashes, lambda h: F.when(F.size(h) >= n, windows(h)).otherwise(F.array().cast("array<bigint>")))


def keyword_hit(text: Column, keyword: str) -> Column:
    """ASCII keywords as words with a common ending, others as substrings; ``text`` is lower case."""
    if keyword.isascii():
        return text.rlike(r"(?U)(?<!\w)" + keyword.replace(".", r"\.") + r"(?:s|es|ed|ing|d)?(?!\w)")
    return F.contains(text, F.lit(keyword))


ENDINGS = ("", "s", "es", "ed", "ing", "d")


def track_hint(text: Column, taxonomy: tuple) -> Column:
    """The track with most keyword hits, then the largest weight, then the earliest; other if none hits.

    One-word ASCII keywords are looked up among the text's words, which are split off and narrowed to possible hits once; only
    keywords of several words need a pattern, and only where their first word is there.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    simple = [k for _, _, words in taxonomy for k in words if k.isascii() and k.isalnum()]
    forms = lambda k: F.array(*[F.lit(k + e) for e in ENDINGS])
    there = F.array_intersect(F.split(low, r"(?U)\W+"), F.array(*[F.lit(k + e) for k in simple for e in ENDINGS]))

    def hit(found: Column, k: str) -> Column:
        if k in simple:
            return F.arrays_overlap(found, forms(k)).cast("int")
        return (F.contains(low, F.lit(k)) & keyword_hit(low, k)).cast("int")

    def best(found: Column) -> Column:
        scored = F.array(
            *[
                F.struct(sum((hit(found, k) for k in words), F.lit(0)).alias("hits"), F.lit(float(weight)).alias("weight"), F.lit(-order).alias("place"), F.lit(name).alias("name"))
                for order, (name, weight, words) in enumerate(taxonomy)
            ]
        )
        return F.coalesce(F.array_max(F.filter(scored, lambda t: t["hits"] > 0))["name"], F.lit("other"))

    return once(there, best)


def has_signal(text: Column) -> Column:
    # letters that upper and lower case alone do not take to the letter they are read as
    plain = once(F.coalesce(text, F.lit("")), lambda t: F.lower(F.when(t.rlike(f"[{_LETTERS}]"), F.translate(t, _LETTERS, "skii")).otherwise(t)))
    return once(plain, lambda t: t.rlike(_SIGNAL) | (t.rlike(_WIDE) & t.rlike(_SIGNAL_WIDE)))

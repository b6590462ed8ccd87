"""Scanners over text tables: findings as (place, label, value, severity), coverage beside them."""

from __future__ import annotations

import io
import re
import tokenize
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaintide.functions import text
from plaintide.storage import shuffle_partitions

# Domains, local parts, codes, users and shapes that scanners accept or refuse.
SYNTHETIC_DOMAINS = (
    "example.com", "example.org", "example.net", "example.edu", "acme.com", "acme.io", "acme.test", "test.com", "localhost", "domain.com",
    "users.noreply.github.com", "noreply.github.com", "github.com", "anthropic.com",
)
SYNTHETIC_SUFFIXES = (".test", ".invalid", ".example", ".local", ".internal", ".localdomain", ".example.com", ".example.org", ".example.net")
#: First words of what stands behind an at-sign in code, not in an address.
DECORATORS = ("pytest", "mark", "fixture", "param", "parametrize", "patch", "mock", "staticmethod", "classmethod", "property", "dataclass", "app", "router", "task")
CONSUMER_DOMAINS = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "yahoo.com", "ymail.com", "aol.com", "icloud.com", "me.com", "mac.com",
    "proton.me", "protonmail.com", "pm.me", "tutanota.com", "zoho.com", "gmx.com", "mail.com", "qq.com", "foxmail.com", "163.com", "126.com", "sina.com", "yeah.net",
)
PLACEHOLDER_LOCALS = ("x", "y", "z", "a", "b", "u", "me", "you", "user", "user1", "user2", "test", "foo", "bar", "someone", "example", "your-email", "youremail")
ALLOWED_ZIPS = ("10001", "00000", "12345", "90210")
GENERIC_USERS = (
    "public", "default", "defaultuser", "administrator", "admin", "user", "users", "shared", "guest", "root", "runner", "runneradmin", "vscode", "distiller", "vagrant",
    "ubuntu", "ec2-user", "circleci", "travis", "jenkins", "you", "youruser", "username", "name", "someone", "example", "test", "me", "home", "app", "docker", "node",
    "foo", "bar", "baz", "alice", "bob", "yourname", "your-name",
)
#: Folders of a home that are its owner's alone.
PRIVATE_FOLDERS = ("claude", "agent-center", "secrets", "pw-auth")
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}\b"
PHONE = r"(?<![\w.\-])(?:\+?1[\s.\-])?\(?([2-9]\d{2})\)?[\s.\-]([2-9]\d{2})[\s.\-](\d{4})(?![\w.\-])"
#: Words near which three numbers with hyphens are a shape, and how near.
DIMENSIONS = (
    "kernel", "layer", "layers", "dim", "dims", "dimension", "shape", "size", "sizes", "conv", "hidden", "channel", "channels", "stride", "padding", "batch", "seq", "embed", "embedding", "filter",
    "filters", "units", "neurons", "heads", "width", "height", "resolution", "mlp", "ffn", "vocab", "window", "patch", "grid", "tile", "block", "blocks", "stage", "stages",
)
PHONE_NEAR = 40
#: Words after a bare "zip" that make it an archive; 64 is one, the first digits of a postal code are not.
ARCHIVE_WORDS = (
    "archive", "file", "files", "format", "compress", "compressed", "compression", "extract", "extraction", "bomb", "entry", "entries", "member", "members", "64(?![0-9])", "utility", "tool", "stream",
    "reader", "writer",
)
ZIP = r"(?i)(?:\bzip\s*code\b|\bzipcode\b|\bpostal\s*code\b|邮编|\bship(?:ping)?\s+to\b|\bdeliver\s+to\b|\bzip\b(?!\s*(?:" + "|".join(ARCHIVE_WORDS) + r")))[^\n]{0,24}?\b([0-9]{5})\b"
USER_PATH = r"(?:[A-Za-z]:\\{1,4}Users\\{1,4}|/(?:home|Users)/)([A-Za-z0-9][\w.\-]{0,31})"
HOME_FOLDER = r"(?i)(?:~|\$HOME|\$env:USERPROFILE|\$env:HOME|%USERPROFILE%)[\\/](\.(?:" + "|".join(PRIVATE_FOLDERS) + r")\b[\w./\\-]*)"
#: Home folders that documents may name.
PUBLIC_FOLDER = r"^\.claude(?:\.json\b|-plugin\b|[\\/](?:skills|plugins|agents|commands)(?:[\\/][\w.\-]+)?[\\/]?$)"
#: An allowed value covers a path as a part of it from so many characters, or from so many with a dot or slash.
ALLOW_LONG, ALLOW_PATH = 8, 5
#: Shapes of paths that real runs leave behind, first match wins.
RUN_SHAPES = (
    ("ledger under metrics", r"(?i)(^|/)metrics/.*\.(jsonl|ndjson)$"),
    ("under runs", r"(?i)(^|/)runs/"),
    ("dated file in an output directory", r"(?i)(^|/)(reports?|archive|digests?|logs?|out|output|state|snapshots?)/.*(\d{4}-\d{2}-\d{2}|\d{4}-\d{2}(?!\d)|\d{8})"),
    ("ledger in an output directory", r"(?i)(^|/)(archive|logs?|state|out|output|runs|reports?)/.*\.(jsonl|ndjson)$"),
    ("live ledger name", r"(?i)(^|/)(ledger|live-runs|events|dry-run|verdicts|opportunities|history|transcript|pulls-\d{4}-\d{2})\.(jsonl|ndjson)$"),
    ("run state name", r"(?i)(^|/)(escalation_state|fleet-check-status|bandit-state|throttle-state|dedup-state)\.json$"),
    ("database file", r"(?i)\.(db|sqlite|sqlite3)$"),
)
SHAPE_EXEMPT = r"(?i)\.(example|sample|tmpl|template)(\.|$)"
DUP_PCT_MAX, PAIR_MIN = 2.0, 12
_PHONE = re.compile(PHONE)
_DIMENSIONS = re.compile(r"\b(?:" + "|".join(DIMENSIONS) + r")\b", re.I)
#: Characters of the tokens of one automaton, which every task builds; a longer list takes a pass for each so many.
AUTOMATON_CHARS = 1 << 22
#: Shingles that a task compares before it sends them.
HELD = 1 << 20
#: Characters of texts whose shingles a task is given, on average.
CHARS = 1 << 25


def _allowed(value: Column, allow: tuple[str, ...]) -> Column:
    return F.lower(value).isin(*(x.lower() for x in allow)) if allow else F.lit(False)


def is_specific(entry: str) -> bool:
    """Whether an allowed value is long enough, or enough of a path, to cover longer values that hold it."""
    return len(entry) >= ALLOW_LONG or (len(entry) >= ALLOW_PATH and any(c in entry for c in "./\\"))


def _covered(value: Column, allow: tuple[str, ...]) -> Column:
    """Whether a path is allowed: itself, or by a specific part of it."""
    out = _allowed(value, allow)
    for entry in allow:
        if is_specific(entry):
            out = out | F.contains(F.lower(value), F.lit(entry.lower()))
    return out


def _each(texts: DataFrame, guard: Column, pattern: str, group: int) -> DataFrame:
    """Matches by row, equal ones once; the cheap guard spares most rows the pattern."""
    return texts.where(guard).select("place", F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(group)))).alias("value"))


def emails(texts: DataFrame, allow: tuple[str, ...] = (), domain_of_texts: str = "tree") -> DataFrame:
    """Addresses not in ``allow``: a named mailbox at a consumer provider everywhere, others outside the synthetic namespace in the tree alone."""
    found = _each(texts, F.contains("text", F.lit("@")), EMAIL, 0)
    domain = F.lower(F.substring_index("value", "@", -1))
    local = F.lower(F.substring_index("value", "@", 1))
    synthetic = domain.isin(*SYNTHETIC_DOMAINS) | domain.rlike(r"^example[-.]") | domain.rlike(r"^(?:" + "|".join(DECORATORS) + r")\b")
    for suffix in SYNTHETIC_SUFFIXES:
        synthetic = synthetic | domain.endswith(suffix)
    personal = domain.isin(*CONSUMER_DOMAINS) & ~local.isin(*PLACEHOLDER_LOCALS)
    strict = ~synthetic if domain_of_texts == "tree" else F.lit(False)
    found = found.where((personal | strict) & ~_allowed(F.col("value"), allow))
    return found.select("place", F.when(personal, "PERSONAL-MAILBOX").otherwise("EMAIL").alias("label"), "value", F.lit("BLOCK").alias("severity"))


def phone_numbers(value: str) -> list[str]:
    """Numbers of one text, as area-exchange-line; a triple with hyphens alone is a shape where a word of dimensions stands near it."""
    out = []
    for m in _PHONE.finditer(value):
        if "555" in m.group(1, 2):
            continue
        near = value[max(0, m.start() - PHONE_NEAR) : m.end() + PHONE_NEAR]
        if not any(c in m.group() for c in "(+. ") and _DIMENSIONS.search(near):
            continue
        out.append("-".join(m.groups()))
    return out


def phones(texts: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """North American numbers not in ``allow``; 555 as area or exchange is fiction, and shapes of arrays are no numbers. Only rows that match at all are looked at closely."""

    @F.pandas_udf("array<string>")
    def numbers(values: pd.Series) -> pd.Series:
        return values.map(phone_numbers)

    likely = texts.where(F.col("text").rlike(r"[2-9]\d{2}\)?[\s.\-][2-9]\d{2}[\s.\-]\d{4}"))
    found = likely.select("place", F.lit("PHONE").alias("label"), F.explode(numbers("text")).alias("value"), F.lit("BLOCK").alias("severity"))
    return found.where(~_allowed(F.col("value"), allow))


def zips(texts: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """Postal codes where the text says so; what stands after the name of an archive is none."""
    found = _each(texts, F.col("text").rlike(r"[0-9]{5}"), ZIP, 1)
    return found.where(~F.col("value").isin(*ALLOWED_ZIPS, *allow)).select("place", F.lit("ZIP").alias("label"), "value", F.lit("BLOCK").alias("severity"))


def paths(texts: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """Home paths with an account name that is not generic, and paths from a home into a private folder, unless public or covered by ``allow``."""
    near = F.contains("text", F.lit("/")) | F.contains("text", F.lit("\\"))
    users = _each(texts, near, USER_PATH, 0).where(~F.lower(F.regexp_extract("value", USER_PATH, 1)).isin(*GENERIC_USERS) & ~_covered(F.col("value"), allow))
    folder = F.lower(F.regexp_extract("value", HOME_FOLDER, 1))
    homes = _each(texts, near, HOME_FOLDER, 0).where(~folder.rlike(PUBLIC_FOLDER) & ~_covered(folder, allow))
    found = users.withColumn("label", F.lit("USER-PATH")).unionByName(homes.withColumn("label", F.lit("PRIVATE-PATH")))
    return found.select("place", "label", "value", F.lit("BLOCK").alias("severity"))


def distinct_findings(findings: DataFrame) -> DataFrame:
    """Findings once per label, value and severity, with their first place."""
    return findings.groupBy("label", F.lower("value").alias("value"), "severity").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("times"))


def bounded(token: str) -> bool:
    """Whether a token counts only between characters other than a-z and 0-9: it has a letter and no digit. Any other one is found wherever it stands."""
    return any(c.isalpha() for c in token) and not any(c.isdigit() for c in token)


class Denylist:
    """All tokens of a list as one automaton: a text is read once, whatever the length of the list."""

    def __init__(self, tokens: list[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for token in tokens:
            low = token.lower()
            if low:
                same = self.automaton.get(low, ())
                self.automaton.add_word(low, (*(same[:-2] if same else ()), token, len(low), bounded(low)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def find(self, value: str) -> list[str]:
        """Tokens of the list that ``value`` holds, in any case, each once, by the place they are first found at."""
        if not len(self.automaton):
            return []
        low = value.lower()
        found: dict[str, None] = {}
        for end, (*same, size, edges) in self.automaton.iter(low):
            if same[0] in found:
                continue
            if edges:
                before, after = low[end - size : end - size + 1] if end >= size else "", low[end + 1 : end + 2]
                if _inside(before) or _inside(after):
                    continue
            found.update(dict.fromkeys(same))
        return list(found)


def _inside(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def _lists(tokens: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for token in dict.fromkeys(tokens):
        if held and size + len(token) > AUTOMATON_CHARS:
            yield held
            held, size = [], 0
        held.append(token)
        size += len(token)
    if held:
        yield held


def denied(texts: DataFrame, tokens: list[str], domain: str = "tree") -> DataFrame:
    """Tokens of a deny list in each text, each once: place, label, value, severity.

    Tokens with a letter and without a digit are words: no a-z or 0-9 stands next to them, while an underscore or a letter of another script may. Others are
    found anywhere. Letter case does not count. One pass over the texts finds all tokens; a list beyond ``AUTOMATON_CHARS`` takes one for each part of it.
    Null texts hold nothing; an empty list finds nothing.
    """
    severity = "DEBT" if domain == "history" else "BLOCK"
    schema = T.StructType([T.StructField("place", texts.schema["place"].dataType), T.StructField("value", T.StringType())])

    def scan(part: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Denylist(part)
            for batch in batches:
                found = [search.find(x) if x else [] for x in batch.column(1).to_pylist()]
                at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([t for x in found for t in x], pa.string())], ["place", "value"])

        return run

    out = texts.sparkSession.createDataFrame([], schema)
    for part in _lists(tokens):
        out = out.unionByName(texts.select("place", "text").mapInArrow(scan(part), schema))
    return out.select("place", F.lit("DENIED").alias("label"), "value", F.lit(severity).alias("severity"))


def granted(findings: DataFrame, grants: DataFrame, domain: str) -> DataFrame:
    """Findings without an eligible grant (token, scope, reason). Whether the grants are small enough to go to every task is Spark's to see."""
    ok = grants.where((F.col("reason") != "") & F.col("scope").isin(domain, "all")).select(F.lower("token").alias("token")).distinct()
    return findings.join(ok, F.lower("value") == F.col("token"), "left_anti")


def shapes(paths_table: DataFrame) -> DataFrame:
    """The first run shape of each path; templates are exempt."""
    label = None
    for why, pattern in RUN_SHAPES:
        hit = F.col("path").rlike(pattern)
        label = F.when(hit, why) if label is None else label.when(hit, why)
    return paths_table.where(~F.col("path").rlike(SHAPE_EXEMPT)).withColumn("label", label).where("label is not null")


def undeclared(paths_table: DataFrame, declared: DataFrame) -> DataFrame:
    """Paths that are neither declared nor below a declared prefix: every prefix of a path is looked up, so the join is an equality."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = paths_table.select("path", F.explode(prefixes).alias("prefix"))
    covered = each.join(declared.select(F.col("path").alias("prefix")).distinct(), "prefix", "left_semi").select("path").distinct()
    return paths_table.join(covered, "path", "left_anti")


def shingle_overlap(left: DataFrame, right: DataFrame, n: int = 8) -> DataFrame:
    """Per left text: its distinct shingles, those that any right text holds, and their percentage."""
    a = left.select("place", F.explode(text.shingles(F.col("text"), n)).alias("h"))
    b = right.select(F.explode(text.shingles(F.col("text"), n)).alias("h")).distinct().withColumn("there", F.lit(1))
    joined = a.join(b, "h", "left").groupBy("place").agg(F.count(F.lit(1)).alias("total"), F.count("there").alias("shared"))
    return joined.withColumn("pct", F.round(F.col("shared") * 100.0 / F.greatest(F.lit(1), "total"), 2)).withColumn("over", F.col("pct") > DUP_PCT_MAX)


def _first_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, h), of each h the two smallest places at most for every ``HELD`` rows; rows keep their order where nothing is cut."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD:
            yield from _two_each(held)
            held, rows = [], 0
    if held:
        yield from _two_each(held)


def _two_each(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches)
    h = np.sort(rows["h"].to_numpy())
    often = pa.array(np.unique(h[2:][h[2:] == h[:-2]]))
    if not len(often):
        return batches
    frequent = pc.is_in(rows["h"], value_set=often)
    some = rows.filter(frequent).sort_by([("h", "ascending"), ("place", "ascending")])
    h = some["h"].to_numpy()
    third = np.concatenate([np.zeros(2, bool), h[2:] == h[:-2]])
    return [*rows.filter(pc.invert(frequent)).to_batches(), *some.filter(pa.array(~third)).to_batches()]


def shared_pairs(texts: DataFrame, n: int = 8, least: int = PAIR_MIN) -> DataFrame:
    """Pairs of texts, and how many shingles have them as their first two owners.

    Shingles are sorted once, where they arrive, in tasks for ``CHARS`` characters each, so that a sort fits in memory at any size.
    """
    each = texts.select("place", F.explode(text.shingles(F.col("text"), n)).alias("h"))
    spark = texts.sparkSession
    tasks = -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // CHARS)
    # two owners at most leave a task for each shingle of those it holds, however common it is
    sent = each.mapInArrow(_first_two, each.schema).repartition(max(tasks, shuffle_partitions(spark)), "h")
    by_place = W.partitionBy("h").orderBy(F.asc_nulls_last("place"))
    first = F.first("place").over(by_place.rowsBetween(W.unboundedPreceding, W.currentRow))
    second = sent.select("place", first.alias("a"), F.row_number().over(by_place).alias("at")).where(F.col("at") == 2)
    return second.groupBy("a", F.coalesce("place", "a").alias("b")).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def witnesses(names: DataFrame, public: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Names that follow from a public one of the same owner by a known suffix, with the witness."""
    derived = public.select("owner", F.col("name").alias("witness"), F.explode(F.array(*[F.concat("name", F.lit(s)) for s in suffixes])).alias("name"))
    first = derived.groupBy("owner", "name").agg(F.min("witness").alias("witness"))
    return names.join(first, ["owner", "name"])


def nonce(repo: Column, token: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", repo, token), 256), F.lit(8))


def coverage(texts: DataFrame, readable: Column) -> DataFrame:
    """Examined and skipped rows: what was not read is counted, never taken for clean."""
    return texts.agg(F.count_if(readable).alias("examined"), F.count_if(~readable).alias("skipped"))


def fix_prose(s: Column) -> Column:
    """Dashes of one piece of prose: spaced ones become a comma, those between letters or digits "to", others a comma at the word before; one that opens the piece goes."""
    d = "[–—―]"
    s = F.regexp_replace(s, rf"(?U)\s+{d}+\s+", ", ")
    s = F.regexp_replace(s, rf"([A-Za-z0-9]){d}+([A-Za-z0-9])", "$1 to $2")
    s = F.regexp_replace(s, rf"[ \t]*{d}+[ \t]*(?=\r?\z)", ",")
    s = F.regexp_replace(s, rf"\A[ \t]*{d}+[ \t]+", "")
    s = F.regexp_replace(s, rf"[ \t]+{d}+[ \t]*|{d}+[ \t]+", ", ")
    return F.regexp_replace(s, rf"{d}+", ",")


def fix_dashes(line: Column) -> Column:
    """:func:`fix_prose` of one line, inline code left alone; a backtick that none follows is prose."""
    pieces = F.regexp_extract_all(line, F.lit(r"`[^`]*`|(?:[^`]++|`(?![^`]*`))++"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda s: F.when(s.startswith("`") & s.endswith("`") & (F.length(s) >= 2), s).otherwise(fix_prose(s))), "")


def fix_cells(line: Column) -> Column:
    """Dashes in the cells of a table row: a cell of dashes alone says none, a dash that opens a cell becomes a hyphen. Other lines stay."""
    d = "[–—―]"
    row = line.rlike(r"^ {0,3}\|") & (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2)
    cells = F.regexp_replace(line, rf"(?<=\|)\s*{d}+\s*(?=\|)", " none ")
    cells = F.regexp_replace(cells, rf"(?<=\|)\s*{d}+\s*(?=\r?$)", " none")
    return F.when(row, F.regexp_replace(cells, rf"(?<=\|)(\s*){d}+(?=[ \t]\S)", "$1-")).otherwise(line)


def fix_markdown(texts: DataFrame, allow: str = "dashes: allow") -> DataFrame:
    """Lines of markdown texts with their dashes fixed outside code fences: place, n, line, fixed. Lines that hold ``allow`` stay.

    A line is inside a fence if an odd number of fence lines of its text come before it.
    """
    lines = texts.select("place", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    fence = F.ltrim("line").startswith("```") | F.ltrim("line").startswith("~~~")
    before = F.coalesce(F.sum(fence.cast("int")).over(W.partitionBy("place").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    code = fence | (before % 2 == 1)
    return lines.withColumn("fixed", F.when(code | ~F.col("line").rlike("[–—―]") | F.contains("line", F.lit(allow)), F.col("line")).otherwise(fix_dashes(fix_cells(F.col("line")))))


def comment_places(text: str) -> list[int] | None:
    """Where the comment of each line of Python source begins, -1 if it has none; None for source that cannot be read."""
    out = [-1] * (text.count("\n") + 1)
    try:
        for token in tokenize.generate_tokens(io.StringIO(text).readline):
            if token.type == tokenize.COMMENT:
                out[token.start[0] - 1] = token.start[1]
    except (tokenize.TokenError, SyntaxError, ValueError):
        return None
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _comments(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else comment_places(x))


def fix_python(texts: DataFrame, allow: str = "dashes: allow") -> DataFrame:
    """Lines of Python sources with the dashes of their comments fixed: place, n, line, fixed, examined. Strings stay, and lines that hold ``allow``.

    Source that cannot be read stays as it is and is not ``examined``. A text without lines to give (null) gives none.
    """
    at = _comments("text")
    both = F.arrays_zip(F.split("text", "\n", -1).alias("line"), F.coalesce(F.col("_at"), F.array().cast("array<int>")).alias("at"))
    lines = texts.where("text is not null").select("place", "text", at.alias("_at")).select("place", F.col("_at").isNotNull().alias("examined"), F.posexplode(both).alias("n", "l"))
    line, start = F.col("l.line"), F.col("l.at")
    found = F.coalesce(start >= 0, F.lit(False)) & line.rlike("[–—―]") & ~F.contains(line, F.lit(allow))
    fixed = F.when(found, F.concat(F.left(line, start), fix_prose(F.substr(line, start + 1)))).otherwise(line)
    return lines.select("place", "n", line.alias("line"), fixed.alias("fixed"), "examined")

"""Secret scans: fixed patterns, and Markov models of random strings against ordinary ones.

Everything is DataFrame code. A pattern's matches come from
`regexp_extract_all`, their places from the lengths of the gaps that `split`
leaves, summed up by doubling: work grows with the matches, not their square.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import free_prefix

#: Kind, pattern, group whose length counts, least length.
BASE_PATTERNS = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
_KEY = "A-Za-z0-9+/_-"
_LETTERS = "\u00c0-\u024f"
#: Strings that the models judge: all whole runs of key characters from 8 on.
CANDIDATE = f"(?<![{_KEY}{_LETTERS}])[{_KEY}]{{8,}}+(?![{_KEY}{_LETTERS}])"
#: Log-likelihood ratio, in nats, that outweighs how much rarer keys are than ordinary strings.
PRIOR = 7.0
#: Words of prose: letters whose case never rises again. They are so common that their prior is higher.
WORD = "[A-Z]*[a-z/_-]*"
WORD_PRIOR = 12.0
#: Share of held-out ordinary strings of a length that may pass the limit of that length.
FALSE_ALARMS = 0.001
#: Lengths with a limit of their own begin here; strings between two share the lower one's.
LENGTHS = (8, 10, 12, 16, 24, 40)
_CLASSES = 128

#: Parts of ordinary identifiers, for the labelled samples.
IDENTIFIER_PARTS = (
    "account address agent amount array async base batch block body bucket buffer build button cache call "
    "chunk class client cluster code color column commit config content context control count create cursor "
    "customer data date debug default delete detail device document driver element error event export field "
    "file filter folder font format frame function group handler hash header height http image import index "
    "input instance integer invoice item job json key label language layer length level library line link list "
    "loader local lock logger loop manager map margin memory message method metric model module month name "
    "network node number object offset option order output owner page panel parent parse password path payload "
    "percent photo pixel player plugin pointer policy pool port position price process product profile project "
    "query queue random range rate reader record region release report request resource response result return "
    "review role root route row runner sample schema screen script search section secret select sender server "
    "service session setting shape signal size source space stack start state status step stream string style "
    "summary support switch system table target task template text theme thread time title token total track "
    "transfer tree trigger type update upload url user utils value vector version video view volume warning "
    "week width window worker writer year zone"
).split()


#: Words of prose, for the labelled samples.
PROSE_WORDS = (
    "about after again although another because before between both could different during either every first "
    "following found great however important including large little making might never nothing number often other "
    "people perhaps place possible rather several should since something state still their there these thing think "
    "those though thought three through together under until using water where whether which while without world "
    "would write years "
    "aber andere arbeit auch bereich dass deutsch diese durch einen entwicklung erste freiheit gegen gesellschaft "
    "immer jedoch kinder leben machen mensch nicht noch rechnung schon sein seite sich sollte sprache stadt "
    "verschiedene versicherung viele welche werden wieder wissenschaft zeit zwischen "
    "alors apprendre aussi autre avant avec beaucoup chercher chose comme comment dans depuis deux elle encore "
    "entre faire femme fois grand histoire homme leur monde notre nous parce pendant petit peut plusieurs pour "
    "quand quelque sans toujours toute travail trouver vous "
    "ahora algo antes aunque bien cada casa como cuando desde despacio donde durante entonces entre esta forma "
    "gente gobierno hacer hasta hombre mejor mientras mismo mucho mujer mundo nada nombre nosotros nuevo otro para "
    "parte pero poco porque primero pueblo siempre sobre tambien tiempo todo trabajo"
).split()


def _ordinary(rng: random.Random) -> str:
    """An identifier, a word of prose or of several run together, or a number as people write them."""
    style = rng.randrange(10)
    if style == 0:
        digits = "".join(rng.choices("0123456789", k=rng.choice((8, 10, 12, 13, 16, 16, rng.randint(8, 40)))))
        cut = rng.choice((0, 0, 3, 4))
        return "-".join(digits[i : i + cut] for i in range(0, len(digits), cut)) if cut else digits
    if style in (1, 2, 3):
        word = "".join(rng.choices(PROSE_WORDS, k=rng.randint(1, 3)))
        return rng.choice((word, word, word.capitalize(), word.upper(), "-".join((word, rng.choice(PROSE_WORDS)))))
    parts = rng.choices(IDENTIFIER_PARTS, k=rng.randint(1, 6))
    if rng.random() < 0.4:
        number = rng.choice((str(rng.randint(0, 99)), f"v{rng.randint(1, 9)}", str(rng.randint(1990, 2030)),
                             f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
                             str(rng.randint(10**5, 10**9))))
        parts.insert(rng.randint(0, len(parts)), number)
    if style == 4:
        return "_".join(parts)
    if style == 5:
        return "-".join(parts)
    if style == 6:
        return parts[0] + "".join(p.capitalize() for p in parts[1:])
    if style == 7:
        return "_".join(parts).upper()
    if style == 8:
        return "/".join(parts)
    return "".join(p.capitalize() for p in parts)


def labelled_samples(n: int = 4000, seed: int = 42, lengths: tuple[int, int] = (8, 64)) -> tuple[list[str], list[str]]:
    """Random strings of the usual alphabets, and ordinary strings, of 8 characters or more."""
    rng = random.Random(seed)
    alphabets = (
        "0123456789abcdef",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
    )
    keys = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(*lengths))) for _ in range(n)]
    names: list[str] = []
    while len(names) < n:
        if len(name := _ordinary(rng)) >= 8:
            names.append(name)
    return keys, names


def _steps(samples: list[str], smoothing: float) -> list[list[float]]:
    """Log-probabilities of each character after each other one."""
    counts = [[0.0] * _CLASSES for _ in range(_CLASSES)]
    for s in samples:
        for a, b in zip(s, s[1:]):
            counts[ord(a) % _CLASSES][ord(b) % _CLASSES] += 1
    # Unseen pairs fall back to how often the second character occurs at all.
    alphabet = [c for c in range(33, 127) if chr(c).isalnum() or chr(c) in "+/_-"]
    single = [sum(row[c] for row in counts) for c in range(_CLASSES)]
    total = sum(single)
    base = {c: (single[c] + 1) / (total + len(alphabet)) for c in alphabet}
    out = [[0.0] * _CLASSES for _ in range(_CLASSES)]
    for a in alphabet:
        seen = sum(counts[a])
        for b in alphabet:
            out[a][b] = math.log((counts[a][b] + smoothing * base[b]) / (seen + smoothing))
    return out


@lru_cache(maxsize=4)
def ratio_table(n: int = 8000, seed: int = 42, smoothing: float = 20.0) -> tuple[float, ...]:
    """log P(b after a | random) - log P(b after a | ordinary), at 128 * a + b."""
    keys, names = labelled_samples(n, seed)
    p, q = _steps(keys, smoothing), _steps(names, smoothing)
    return tuple(round(x - y, 6) for row, col in zip(p, q) for x, y in zip(row, col))


def ratio(string: str) -> float:
    """The log-likelihood ratio of an ASCII string, summed over its steps."""
    table = ratio_table()
    return sum(table[_CLASSES * ord(a) + ord(b)] for a, b in zip(string, string[1:]))


@lru_cache(maxsize=4)
def limits(n: int = 60_000, seed: int = 43) -> tuple[float, ...]:
    """For each of `LENGTHS`, what the ratio of a string from that length on must exceed.

    The prior, or more where held-out ordinary strings of these lengths would
    pass it more often than `FALSE_ALARMS`. Words have `WORD_PRIOR` on top.
    """
    seen: list[list[float]] = [[] for _ in LENGTHS]
    for name in labelled_samples(n, seed)[1]:
        seen[sum(len(name) >= x for x in LENGTHS) - 1].append(ratio(name))
    out = []
    for found in seen:
        found.sort(reverse=True)
        out.append(round(max([PRIOR, *found[int(FALSE_ALARMS * len(found)) :][:1]]), 6))
    return tuple(out)


def limit_of(string: str) -> float:
    """What the ratio of a string must exceed to be taken for random."""
    by_length = limits()[sum(len(string) >= x for x in LENGTHS) - 1]
    return by_length + (WORD_PRIOR if re.fullmatch(WORD, string) else 0.0)


def log_ratio(string: Column) -> Column:
    """`ratio` as a column."""
    # One string, which Spark folds to a constant array: far fewer calls than a literal per value.
    table = F.split(F.lit(" ".join(map(repr, ratio_table()))), " ").cast("array<double>")
    codes = F.transform(F.split(string, ""), F.ascii)
    return F.aggregate(
        codes,
        F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last")),
        lambda a, c: F.struct(
            (
                a["sum"]
                + F.when(a["last"] < 0, 0.0).otherwise(
                    F.coalesce(F.get(table, a["last"] * _CLASSES + c), F.lit(0.0))
                )
            ).alias("sum"),
            c.alias("last"),
        ),
        lambda a: a["sum"],
    )


def is_random(string: Column) -> Column:
    """Whether the models take a string of key characters for a random one."""
    limit = F.lit(limits()[0])
    for least, value in list(zip(LENGTHS, limits()))[1:]:
        limit = F.when(F.length(string) >= least, value).otherwise(limit)
    prior = F.when(string.rlike(f"^{WORD}$"), WORD_PRIOR).otherwise(0.0)
    return log_ratio(string) > limit + prior


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once; inside lambdas Spark computes what they refer to anew each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array: each round adds what is twice as far back, so n values take log2(n) rounds."""
    def rounds(v: Column) -> Column:
        back = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.aggregate(
            F.filter(back, lambda d: d < F.size(v)),
            v,
            lambda a, d: F.transform(a, lambda x, i: F.when(i < d, x).otherwise(add(x, F.get(a, i - d)))),
        )

    return _let(values, rounds)


_SPAN = "struct<start:int,rank:int,end:int,kind:string,first:int,last:int>"


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _found(text: Column, pattern: str, kind: str, rank: int, keep: Callable[[Column], Column]) -> Column:
    """Spans of the matches that `keep` accepts, in order; none is an empty array.

    A span is (start, rank, end, kind, first, last): `start` and `end` in code
    points, `first` and `last` in bytes, the ends exclusive.
    """

    def total(matches: Column, gaps: Column, size: Callable[[Column], Column]) -> Column:
        return _running(F.transform(matches, lambda m, i: size(F.get(gaps, i)) + size(m)), lambda a, b: a + b)

    def spans(matches: Column, kept: Column, gaps: Column, ends: Column, lasts: Column) -> Column:
        every = F.transform(
            matches,
            lambda m, i: F.struct(
                (F.get(ends, i) - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.get(ends, i).alias("end"),
                F.lit(kind).alias("kind"), (F.get(lasts, i) - F.octet_length(m)).alias("first"), F.get(lasts, i).alias("last"),
            ),
        )
        return F.filter(every, lambda s, i: F.get(kept, i))

    def placed(matches: Column, kept: Column) -> Column:
        return _let(
            F.split(text, pattern),
            lambda gaps: _let(
                total(matches, gaps, F.length),
                lambda ends: _let(
                    total(matches, gaps, F.octet_length), lambda lasts: spans(matches, kept, gaps, ends, lasts)
                ),
            ),
        )

    return _let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda matches: _let(
            F.transform(matches, lambda m: keep(m)),
            lambda kept: F.when(F.exists(kept, lambda k: k), placed(matches, kept)).otherwise(_none()),
        ),
    )


def _base(text: Column) -> list[Column]:
    out = []
    for rank, (kind, pattern, group, least) in enumerate(BASE_PATTERNS):

        def keep(match, pattern=pattern, group=group, least=least):
            return F.length(F.regexp_extract(match, f"^(?:{pattern})$", group)) >= least

        found = _found(text, pattern, kind, rank, keep)
        out.append(F.when(text.rlike(pattern), found).otherwise(_none()))
    return out


def secret_spans(docs: DataFrame, name: str) -> DataFrame:
    """`docs` and the column `name`, the base and model spans of `text`, ordered by start.

    A span is (start, rank, end, kind, first, last), see `_found`. A model span
    (kind "markov") that shares characters with a base span is left out. Null
    or empty text: no spans. No column of `docs` may begin with `name`.
    """
    text = F.coalesce("text", F.lit(""))
    base, model = f"{name}_base", f"{name}_model"
    df = docs.withColumn(base, F.flatten(F.array(*_base(text))))
    df = df.withColumn(model, _found(text, CANDIDATE, "markov", len(BASE_PATTERNS), is_random))
    spans = F.sort_array(F.concat(base, model))
    return df.withColumn(name, F.when(F.size(model) > 0, _apart(spans)).otherwise(F.sort_array(base))).drop(base, model)


def _apart(spans: Column) -> Column:
    """Sorted spans without the model spans that share characters with base spans.

    Base spans in front reach at most to their running last end; of those
    behind, the next begins first.
    """
    model = len(BASE_PATTERNS)

    def without(s: Column) -> Column:
        reach = _running(F.transform(s, lambda x: F.when(x["rank"] < model, x["end"]).otherwise(0)), F.greatest)
        # From behind: the first start of a base span at a place or after it.
        begins = F.transform(F.reverse(s), lambda x: F.when(x["rank"] < model, x["start"]).otherwise((1 << 31) - 1))
        return _let(
            reach,
            lambda r: _let(
                _running(begins, F.least),
                lambda b: F.filter(
                    s,
                    lambda x, i: (x["rank"] < model)
                    | ((F.get(r, i) <= x["start"]) & (F.get(b, F.size(s) - 1 - i) >= x["end"])),
                ),
            ),
        )

    return _let(spans, without)


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def _merged(spans: Column) -> Column:
    """(first, last) in bytes of sorted spans, those that touch or overlap joined."""

    def joined(s: Column, reach: Column) -> Column:
        begins = F.filter(s, lambda x, i: (i == 0) | (x["first"] > F.get(reach, i - 1)))
        ends = F.filter(reach, lambda r, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["first"] > r))
        return F.zip_with(begins, ends, lambda x, r: F.struct(x["first"].alias("first"), r.alias("last")))

    return _let(
        spans, lambda s: _let(_running(F.transform(s, lambda x: x["last"]), F.greatest), lambda reach: joined(s, reach))
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret in `text` replaced by `mark`.

    A column `n_chars` counts the code points of changed texts anew; other
    columns, and texts without a span, null and empty ones too, stay as they
    are. Rows that repeat give a row each. An empty table gives an empty
    result.
    """
    name = free_prefix(docs, "_spans")
    df = secret_spans(docs, name)
    data = F.col("text").cast("binary")

    def cleaned(m: Column) -> Column:
        # What lies between the spans, by bytes: a place in a string is found by walking there.
        def gap(i: Column) -> Column:
            start = F.when(i == 0, 0).otherwise(F.get(m, i - 1)["last"])
            end = F.when(i == F.size(m), F.octet_length("text")).otherwise(F.get(m, i)["first"])
            return F.substring(data, start + 1, end - start).cast("string")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(m)), gap), mark)

    found = F.size(name) > 0
    df = df.withColumn("text", F.when(found, _let(_merged(F.col(name)), cleaned)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        df = df.withColumn("n_chars", F.when(found, F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return df.drop(name)


def scan_report(docs: DataFrame) -> DataFrame:
    """Per row: counts by base kind, digest of the base spans, and all spans as text.

    Null or empty text: counts 0, the digest of the empty string, spans "".
    Repeated rows give a row each; other columns are ignored.
    """
    df = secret_spans(docs.select("doc_id", "text"), "_spans")
    base = F.filter("_spans", lambda s: s["rank"] < len(BASE_PATTERNS))

    def count(rank):
        return F.size(F.filter("_spans", lambda s: s["rank"] == rank)).cast("long")

    return df.select(
        "doc_id",
        *(count(r).alias(f"n_{kind}") for r, (kind, *_) in enumerate(BASE_PATTERNS)),
        F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"),
        span_list(F.col("_spans")).alias("spans"),
    )

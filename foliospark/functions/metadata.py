"""Date, stock code and broker from report file names.

Known brokers and alias groups are plain values, a hundred at most; they become literals of the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trailing pages to skip, by broker, in the order in which brokers are tried.
BROKER_SKIP = {
    "Daiwa": 6, "JPM": 4, "HSBC": 4, "GS": 4, "MS": 7, "Citi": 8,
    "國票": 6, "兆豐": 3, "統一": 4, "永豐": 6, "元大": 4, "中信": 8,
    "元富": 2, "群益": 4, "宏遠": 2, "康和": 2, "富邦": 3, "一銀": 4, "福邦": 4,
    "Nomura": 4, "國泰": 6, "台新": 2, "合庫": 3, "凱基": 3, "凱基(一般報告)": 3, "玉山": 4,
    "MQ": 4, "BofA": 5, "CLSA": 3, "memo": 1, "凱基(法說memo)": 1,
}
#: Names of one broker; the first is the one that is kept.
ALIAS_GROUPS = ("凱基, 凱基(法說memo), 凱基(一般報告), KGI",)
DEFAULT_SKIP = 2
ANNUAL = "年報"
ROC = 1911


def alias_map(groups: Sequence[str] = ALIAS_GROUPS) -> dict[str, str]:
    """Lower-cased alias -> first name of its group; later groups win."""
    out: dict[str, str] = {}
    for group in groups:
        names = [n.strip() for n in group.replace("，", ",").split(",") if n.strip()]
        out |= {n.lower(): names[0] for n in names}
    return out


def _lookup(values: Mapping[str, str], key: Column) -> Column:
    if not values:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once for a row however often use names it."""
    return F.transform(F.array(value), use)[0]


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.pdf$", "")


def filename_tokens(name: Column) -> Column:
    plain = F.regexp_replace(stem(name), r"[|_()\[\]{}，,]", " ")
    return F.filter(F.split(plain, r"[\s\-]+"), lambda t: t != "")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_date(name: Column) -> Column:
    """YYYY/MM/DD as text, by the first of nine shapes that fits; dates are not held against a calendar. Each shape is looked for
    once, and only where none before it fits."""
    # fixed values: the shapes and their order
    alone = lambda body: rf"(?<![0-9]){body}(?![0-9])"
    cut = lambda *at: lambda d: F.concat_ws("/", *[F.substring(d, a, n) for a, n in at])
    counted = lambda offset, width: lambda d: F.concat_ws("/", (F.substring(d, 1, width).cast("int") + offset).cast("string"), F.substring(d, width + 1, 2), F.substring(d, width + 3, 2))

    def parted(offset: int) -> Callable[[Column], Column]:
        return lambda d: bound(F.split(d, "[^0-9]+"), lambda p: F.concat_ws("/", (p[0].cast("int") + offset).cast("string"), F.lpad(p[1], 2, "0"), F.lpad(p[2], 2, "0")))

    shapes = [
        (alone(r"(20[0-9]{2}[01][0-9][0-3][0-9])"), cut((1, 4), (5, 2), (7, 2))),
        (alone(r"(20[0-9]{2}[01][0-9][0-3][0-9])[0-9]"), cut((1, 4), (5, 2), (7, 2))),
        (alone(r"([0-9]{3}[01][0-9][0-3][0-9])"), counted(ROC, 3)),
        (alone(r"([0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01]))"), counted(2000, 2)),
        (alone(r"((?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?:19|20)[0-9]{2})"), cut((5, 4), (1, 2), (3, 2))),
        (alone(r"(20[0-9]{2}[/\-.][01]?[0-9][/\-.][0-3]?[0-9])"), parted(0)),
        (alone(r"([0-9]{3}[/\-.][01]?[0-9][/\-.][0-3]?[0-9])"), parted(ROC)),
        (alone(r"(20[0-9]{2}年[01]?[0-9]月[0-3]?[0-9])日?"), parted(0)),
        (alone(r"([0-9]{3}年[01]?[0-9]月[0-3]?[0-9])日?"), parted(ROC)),
    ]

    def first(t: Column, left: list) -> Column:
        (pattern, shape), rest = left[0], left[1:]
        return bound(F.regexp_extract(t, pattern, 1), lambda d: F.when(d != "", shape(d)).otherwise(first(t, rest) if rest else F.lit(None).cast("string")))

    return bound(stem(name), lambda t: first(t, shapes))


def is_complete_date(date: Column) -> Column:
    t = F.trim(date)
    digits = F.regexp_replace(t, "[^0-9]", "")
    return F.coalesce(t.rlike(r"^[0-9]{4}[/\-][0-9]{1,2}[/\-][0-9]{1,2}$") | digits.rlike("^[0-9]{8}$"), F.lit(False))


def _is_word(t: Column) -> Column:
    return F.upper(t).rlike("^[A-Z]{2,8}$") & ~F.upper(t).isin("PDF", "KY")


def code_words(name: Column) -> Column:
    """Tokens that can be a code in letters, if they are no broker's alias."""
    return F.filter(filename_tokens(name), _is_word)


def code_number(tokens: Column, dated: Column) -> Column:
    """Four digits that start a token and are neither a year near dated nor a date."""

    def four(t: Column, i: Column) -> Column:
        head = F.substring(t, 1, 4)
        follows = F.coalesce(F.get(tokens, i + 1).startswith("年"), F.lit(False))
        year = F.coalesce(head.rlike("^(19|20)") & (F.abs(head.cast("int") - dated) <= 5), F.lit(False))
        return t.rlike("^[0-9]{4}") & ~t.rlike("^[0-9]{6,8}|^[0-9]{4}年") & ~follows & ~year

    return F.substring(F.get(F.filter(tokens, four), 0), 1, 4)


def parse_code(name: Column, date: Column, aliases: Mapping[str, str]) -> Column:
    """Four digits that start a token and are neither a year nor a date, else a word of two to eight Latin letters."""
    known = list(aliases)
    word = lambda t: _is_word(t) & ~(F.lower(t).isin(*known) if known else F.lit(False))
    of = lambda x: F.coalesce(code_number(x["tokens"], x["dated"]), F.upper(F.get(F.filter(x["tokens"], word), 0)))
    return bound(F.struct(filename_tokens(name).alias("tokens"), F.substring(date, 1, 4).cast("int").alias("dated")), of)


def segments(name: Column) -> Column:
    """struct(mark, parts): the parts between _, else | or ｜, else -, whichever first gives two."""
    split = lambda p: lambda t: F.filter(F.transform(F.split(t, p), lambda s: F.trim(s)), lambda s: s != "")
    ways = [("_", split("_")), ("|", split("[|｜]")), ("-", split("-"))]
    pack = lambda m, parts: F.struct(F.lit(m).cast("string").alias("mark"), parts.alias("parts"))

    def cut(t: Column, left: list) -> Column:
        if not left:
            return pack(None, F.expr("cast(array() as array<string>)"))
        (mark, parts), rest = left[0], left[1:]
        return bound(parts(t), lambda p: F.when(F.size(p) >= 2, pack(mark, p)).otherwise(cut(t, rest)))

    return bound(stem(name), lambda t: cut(t, ways))


def broker_prefix_match(name: Column, known: Sequence[str], aliases: Mapping[str, str]) -> Column:
    """Longest known name or alias that starts the name and is followed by six digits or more; letter case counts."""
    t = stem(name)
    pairs = sorted([*((b, b) for b in known), *aliases.items()], key=lambda p: -len(p[0]))
    dated = lambda p: t.startswith(p) & F.substring(t, len(p) + 1, 6).rlike("^[0-9]{6}$")
    return F.coalesce(*[F.when(dated(p), c) for p, c in pairs], F.lit(None).cast("string"))


def letters_before_date(segment: Column) -> Column:
    return _found(segment, r"^([A-Za-z]{2,8})\+?[0-9]{6,8}$")


def broker_letters_date(segment: Column, known: Sequence[str], aliases: Mapping[str, str]) -> Column:
    """Two to eight letters and a date written together: an alias of the letters, else a known upper-case name."""
    return bound(letters_before_date(segment), lambda x: F.coalesce(_lookup(aliases, F.lower(x)), F.when(F.upper(x).isin(*known), F.upper(x))))


def broker_contains_match(segment: Column, known: Sequence[str]) -> Column:
    """The first broker that the segment holds; or the segment, if that broker's name holds it."""
    names = F.array(*map(F.lit, known))
    first = F.get(F.filter(names, lambda b: segment.contains(b) | b.contains(segment)), 0)
    return bound(first, lambda b: F.when(segment.contains(b), b).when(b.isNotNull(), segment))


def parse_broker(name: Column, known: Sequence[str], aliases: Mapping[str, str]) -> Column:
    return bound(segments(name), lambda cut: _broker(name, cut["mark"], cut["parts"], known, aliases))


def search_order(parts: Column) -> Column:
    """Segments in the order in which a broker is looked for: last, first, second, then the others."""
    n = F.size(parts)
    return F.concat(F.array(F.get(parts, n - 1), F.get(parts, 0), F.get(parts, 1)), F.slice(parts, 3, F.greatest(n - 3, F.lit(0))))


def is_annual(mark: Column, parts: Column) -> Column:
    n = F.size(parts)
    return (
        (mark == "_") & (n >= 5) & F.get(parts, 0).rlike("^[0-9]{4}$") & F.get(parts, 1).rlike("^[0-9]{4}$")
        & F.get(parts, n - 2).rlike("^[0-9]{8}$") & F.get(parts, n - 1).rlike("^[0-9]{6}$")
    )


def broker_by_place(mark: Column, parts: Column) -> Column:
    """Where no segment names a known broker: the first segment between -, the last between others, if it can be a name."""
    last, first = F.get(parts, F.size(parts) - 1), F.get(parts, 0)
    dated = lambda s: s.rlike("^[0-9]+$")
    house = F.trim(F.regexp_replace(first, "投顧$", ""))
    return F.when(mark == "-", F.when((house != "") & ~dated(house) & (F.length(house) <= 10), house)).otherwise(F.when(~dated(last) & (F.length(last) <= 10), last))


def _broker(name: Column, mark: Column, parts: Column, known: Sequence[str], aliases: Mapping[str, str]) -> Column:
    exact = lambda s: F.when(s.isin(*known), s)
    one = lambda s: F.coalesce(_lookup(aliases, F.lower(s)), broker_letters_date(s, known, aliases), exact(s), broker_contains_match(s, known))
    matched = F.get(F.filter(F.transform(search_order(parts), one), lambda x: x.isNotNull()), 0)
    found = F.when(is_annual(mark, parts), ANNUAL).otherwise(F.coalesce(matched, broker_by_place(mark, parts)))
    return F.when(mark.isNull(), broker_prefix_match(name, known, aliases)).otherwise(found)


def should_ignore_broker(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)).isin("", "unknow", "unknown"), F.lit(True))


def normalize_broker(name: Column, aliases: Mapping[str, str]) -> Column:
    t = F.nullif(F.trim(name), F.lit(""))
    return F.coalesce(_lookup(aliases, F.lower(t)), t)


def parse_metadata(name: Column, known: Sequence[str], aliases: Mapping[str, str]) -> dict[str, Column]:
    """date, code, broker. The code needs the date, to leave out years near it."""
    date = parse_date(name)
    return {"date": date, "code": parse_code(name, date, aliases), "broker": parse_broker(name, known, aliases)}

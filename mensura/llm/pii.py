"""Personal data: high-recall candidates, boosted trees on format and context, calibrated thresholds; DataFrame functions
alone.

Base spans of four kinds come from patterns and checks and always stand. Looser generators propose further spans, which
overlap one another. Nobody has labelled these, and what the base patterns say of them is no label, since they miss them by
definition. So the trees learn from examples whose answers are known by construction, all those of all texts: base spans as they are, base
spans written another way where they stand (``name (at) host [dot] org``, a card with a digit mistyped, a phone without its
plus, an address with commas), against base spans spoilt where they stand (too few or too many digits, parts over 255, a date,
a host without a name), spans of one kind taken for another, and the corpus's own proposals whose shape is none of a written-another-way span. A proposal is added
if its calibrated probability reaches its kind's threshold, no base span overlaps it and no likelier one of those it hangs
together with does.

The patterns here match what the plain ones in their comments match, leftmost and without overlaps, but start only where a
run of their first class starts (or right after a match) and give nothing back, so that they are linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.arrays import apart, bound, running
from . import boost
from .common import Scratch, table, text_or_empty, with_columns_after

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must occur in a text for a pattern to be worth trying.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
LOOSE_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)*+"
#: Numbers with blanks in them, without, and in a phone's groups: one may run into another where the next doesn't.
LOOSE_NUMBERS = (
    r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().,/-]{0,2}[0-9])++",
    r"(?<![0-9A-Za-z])[0-9](?:[.,/-]?[0-9])++",
    r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
)
#: What a loose number must look like to be proposed as a kind.
LOOKS = {
    "ip": lambda hit: hit.rlike(r"^[0-9]{1,4}(?:[., ]{1,2}[0-9]{1,4}){3}$"),
    "card": lambda hit: F.length(digits(hit)).between(12, 22) & ~F.contains(hit, F.lit(".")),
    "phone": lambda hit: F.length(digits(hit)).between(7, 16),
}
CONTEXT = 24
#: Words that tell of a kind when they come just before a span.
HINTS = {"email": "mail|contact", "ip": r"\bip\b|host|addr|server", "card": "card|visa|credit|pay|account", "phone": "phone|tel|call|mobile|fax|contact"}
PRECISION = 0.98
SPAN = "array<struct<start:int,rank:int,end:int,hit:string,kind:string,left:string,after:string>>"
PUBLIC = ("start", "rank", "end", "hit", "kind")
CHUNK = 1024  # code points that a text is cut into, so that a piece of it is found without counting from its start


def _found(text: Column, hits: Column, pattern: str) -> Column:
    """Where the hits of a pattern are: array of start, end (code points), hit, and its surroundings: the characters before it,
    of the text between hits or the hit before, in lower case, and the one after it. Linear in the text."""
    gaps = F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    zipped = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"), F.slice(gaps, 2, F.size(hits)).alias("next"))

    def places(z: Column) -> Column:
        def row(x: Column, i: Column, ends: Column) -> Column:
            before = F.concat(F.when(i > 0, F.right(F.get(z, i - 1)["hit"], F.lit(CONTEXT))).otherwise(""), F.right(x["gap"], F.lit(CONTEXT)))
            follows = F.when((x["next"] == "") & (i + 1 < F.size(z)), F.left(F.get(z, i + 1)["hit"], F.lit(1))).otherwise(F.left(x["next"], F.lit(1)))
            start = F.get(ends, i) - F.length(x["hit"])
            return F.struct(start.alias("start"), F.get(ends, i).alias("end"), x["hit"].alias("hit"), F.lower(F.right(before, F.lit(CONTEXT))).alias("left"), follows.alias("after"))

        total = running(F.transform(z, lambda x: F.length(x["gap"]) + F.length(x["hit"])))
        return bound(total, lambda ends: F.transform(z, lambda x, i: row(x, i, ends)))

    return bound(zipped, places)


def _tagged(spans: Column, kind: str, when) -> Column:
    """The spans for which ``when`` holds, as ones of a kind."""
    rank = F.lit(KINDS.index(kind)).alias("rank")
    return F.transform(F.filter(spans, when), lambda x: F.struct(x["start"].alias("start"), rank, x["end"].alias("end"), x["hit"].alias("hit"), F.lit(kind).alias("kind"), x["left"].alias("left"), x["after"].alias("after"))).cast(SPAN)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def valid(kind: str, hit: Column) -> Column:
    d = digits(hit)
    if kind == "ip":  # leading zeros don't make a part larger
        parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(d).between(14, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(d).between(10, 15)
    return F.lit(True)


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_base``, sorted by start, then kind."""
    hits, none = {}, F.array().cast("array<string>")
    for k in KINDS:
        there = F.contains(F.col(text), F.lit(NEEDS[k])) if NEEDS[k] else F.lit(True)
        hits[f"_{k}"] = F.when(there, F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none)
    df = df.withColumns(hits)

    tagged = lambda k: _tagged(_found(F.col(text), F.col(f"_{k}"), PATTERNS[k]), k, lambda x: valid(k, x["hit"]))
    return df.withColumn("_base", F.array_sort(F.concat(*map(tagged, KINDS)))).drop(*hits)


def proposals(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_wide``, the generators' spans, each once: mail-like ones, and numbers as each of the kinds they may be."""
    mail = F.col(text).contains("@") | F.col(text).contains("at)") | F.col(text).contains("at]")
    none = F.array().cast("array<string>")
    numbers = {f"_number{i}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for i, p in enumerate(LOOSE_NUMBERS)}
    df = df.withColumns({"_mail": F.when(mail, F.regexp_extract_all(text, F.lit(LOOSE_MAIL), F.lit(0))).otherwise(none), **numbers})

    places = {f"_number{i}": _found(F.col(text), F.col(f"_number{i}"), p) for i, p in enumerate(LOOSE_NUMBERS)}
    df = df.withColumns({"_mail": _found(F.col(text), F.col("_mail"), LOOSE_MAIL), **places})
    some = [_tagged(F.col(c), k, lambda x: looks(x["hit"])) for c in numbers for k, looks in LOOKS.items()]
    return df.withColumn("_wide", F.array_distinct(F.concat(_tagged(F.col("_mail"), "email", lambda x: F.lit(True)), *some))).drop("_mail", *numbers)


FEATURES = (
    "kind", "digits", "length", "blanks and hyphens", "full stops", "plus", "brackets", "commas and strokes", "check digit", "host with a name", "name of two to six letters",
    "hint", "number before", "letter or digit after", "first group", "groups", "largest group's digits", "part over 255", "written-out sign", "date", "long decimals",
)


def features(kind: Column, rank: Column, hit: Column, left: Column, after: Column) -> Column:
    """Format and context of a span: an array of doubles, in the order of ``FEATURES``."""
    d = digits(hit)
    hint = F.lit(False)
    for k in KINDS:
        hint = hint | ((kind == k) & left.rlike(HINTS[k]))
    parts = [
        rank,
        F.length(d),
        F.length(hit),
        F.length(hit) - F.length(F.regexp_replace(hit, r"[\x20-]", "")),
        F.length(hit) - F.length(F.replace(hit, F.lit("."))),
        F.startswith(hit, F.lit("+")).cast("int"),
        hit.rlike(r"[()]").cast("int"),
        hit.rlike(r"[,/]").cast("int"),
        F.coalesce(F.call_function("luhn_check", d), F.lit(False)).cast("int"),
        hit.rlike(r"(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]+\x20?(?:\.|\(dot\)|\[dot\])").cast("int"),
        hit.rlike(r"(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,6}$").cast("int"),
        hint.cast("int"),
        left.rlike(r"[0-9][.,:/-]?$").cast("int"),
        after.rlike(r"[A-Za-z0-9]").cast("int"),
        F.length(F.regexp_extract(hit, r"[0-9]+", 0)),
        F.regexp_count(hit, F.lit("[0-9]+")),
        F.array_max(F.transform(F.split(hit, "[^0-9]+"), lambda p: F.length(p))),
        hit.rlike(r"(?<![0-9])(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2}|[0-9]{4,})(?![0-9])").cast("int"),
        hit.rlike(r"[(\[](?:at|dot)[)\]]").cast("int"),
        hit.rlike(r"^(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})$").cast("int"),
        hit.rlike(r"^[0-9]+[.,][0-9]{3,}$").cast("int"),
    ]
    return F.array(*[p.cast("double") for p in parts])


def variants(kind: Column, hit: Column) -> Column:
    """A span's text written in other ways (y = 1) and spoilt (y = 0): array of hit and y."""
    d = digits(hit)
    digit = lambda col, at: F.substr(col, F.lit(at), F.lit(1))
    last = F.substr(d, F.length(d), F.lit(1))
    turned = F.concat(F.substr(d, F.lit(1), F.length(d) - 1), F.pmod(last.cast("int") + 1, F.lit(10)).cast("string"))
    grouped = lambda col, sep: F.regexp_replace(col, r"([0-9]{4})(?=[0-9])", f"$1{sep}")
    rest = F.substr(d, F.length(d) - 9, F.lit(10))
    area, mid, end = F.substr(rest, F.lit(1), F.lit(3)), F.substr(rest, F.lit(4), F.lit(3)), F.substr(rest, F.lit(7), F.lit(4))
    say = lambda good, *texts: [F.struct(t.alias("hit"), F.lit(int(good)).alias("y")) for t in texts]
    at = lambda sign, dot: F.regexp_replace(F.regexp_replace(hit, "@", sign), r"\.(?=[^@]*$)", dot)
    name, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    first = F.substring_index(hit, ".", 1)
    made = {
        "email": say(1, at(" (at) ", " (dot) "), at("[at]", "[dot]"), at(" @ ", "."), at("(at)", "."), at(" (at) ", "."))
        + say(0, F.concat(name, F.lit(" @ "), F.substring_index(host, ".", 1)), F.concat(name, F.lit("@"), F.substring_index(host, ".", 1)), F.concat(name, F.lit(" (at) "), F.substring_index(host, ".", 1))),
        "ip": say(1, F.replace(hit, F.lit("."), F.lit(",")), F.replace(hit, F.lit("."), F.lit(" . ")), F.replace(hit, F.lit("."), F.lit(". ")))
        + say(0, F.concat(first, F.lit("9."), F.substring_index(hit, ".", -3)), F.concat(F.substring_index(hit, ".", 3), F.lit(".9"), first), F.regexp_replace(hit, r"[0-9]+", "7777"), F.regexp_replace(hit, r"\.", " ")),
        "card": say(1, turned, grouped(turned, " "), grouped(turned, "-"), grouped(d, "/"), grouped(d, "- "))
        + say(0, F.concat(d, d), F.concat(F.substr(d, F.lit(1), F.lit(12))), F.concat(d, F.substr(d, F.lit(1), F.lit(6))), F.regexp_replace(d, "([0-9]{2})(?=[0-9])", "$1, ")),
        "phone": say(
            1, F.concat(F.lit("("), area, F.lit(") "), mid, F.lit("-"), end), F.concat(area, F.lit("-"), mid, F.lit("-"), end), F.concat(area, F.lit("."), mid, F.lit("."), end),
            F.concat(F.lit("+1 "), area, F.lit("/"), mid, end), F.concat(F.lit("001 "), area, F.lit(" "), mid, F.lit(" "), end),
        )
        + say(0, F.concat(F.lit("20"), digit(d, 1), digit(d, 2), F.lit("-0"), digit(d, 3), F.lit("-1"), digit(d, 4)), F.concat(mid, F.lit("."), end), rest, F.concat(area, F.lit(","), mid, F.lit(","), area), F.concat(area, F.lit(" "), mid, F.lit(" "), F.lit("0"))),
    }
    out = F.array().cast("array<struct<hit:string,y:int>>")
    for k, own in made.items():
        out = F.when(kind == k, F.array(*own)).otherwise(out)
    return out


def shape(hit: Column) -> Column:
    """The form of a text: runs of digits of one length and letters alike."""
    return F.regexp_replace(F.regexp_replace(hit, "[0-9]", "9"), "[A-Za-z]+", "a")


def likeliest(scored: Column) -> Column:
    """Of spans (x, p) that hang together by overlaps the likeliest: one sort by place, one by group."""
    by_place = F.array_sort(F.transform(scored, lambda s: F.struct(s["x"]["start"].alias("start"), s["x"]["end"].alias("end"), s["x"].alias("x"), s["p"].alias("p"))))

    def grouped(s: Column) -> Column:
        far = running(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
        heads = lambda r: running(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(r, i - 1)), 1).otherwise(0)))
        return bound(far, lambda r: F.zip_with(s, heads(r), lambda x, g: F.struct(g.alias("g"), (-x["p"]).alias("p"), x["x"].alias("x"))))

    best = lambda o: F.filter(o, lambda x, i: (i == 0) | (x["g"] != F.get(o, i - 1)["g"]))
    return F.transform(bound(by_place, lambda s: bound(F.array_sort(grouped(s)), best)), lambda x: x["x"])


@dataclass
class Finder:
    """Each kind's fitted trees and threshold; of a kind that isn't there nothing is added."""

    models: dict[str, boost.Boosted] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    held: dict[str, tuple[int, float, float]] = field(default_factory=dict)  # held-out examples, precision and recall


def examples(docs: DataFrame, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(held, f, y, n) of all distinct texts: base spans and what is made of them, and proposals of other shapes, with the
    number of examples that are alike. Texts don't move: a text's spans go to the other copies' by a digest of it. held: a
    third of the texts, by another hash."""
    scratch = scratch or Scratch(docs.sparkSession, "examples")
    docs = proposals(base_spans(docs.select(F.col(text).alias("text")).where("text is not null"), "text"), "text")
    spans = docs.select((F.shiftrightunsigned(F.xxhash64("text"), 11) % 10 < 3).alias("held"), F.when(F.size("_base") + F.size("_wide") > 0, F.sha2("text", 256)).alias("key"), "_base", apart(F.col("_wide"), F.col("_base")).alias("_wild"))
    # texts without spans are one row; a filter here would be pushed below, and the patterns tried for it again and again
    spans = spans.dropDuplicates(["key"])
    row = lambda x, hit, y, sure: F.struct(*[x[c].alias(c) for c in ("kind", "rank", "left", "after")], hit.alias("hit"), y.alias("y"), F.lit(sure).alias("sure"))
    base = F.transform("_base", lambda x: row(x, x["hit"], F.lit(1), True))
    made = F.flatten(F.transform("_base", lambda x: F.transform(variants(x["kind"], x["hit"]), lambda v: row(x, v["hit"], v["y"], True))))
    wild = F.transform("_wild", lambda x: row(x, x["hit"], F.lit(0), False))
    rows = spans.select("held", F.explode(F.concat(base, made, wild)).alias("r")).select("held", "r.*")
    # a span of one kind is none of the others that it is proposed as
    good = F.col("sure") & (F.col("y") == 1)
    form = F.when(good | ~F.col("sure"), shape(F.col("hit"))).alias("shape")
    as_kind = lambda kind, rank, y, sh: F.struct(kind.alias("kind"), rank.alias("rank"), y.alias("y"), sh.alias("shape"))
    other = [F.when(good & (F.col("kind") != k) & looks(F.col("hit")), as_kind(F.lit(k), F.lit(KINDS.index(k)), F.lit(0), F.lit(None).cast("string"))) for k, looks in LOOKS.items()]
    taken = F.array_compact(F.array(as_kind(F.col("kind"), F.col("rank"), F.col("y"), form), *other))
    rows = rows.select("held", "sure", "hit", "left", "after", F.explode(taken).alias("t")).select("held", "sure", "t.kind", "t.y", "t.shape", features(F.col("t.kind"), F.col("t.rank"), F.col("hit"), F.col("left"), F.col("after")).alias("f"))
    rows = scratch.keep(rows.groupBy("held", "sure", "kind", "y", "shape", "f").agg(F.count("*").alias("n")))
    # a proposal that looks like a span written another way may be one: it says nothing
    known = rows.where("sure and y = 1").select("kind", "shape").distinct()
    unsure = rows.where("not sure").join(known.hint("merge"), ["kind", "shape"], "left_anti")
    return rows.where("sure").unionByName(unsure).groupBy("held", "f", "y").agg(F.sum("n").alias("n"))


def _thresholds(rows: DataFrame) -> dict[int, list[np.ndarray]]:
    """Each kind's thresholds of each feature, between the values that its examples have. The values are few: to have many
    lengths a corpus must grow with their square."""
    values: dict[int, list[set]] = {i: [set() for _ in FEATURES] for i in range(len(KINDS))}
    for kind, j, v in rows.where("not held").select(F.get("f", 0).cast("int").alias("kind"), F.posexplode("f")).distinct().coalesce(8).toLocalIterator():
        values[kind][j].add(v)
    return {i: [boost.between(np.array(sorted(own), float)) for own in some] for i, some in values.items()}


def _binned(rows: DataFrame, cuts: dict[int, list[np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each kind's features, answers, whether held out, and weights. Examples that no threshold tells apart are one row whose
    weight is their number, so the driver's share is small however many there are; a row's features are thresholds at least
    as large as its values, below which no other ones are."""
    limits = F.array(*[F.array(*[F.lit([float(c) for c in own]).cast("array<double>") for own in cuts[i]]) for i in range(len(KINDS))])
    under = lambda v, j: F.size(F.filter(F.get(F.get(limits, F.get("f", 0).cast("int")), j), lambda c: c < v))
    code = F.array_join(F.transform("f", lambda v, j: F.chr(under(v, j) + 65)), "")
    told = rows.groupBy(F.get("f", 0).cast("int").alias("kind"), code.alias("code"), "y", "held").agg(F.sum("n").alias("n"))
    got = sorted((r["kind"], r["code"].encode(), r["y"], r["held"], r["n"]) for r in told.coalesce(8).toLocalIterator())
    out = {}
    for i in range(len(KINDS)):
        own = [r for r in got if r[0] == i]
        bins = np.frombuffer(b"".join(r[1] for r in own), np.uint8).reshape(-1, len(FEATURES)) - 65
        tops = [np.append(c, c[-1] + 1 if len(c) else 0.0) for c in cuts[i]]
        x = np.stack([top[bins[:, j]] for j, top in enumerate(tops)], 1)
        out[i] = x, np.array([r[2] for r in own]), np.array([r[3] for r in own], bool), np.array([r[4] for r in own], float)
    return out


def fit(df: DataFrame, text: str = "text") -> Finder:
    """Trees and thresholds from all examples of all distinct texts (null ones and other columns play no part, long ones are
    read whole). Each kind has trees of its own. Nothing is ever added of a kind that lacks examples or counterexamples.
    ``Finder.held`` has the number of right examples in the held-out third, precision and recall on it."""
    scratch = Scratch(df.sparkSession, "examples")
    rows = scratch.keep(examples(df, text, scratch))
    cuts = _thresholds(rows)
    told = _binned(rows, cuts)
    scratch.close()
    out = Finder()
    for i, k in enumerate(KINDS):
        x, y, held, weight = told[i]
        if min(len(np.unique(y[~held])), len(np.unique(y[held]))) < 2:
            continue
        model = boost.fit(x, y, held, weight, cuts[i])
        q, good, n = model.probability(x[held]), y[held], weight[held]
        order = np.argsort(-q, kind="stable")
        hits, taken = np.cumsum((good * n)[order]), np.cumsum(n[order])
        ok = np.flatnonzero((hits >= PRECISION * taken) & (hits >= 5))
        ok = [j for j in ok if j + 1 == len(q) or q[order[j + 1]] < q[order[j]]]
        if not ok:
            continue
        # half way to the next probability below, never under a half
        last = q[order[ok[-1]]]
        below = q[order[ok[-1] + 1]] if ok[-1] + 1 < len(q) else 0.0
        out.models[k], out.thresholds[k] = model, max(float((last + below) / 2), 0.5)
        added = n * (q >= out.thresholds[k])
        out.held[k] = (int((good * n).sum()), float((good * added).sum() / added.sum()) if added.any() else 1.0, float((good * added).sum() / (good * n).sum()))
    return out


def find(df: DataFrame, finder: Finder, text: str = "text", base: str = "pii_base", spans: str = "pii_spans") -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of start, rank, end, hit, kind by start, then kind; ``spans`` has the added ones
    too. Positions are code points. A null text counts as empty and has no spans. Columns that bear these names are
    replaced; all others pass through; repeated rows stay; an empty table gives an empty one. Nothing is shuffled. The work on a
    very long text with very many spans grows with its length, but for sorts of the spans."""
    df = with_columns_after(df, base, spans)
    rest = df.columns
    df = base_spans(df.withColumn("_text", text_or_empty(text)), "_text")
    shown = lambda c: F.transform(c, lambda x: F.struct(*[x[n].alias(n) for n in PUBLIC]))
    if not finder.models:
        return df.select(*rest, shown("_base").alias(base), shown("_base").alias(spans))
    df = proposals(df, "_text")

    def likely(s: Column) -> Column:
        """Whether a proposal (x, f) reaches its kind's threshold, and how likely it is."""
        p = F.lit(None).cast("double")
        for k, model in finder.models.items():
            mine = bound(model.column(s["f"]), lambda q: F.when(q >= finder.thresholds[k], q))
            p = F.when(s["x"]["kind"] == k, mine).otherwise(p)
        return p

    df = df.withColumn("_free", apart(F.col("_wide"), F.col("_base")))
    f = lambda x: features(x["kind"], x["rank"], x["hit"], x["left"], x["after"])
    scored = F.transform(F.transform("_free", lambda x: F.struct(x.alias("x"), f(x).alias("f"))), lambda s: F.struct(s["x"].alias("x"), likely(s).alias("p")))
    df = df.withColumn("_likely", F.filter(scored, lambda s: s["p"].isNotNull()))
    added = F.when(F.size("_likely") > 0, likeliest(F.col("_likely"))).otherwise(F.array().cast(SPAN))
    return df.select(*rest, shown("_base").alias(base), shown(F.array_sort(F.concat("_base", added))).alias(spans))


def redact(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """The text with each found span, or run of overlapping ones, replaced by its first kind's name in brackets."""

    def cut(s: Column, chunks: Column) -> Column:
        """Of each run of overlapping spans the text before it and its name, and the text after the last run."""
        far = running(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
        last = lambda r, i: F.when(i > 0, F.get(r, i - 1)).otherwise(0)

        def part(a: Column, b: Column) -> Column:
            first = F.floor(a / CHUNK).cast("int")
            some = F.slice(chunks, first + 1, F.floor(b / CHUNK).cast("int") - first + 1)
            return F.substr(F.array_join(some, ""), a - first * CHUNK + 1, b - a)

        piece = lambda x, at: F.concat(part(at, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        parts = lambda r: F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= last(r, i)), piece(x, last(r, i))).otherwise(""))
        return bound(far, lambda r: F.concat(F.array_join(parts(r), ""), part(F.get(r, F.size(r) - 1), F.length(F.col(text)))))

    whole = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    new = bound(F.col(spans), lambda s: bound(whole, lambda c: cut(s, c)))
    return df.withColumn(text, F.when(F.size(spans) > 0, new).otherwise(F.col(text)))


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, fit(docs))
    count = lambda k: F.size(F.filter("pii_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(listed("pii_base").cast("binary"), 256).alias("base_sha256"), listed("pii_spans").alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))


def redact_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, with its personal data replaced and ``n_chars`` (if there) recounted."""
    out = redact(find(docs, fit(docs)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("pii_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)

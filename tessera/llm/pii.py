"""PII detection by candidate gradient boosting, with built-in functions only.

Base kinds (email, ip, card, phone) are found by their formats. High-recall generators propose further, overlapping
spans; boosted trees over format and context features score each candidate, and a threshold per kind, calibrated on
held-out examples for precision, selects those that are added. Trees are trained on the driver from a few thousand
examples that are generated here (formats of personal data and look-alikes such as versions, orders, prices), and run
as a CASE expression. Base spans always stay.

Positions come from the gaps between matches (split and extract with one pattern), in code points. Possessive
quantifiers and look-behinds keep the expressions linear in the text and free of recursion; `\\G` keeps the leftmost
non-overlapping matches the same.

Cases: null texts are empty and have no spans; repeated rows are judged each for itself; an empty table gives an empty
result; extra columns are kept by redact() and ignored by detect().
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pack_columns, unpack_columns

#: The base formats. A cheap test that any text with a match passes stands before each.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ["email", "ip", "card", "phone"]
SPAN = "array<struct<start:int,end:int>>"

#: Generators of further candidates: kind, cheap test, pattern. Runs of free length have no upper bound, so that no part
#: of one stays in the text (possessive classes are linear anyway).
GENERATORS = [
    ("secret", r"[=:]", r"(?i)(?<![A-Za-z0-9])(?:token|secret|password|passwd|api[_-]?key)\x20{0,2}+[=:]\x20{0,2}+[\x22']?+[A-Za-z0-9+/_.-]{8,}+[\x22']?+"),
    ("secret", r"[A-Z]{4}[0-9A-Z]{16}", r"(?<![A-Za-z0-9])[A-Z]{4}[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("secret", r"[0-9a-f]{32}", r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"[0-9]{3}[\x20.-][0-9]{4}", r"(?<![0-9+(])\(?+[0-9]{3}\)?+[\x20.-]{1,2}+[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])"),
    ("email", r"(?i)[\[( ]at[\]) ]", r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+\x20?[\[(\x20]at[\])\x20]\x20?[A-Za-z0-9-]{2,}+\x20?[\[(\x20]dot[\])\x20]\x20?[A-Za-z]{2,}+"),
]
CUES = r"(?i)(token|secret|password|key|tel|phone|call|fax|mobile|ssn|social|iban|account|mail|contact)[^A-Za-z0-9]{0,4}$"
COUNTERCUES = r"(?i)(version|order|invoice|ref|isbn|part|page|no\.|#|\$|eur|usd|price|commit|sha1|md5|rev)[^A-Za-z0-9]{0,4}$"
FEATURES = ["length", "digits", "uppers", "hexes", "marks", "cue", "counter", "kind"]
KINDS = ["email", "ip", "card", "phone", "iban", "secret", "ssn"]


def _cumulated(sizes: Column, chunk: int = 256) -> Column:
    """Sums of all before each element, in two levels so that many matches don't cost the square."""
    zero = F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("o"))
    step = lambda a, x: F.struct((a["t"] + x).alias("t"), F.concat(a["o"], F.array(a["t"])).alias("o"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / chunk).cast("int")), lambda k: F.slice(sizes, k * chunk + 1, chunk))
    total = lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)
    starts = F.aggregate(F.transform(parts, total), zero, step)["o"]
    inner = F.transform(parts, lambda p: F.aggregate(p, zero, step)["o"])
    return F.flatten(F.transform(F.arrays_zip(starts.alias("s"), inner.alias("i")), lambda x: F.transform(x["i"], lambda y: y + x["s"])))


def find(text: str, cheap: str, pattern: str, at: str) -> Column:
    """Array of (m, start) of the matches of a pattern: text names the column, `at` a matches column made by matches()."""
    gaps = F.transform(F.split(F.col(text), pattern, -1), lambda g: F.length(g))
    sizes = F.zip_with(F.slice(gaps, 1, F.size(at)), F.col(at), lambda g, m: g + F.length(m))
    ends = F.zip_with(_cumulated(sizes), sizes, lambda b, n: b + n)
    spans = F.zip_with(F.col(at), ends, lambda m, e: F.struct(m.alias("m"), (e - F.length(m)).alias("start"), e.alias("end")))
    return F.when(F.size(at) > 0, spans).otherwise(F.array().cast("array<struct<m:string,start:int,end:int>>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(F.split(_digits(m), ""))
    doubled = F.transform(F.filter(d, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.get(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), x.cast("int"))))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        trimmed = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(trimmed, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return n.between(16, 19) & _luhn(m)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _count(m: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(m, f"[^{kept}]", "")).cast("double")


def _features(x: Column, before: Column, kind: str) -> list[Column]:
    m = x["m"]
    return [
        F.length(m).cast("double"),
        _count(m, "0-9"),
        _count(m, "A-Z"),
        _count(m, "0-9a-fA-F"),
        _count(m, r"=:@.()\[\] -"),
        before.rlike(CUES).cast("double"),
        before.rlike(COUNTERCUES).cast("double"),
        F.lit(float(KINDS.index(kind))),
    ]


def _example_features(before: str, m: str, kind: str) -> list[float]:
    import re

    n = lambda p: float(len(re.findall(p, m)))
    return [float(len(m)), n("[0-9]"), n("[A-Z]"), n("[0-9a-fA-F]"), n(r"[=:@.()\[\] -]"), float(bool(re.search(CUES, before))), float(bool(re.search(COUNTERCUES, before))), float(KINDS.index(kind))]


def examples(n: int = 3000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Generated candidates with labels: personal data in its formats, and look-alikes."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choices("0123456789", k=k))
    mixed = lambda a, k: "".join(r.choices(a, k=k))
    upper, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    good, bad = ["call ", "phone: ", "tel. ", "contact ", "my ssn ", "account ", "and the ", "is ", ""], ["order ", "invoice ", "version ", "ref. ", "part no. ", "commit ", "sha1 ", "price $"]
    x, y = [], []
    for _ in range(n):
        kind = r.choice(["secret", "ssn", "phone", "iban", "email"])
        yes = r.random() < 0.6
        if kind == "secret":
            shape = r.randrange(3)
            m = [f'token = "{mixed(hexes, 40)}"', "AKIA" + mixed(upper, 16), mixed(hexes, r.choice([32, 40, 64]))][shape]
            if not yes:
                m = ["password: " + mixed("abcdefghij", 9), mixed("ABCDEFGHIJ", 20), digits(r.randrange(32, 60))][shape]
        elif kind == "ssn":
            m = f"{digits(3)}-{digits(2)}-{digits(4)}"
        elif kind == "phone":
            m = r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {}-{}"]).format(digits(3), digits(3), digits(4))
        elif kind == "iban":
            m = r.choice(["DE", "FR", "ES", "GB"]) + digits(2) + "".join(r.choice(["", " "]) + digits(4) for _ in range(r.randrange(3, 6)))
            m = m if yes else m[:4] + mixed("ABCDEFGHIJ", 14)
        else:
            m = f"{mixed('abcdefgh', 6)} [at] {mixed('abcdefgh', 6)} [dot] com" if yes else f"{mixed('abc', 3)} at {mixed('abc', 3)} dot net"
        x.append(_example_features(r.choice(good if yes else bad), m, kind))
        y.append(float(yes))
    return np.array(x), np.array(y)


@functools.cache
def trees(rounds: int = 24, rate: float = 0.4) -> tuple[list, tuple[tuple[str, float], ...], float]:
    """Boosted depth-2 trees (logistic loss, Newton leaves), and a threshold per kind with precision 0.97 or more on held-out examples."""
    x, y = examples()
    hold = np.arange(len(y)) % 4 == 0
    xt, yt = x[~hold], y[~hold]
    base = float(np.log(yt.mean() / (1 - yt.mean())))
    z = np.full(len(yt), base)
    model = []

    def best(mask, g, h):
        top = (0.0, None, None)
        for f in range(x.shape[1]):
            values = np.unique(xt[mask, f])
            for cut in ((values[1:] + values[:-1]) / 2)[:: max(1, len(values) // 16)]:
                left = mask & (xt[:, f] < cut)
                right = mask & ~left
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, right)) - g[mask].sum() ** 2 / (h[mask].sum() + 1)
                if gain > top[0]:
                    top = (gain, f, float(cut))
        return top[1], top[2]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = yt - p, p * (1 - p)
        leaf = lambda s: float(rate * g[s].sum() / (h[s].sum() + 1))  # noqa: B023, E731
        every = np.ones(len(yt), bool)
        f, cut = best(every, g, h)
        if f is None:
            break
        node = [f, cut]
        for side in (xt[:, f] < cut, xt[:, f] >= cut):
            f2, cut2 = best(side, g, h)
            if f2 is None:
                node.append(leaf(side))
                z[side] += leaf(side)
            else:
                low, high = side & (xt[:, f2] < cut2), side & (xt[:, f2] >= cut2)
                node.append([f2, cut2, leaf(low), leaf(high)])
                a, b = leaf(low), leaf(high)
                z[low] += a
                z[high] += b
        model.append(node)
    s = np.full(hold.sum(), base) + sum(np.array([_walk(n, row) for row in x[hold]]) for n in model)
    cuts = []
    for kind in KINDS:
        mine = x[hold][:, 7] == KINDS.index(kind)
        cut = 0.0
        for c in np.sort(s[mine])[::-1]:
            if y[hold][mine & (s >= c)].mean() < 0.97:
                break
            cut = float(c)
        cuts.append((kind, min(cut, 1.0) if mine.any() else 0.0))
    return model, tuple(cuts), base


def _walk(node, row):
    if not isinstance(node, list):
        return node
    return _walk(node[2] if row[node[0]] < node[1] else node[3], row)


def _tree_sum(features: list[Column]) -> Column:
    model, _, base = trees()

    def column(node) -> Column:
        if not isinstance(node, list):
            return F.lit(node)
        return F.when(features[node[0]] < node[1], column(node[2])).otherwise(column(node[3]))

    total = F.lit(base)
    for node in model:
        total = total + column(node)
    return total




def _validator(kind: str):
    return lambda x: _valid(kind, x["m"])


def _rater(text: str, kind: str):
    def rate(x: Column) -> Column:
        before = F.substring(F.col(text), F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.array(*_features(x, before, kind)).alias("v"))

    return rate


def _selector(cut: float):
    return lambda x: _tree_sum([F.get(x["v"], j) for j in range(len(FEATURES))]) >= cut


def _tagger(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.lit(kind).alias("kind"))


def spans_of(docs: DataFrame, text: str) -> DataFrame:
    """docs with one array of (start, end) a kind: `_base_<kind>` and `_more_<kind>`."""
    patterns = [("email", None, EMAIL), ("ip", r"[0-9]\.[0-9]", IP), ("card", r"[0-9](?:[\x20-]?[0-9]){15}", CARD), ("phone", None, PHONE)]
    every = patterns + GENERATORS
    marks = {"email": "@", "phone": "+"}
    found = {}
    for i, (kind, cheap, pattern) in enumerate(every):
        test = F.contains(F.col(text), F.lit(marks[kind])) if cheap is None else F.col(text).rlike(cheap)
        found[f"_m{i}"] = F.when(test, F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumns(found)
    docs = docs.withColumns({f"_f{i}": find(text, c, p, f"_m{i}") for i, (_, c, p) in enumerate(every)}).drop(*found)
    cuts = dict(trees()[1])
    bare = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    out = {f"_base_{kind}": F.transform(F.filter(f"_f{i}", _validator(kind)), bare) for i, (kind, _, _) in enumerate(patterns)}
    more: dict[str, list[Column]] = {}
    for i, (kind, _, _) in list(enumerate(every))[len(patterns) :]:
        kept = F.filter(F.transform(f"_f{i}", _rater(text, kind)), _selector(cuts[kind]))
        more.setdefault(kind, []).append(F.transform(kept, bare))
    out |= {f"_more_{kind}": F.array_distinct(F.concat(*parts)) for kind, parts in more.items()}
    return docs.withColumns(out).drop(*(f"_f{i}" for i in range(len(every))))


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def _all_of(kind: str) -> Column:
    parts = [F.col(f"_base_{kind}")] * (kind in BASE_KINDS) + [F.col(f"_more_{kind}")] * any(kind == g[0] for g in GENERATORS)
    return F.array_sort(F.array_distinct(F.concat(*parts))) if len(parts) > 1 else F.array_sort(parts[0])


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), code points, end exclusive."""
    rows = spans_of(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")), "_text")
    base = F.array_join(F.concat(*(_listed(k, F.col(f"_base_{k}")) for k in BASE_KINDS)), ",")
    spans = F.array_join(F.concat(*(_listed(k, _all_of(k)) for k in KINDS)), ",")
    return rows.select(
        "doc_id",
        *(F.size(f"_base_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(base, 256).alias("base_sha256"),
        spans.alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in capitals and angle brackets (overlapping spans become one), n_chars adjusted."""
    names, free = docs.columns, ["text"] + ["n_chars"] * ("n_chars" in docs.columns)
    docs = pack_columns(docs, *free)
    rows = spans_of(docs.withColumn("_text", F.col("text").cast("string")), "_text")
    tagged = F.array_sort(F.concat(*(F.transform(_all_of(k), _tagger(k)) for k in KINDS)))
    rows = rows.withColumn("_all", F.coalesce(tagged, F.array().cast("array<struct<start:int,end:int,kind:string>>")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.col("_text")

    def step(a: Column, s: Column) -> Column:
        end = -s["end"]
        fresh = F.struct(end.alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("out"))
        return F.when(s["start"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], end).alias("at"), a["out"].alias("out")))

    folded = F.aggregate("_all", zero, step)
    rows = rows.withColumn("_done", F.when(F.size("_all") > 0, folded))
    clean = F.when(F.col("_done").isNull(), text).otherwise(F.concat(F.array_join("_done.out", ""), F.substring(text, F.col("_done.at") + 1, F.length(text))))
    rows = rows.withColumn("text", clean)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.col("_done").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return unpack_columns(rows, names, *free)

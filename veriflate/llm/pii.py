"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from fixed patterns for email, ip, card and phone with their
checks (parts at most 255, Luhn, digit counts). The method looks at further
candidates: phone numbers without a plus, card-like numbers that fail the
checksum, and keys or passwords. Labelers vote on each (found, against, or
abstain): the shape (a strict pattern), gazetteers (card and area prefixes, key
formats), the context words before the span, the mark between them, and the mix
of characters. Votes are counted by kind and pattern, which gives at most
3^LABELERS rows a kind; expectation-maximisation over these counts estimates
each labeler's reliability, and a logistic span classifier is fitted to the
posteriors. The classifier, turned into an expression, decides which candidates
become spans; candidates that overlap a base span or an earlier accepted one
are dropped, base spans stay.

The base patterns here are written so that they match the same spans in time
that grows with the text: they start only at the beginning of a run of their
characters (or right after the last match) and use possessive runs.

Positions are code points. A match's start is the length of all text between
matches and of all matches before it, from split() and regexp_extract_all().

Cases: a null text is empty; no matches give empty strings; the hash is then of
the empty string; repeated rows give repeated results; with no candidates at
all nothing is fitted; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9])(?<![0-9][\x20-]))[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

#: Further candidates of the method. Fixed patterns of this module.
LOCAL_PHONE = r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
SECRET = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+(?:={1,2}(?![A-Za-z0-9_+/=-]))?"
EXTRA = ("phone", "card", "secret")
#: Characters before a candidate that labelers see.
BEFORE = 24
#: First digits of issued payment cards (ISO/IEC 7812 ranges in common use).
CARD_PREFIX = r"^(4|5[1-5]|2[2-7]|3[47]|6(011|5))"
WORDS = {
    "phone": r"(?i)(phone|tel|call|mobile|cell|fax|ruf|llame|appel)",
    "card": r"(?i)(card|visa|karte|tarjeta|carte|pay|credit)",
    "secret": r"(?i)(token|key|secret|password|passwd|pwd|auth|bearer|credential|clave|schl)",
}
OTHER = r"(?i)(isbn|order|invoice|version|serial|page|http|www|sha|commit|hash)"
LABELERS = 5
ROUNDS = 60
ACCEPT = 0.5


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, end, kind, value), leftmost non-overlapping."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        row = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct(i.alias("i"), F.substr(back, i, F.lit(1)).cast("int").alias("d")))
    sums = F.aggregate(places, F.lit(0), lambda acc, p: acc + F.when(p["i"] % 2 == 1, p["d"]).when(p["d"] > 4, 2 * p["d"] - 9).otherwise(2 * p["d"]))
    return sums % 10 == 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _ip_fits(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*+(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$")))


def _guard(text: Column, test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>"))


def _votes(kind: str, value: Column, before: Column) -> Column:
    """LABELERS votes: 1 for, 0 against, -1 abstains."""
    flag = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    digits = _digits(value)
    n = F.length(digits)
    if kind == "phone":
        shape = flag(F.regexp_like(value, F.lit(r"^(\([0-9]{3}\)\x20|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}$")), F.lit(False))
        known = flag(F.regexp_like(digits, F.lit("^[2-9][0-9]{2}[2-9]")), F.regexp_like(digits, F.lit("^[01]")))
        looks = flag(F.size(F.array_distinct(F.split(digits, ""))) >= 4, F.size(F.array_distinct(F.split(digits, ""))) <= 2)
    elif kind == "card":
        shape = flag(n.isin(15, 16) & F.regexp_like(value, F.lit(r"^([0-9]+|[0-9]{4}([\x20-][0-9]{4}){3})$")), ~n.isin(15, 16))
        known = flag(F.regexp_like(digits, F.lit(CARD_PREFIX)), ~F.regexp_like(digits, F.lit(CARD_PREFIX)))
        looks = flag(luhn(digits), ~luhn(digits))
    else:
        shape = flag(F.regexp_like(value, F.lit(r"^([0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z0-9+/_-]{20,}={0,2})$")), F.regexp_like(value, F.lit(r"^([A-Za-z]+|[-_/+]+|[0-9]+)$")))
        known = flag(F.regexp_like(value, F.lit(r"^(sk|pk|ghp|gho|xox[abp]|AKIA|AIza|eyJ)")), F.regexp_like(value, F.lit(r"[a-zA-Z]{16}|/")))
        looks = flag((n >= 4) & F.regexp_like(value, F.lit("[A-Za-z]")), n < 2)
    context = flag(F.regexp_like(before, F.lit(WORDS[kind])), F.regexp_like(before, F.lit(OTHER)))
    mark = flag(F.regexp_like(before, F.lit(r"[=:]\s*[\"']?$")), F.regexp_like(before, F.lit(r"[/?&#.@_]$")))
    return F.array(*(v.cast("int") for v in (shape, known, looks, context, mark)))


def _candidates(text: Column, spans: Column, kind: str) -> Column:
    """Those spans with their votes, if they touch no base span."""
    free = F.filter(spans, lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def voted(s: Column) -> Column:
        at = F.greatest(s["start"] - BEFORE, F.lit(0))
        before = F.substr(text, at + 1, s["start"] - at)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), _votes(kind, s["value"], before).alias("votes"))

    return F.transform(free, voted)


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and candidates (arrays) for each row, from one read of the text."""
    t = F.col("_text")
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    email = _guard(t, F.contains(t, F.lit("@")), matches(t, EMAIL, "email"))
    ip = _guard(t, F.regexp_like(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]")), F.filter(matches(t, IP, "ip"), lambda s: _ip_fits(s["value"])))
    long_number = F.regexp_like(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){13}"))
    numbers = _guard(t, long_number, F.filter(matches(t, CARD, "card"), lambda s: F.length(_digits(s["value"])).between(14, 19)))
    phone = _guard(t, F.contains(t, F.lit("+")), F.filter(matches(t, PHONE, "phone"), lambda s: F.length(_digits(s["value"])).between(10, 15)))
    local = _guard(t, F.regexp_like(t, F.lit(r"[0-9][\x20.-][0-9]{4}")), matches(t, LOCAL_PHONE, "phone"))
    secret = _guard(t, F.regexp_like(t, F.lit(r"[A-Za-z0-9_+/-]{20}")), F.filter(matches(t, SECRET, "secret"), lambda s: F.regexp_like(s["value"], F.lit("[0-9]"))))
    df = df.withColumns({"numbers": numbers, "local": local, "secret": secret, "_email": email, "_ip": ip, "_phone": phone})
    good = F.filter("numbers", lambda s: luhn(_digits(s["value"])))
    bad = F.filter("numbers", lambda s: ~luhn(_digits(s["value"])))
    df = df.withColumn("base", F.concat("_email", "_ip", good, "_phone"))
    more = F.concat(_candidates(t, F.col("local"), "phone"), _candidates(t, bad, "card"), _candidates(t, F.col("secret"), "secret"))
    thin = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return df.select("doc_id", thin.alias("base"), more.alias("candidates"), *(f"_keep_{c}" for c in keep))


def fit(counts: list[tuple[str, tuple[int, ...], int]]) -> tuple[dict[str, float], list[list[float]], dict[tuple, float]]:
    """EM over (kind, votes, count): prior by kind, and each labeler's rates of
    a vote for the candidate under both classes; posterior by (kind, votes)."""
    prior = {k: 0.5 for k, _, _ in counts}
    # Start: labelers are right three times in four.
    rate = [[0.25, 0.75] for _ in range(LABELERS)]
    post: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        for kind, votes, _n in counts:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for r, v in zip(rate, votes, strict=True):
                if v >= 0:
                    odds += math.log(r[1] / r[0]) if v else math.log((1 - r[1]) / (1 - r[0]))
            post[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in prior:
            own = [(post[k, v], n) for k, v, n in counts if k == kind]
            prior[kind] = (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)
        for j in range(LABELERS):
            for c in (0, 1):
                seen = [(post[k, v] if c else 1 - post[k, v], v[j], n) for k, v, n in counts if v[j] >= 0]
                mass = sum(p * n for p, _, n in seen)
                # Prior counts keep each labeler better than chance where little was seen.
                rate[j][c] = (sum(p * n for p, v, n in seen if v) + (7.5 if c else 2.5)) / (mass + 10)
    return prior, rate, post


def _inputs(kind: str, votes: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(kind == k) for k in EXTRA), *(float(v == 1) for v in votes), *(float(v == 0) for v in votes)]


def train(counts: list[tuple[str, tuple[int, ...], int]], post: dict[tuple, float]) -> list[float]:
    """Weights of a logistic classifier fitted to the posteriors (gradient steps with a ridge)."""
    size = len(_inputs("", (0,) * LABELERS))
    w = [0.0] * size
    total = sum(n for _, _, n in counts) or 1
    rows = [(_inputs(k, v), post[k, v], n / total) for k, v, n in counts]
    for _ in range(800):
        grad = [1e-4 * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for i in range(size):
                grad[i] += n * (p - y) * x[i]
        w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def _accepted(weights: list[float]) -> Column:
    """The candidates that the classifier takes, by start, without overlaps."""

    def score(c: Column) -> Column:
        out = F.lit(weights[0])
        for w, k in zip(weights[1:], EXTRA, strict=False):
            out = out + F.when(c["kind"] == k, F.lit(w)).otherwise(0.0)
        for j in range(LABELERS):
            out = out + F.when(c["votes"][j] == 1, F.lit(weights[1 + len(EXTRA) + j])).when(c["votes"][j] == 0, F.lit(weights[1 + len(EXTRA) + LABELERS + j])).otherwise(0.0)
        return out

    chosen = F.filter("candidates", lambda c: score(c) >= math.log(ACCEPT / (1 - ACCEPT)))
    spans = F.array_sort(F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return F.aggregate(spans, none, lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]), acc).otherwise(F.concat(acc, F.array(s))))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind in the order of BASE and EXTRA."""
    order = {k: i for i, k in enumerate(dict.fromkeys(BASE + EXTRA))}

    def place(k: Column) -> Column:
        out = F.lit(len(order))
        for name, i in order.items():
            out = F.when(k == name, i).otherwise(out)
        return out

    rows = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place(s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and added (arrays of start, end, kind) for each row; keep names columns of docs to carry along as _keep_<name>."""
    df = store(extract(docs, id_col, text_col, keep), "pii")
    votes = df.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").count().collect()
    counts = sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in votes)
    _, _, post = fit(counts)
    return df.withColumn("added", _accepted(train(counts, post))).drop("candidates")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span replaced by <kind>; a null text stays null. Overlapping spans are replaced as one, named after the first."""
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    out = detect(docs, id_col, text_col, (id_col, text_col, *others))
    t = F.col(f"_keep_{text_col}")
    spans = F.array_sort(F.concat("base", "added"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.concat(F.substr(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(mark)).alias("out"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(fresh)

    done = F.aggregate(spans, zero, step)
    text = F.when(F.size(spans) == 0, t).otherwise(F.concat(F.array_join(done["out"], ""), F.substr(t, done["at"] + 1, F.length(t))))
    cols = [text.alias(c) if c == text_col else F.col(f"_keep_{c}").alias(c) for c in docs.columns]
    return out.select(*cols)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detect(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *(count(k) for k in BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
